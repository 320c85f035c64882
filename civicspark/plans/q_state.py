"""Keyed-state queries: dedup keys, upserts, sweeps, history, retention, accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import geo, numeric
from civicspark.operators import state as st
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.plans.roles import ctes
from civicspark.session import settled

_POINT = "'POINT(' || c_custkey * 37 % 700 || ' ' || c_custkey * 91 % 300 || ')'"


def _customer_props(t: Tables):
    """Customers as features: some carry a source id, all carry a volatile export stamp."""
    x, y = (F.col("c_custkey") * 37 % 700).cast("string"), (F.col("c_custkey") * 91 % 300).cast("string")
    return t.customer.select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_custkey").cast("string")).otherwise("").alias("feature_id"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("fme_tstamp"), F.col("c_name"),
                     F.lit("acctbal"), F.col("c_acctbal").cast(roles.MONEY).cast("string")).alias("props"),
        F.concat(F.lit("POINT("), x, F.lit(" "), y, F.lit(")")).alias("geom_text"))


@query("dedup_key", f"""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_custkey AS VARCHAR) ELSE md5('{{"acctbal":"' || CAST(c_acctbal AS DECIMAL(18,2))
  || '","fme_tstamp":"' || c_name || '","segment":"' || c_mktsegment || '"}}' || {_POINT}) END dedup_key FROM customer
""")
def dedup_key(t: Tables):
    return _customer_props(t).select(
        "c_custkey", st.dedup_key(F.col("feature_id"), F.col("props"), F.col("geom_text")).alias("dedup_key"))


@query("dedup_key_volatile", f"""
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_custkey AS VARCHAR) ELSE md5('{{"acctbal":"' || CAST(c_acctbal AS DECIMAL(18,2))
  || '","segment":"' || c_mktsegment || '"}}' || {_POINT}) END dedup_key, c_name kept FROM customer
""")
def dedup_key_volatile(t: Tables):
    key = st.dedup_key(F.col("feature_id"), F.col("props"), F.col("geom_text"), ("fme_tstamp",))
    return _customer_props(t).select("c_custkey", key.alias("dedup_key"), F.col("props")["fme_tstamp"].alias("kept"))


@query("dedupe_newest", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) rn
 FROM lineitem) WHERE rn = 1
""")
def dedupe_newest(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    order = [F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]
    return st.newest_per_key(rows, ["l_orderkey", "l_linenumber"], order).drop("l_shipdate")


@query("upsert_features", """
SELECT 'customer' dataset_id, CAST(c_custkey AS VARCHAR) dedup_key, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN upper(c_name) ELSE c_name END AS name,
 CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 2 ELSE 1 END AS version
FROM customer WHERE c_acctbal < 5000 OR c_mktsegment IN ('BUILDING', 'MACHINERY')
""")
def upsert_features(t: Tables):
    base = t.customer.select(
        F.lit("customer").alias("dataset_id"), F.col("c_custkey").cast("string").alias("dedup_key"),
        F.col("c_name").alias("name"), "c_mktsegment", "c_acctbal")
    cols = ["dataset_id", "dedup_key", "name", "version"]
    target = base.where("c_acctbal < 5000").withColumn("version", F.lit(1)).select(*cols)
    batch = base.where("c_mktsegment in ('BUILDING', 'MACHINERY')").withColumn("name", F.upper("name")).withColumn("version", F.lit(2)).select(*cols)
    return st.merge_latest(target, batch, ["dataset_id", "dedup_key"], [F.desc("version")])


@query("upsert_statistics", """
WITH d AS (SELECT event_type dataset_id, strftime(ts, '%Y-%m-%d') period_label, CAST(user_id AS VARCHAR) spatial_key, 'value' metric_name,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) v FROM events GROUP BY 1, 2, 3),
o AS (SELECT *, 'EUR' u FROM d WHERE period_label < '2024-01-20'),
n AS (SELECT *, CASE WHEN dataset_id = 'click' THEN 'USD' END u FROM d WHERE period_label >= '2024-01-10')
SELECT coalesce(n.dataset_id, o.dataset_id) dataset_id, coalesce(n.period_label, o.period_label) period_label, coalesce(n.spatial_key, o.spatial_key) spatial_key,
 coalesce(n.metric_name, o.metric_name) metric_name, coalesce(n.v * 2, o.v) metric_value, coalesce(n.u, o.u) metric_unit
FROM o FULL JOIN n ON o.dataset_id = n.dataset_id AND o.period_label = n.period_label AND o.spatial_key = n.spatial_key
""")
def upsert_statistics(t: Tables):
    keys = ["dataset_id", "period_label", "spatial_key", "metric_name"]
    daily = t.events.groupBy(
        F.col("event_type").alias("dataset_id"), F.date_format("ts", "yyyy-MM-dd").alias("period_label"),
        F.col("user_id").cast("string").alias("spatial_key"), F.lit("value").alias("metric_name"),
    ).agg(F.sum(F.col("value").cast(roles.MONEY)).cast("double").alias("metric_value"))
    old = daily.where("period_label < '2024-01-20'").withColumn("metric_unit", F.lit("EUR"))
    new = daily.where("period_label >= '2024-01-10'").withColumn("metric_value", F.col("metric_value") * 2).withColumn(
        "metric_unit", F.when(F.col("dataset_id") == "click", "USD"))
    return st.merge_statistics(old, new, keys, F.col("metric_value"))


@query("latest_per_site", ctes("live_feed") + """
SELECT site_id, site_name, strftime(measured_at, '%Y-%m-%d %H:%M:%S') measured_at, occupied, total FROM (
 SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY measured_at DESC, event_id DESC) rn FROM live_feed) WHERE rn = 1
""")
def latest_per_site(t: Tables):
    newest = st.newest_per_key(roles.live_feed(t), ["site_id"], [F.desc("measured_at"), F.desc("event_id")])
    return newest.select("site_id", "site_name", F.date_format("measured_at", "yyyy-MM-dd HH:mm:ss").alias("measured_at"), "occupied", "total")


@query("history_append", ctes("live_once") + """
SELECT site_id, strftime(measured_at, '%Y-%m-%d %H:%M:%S.%f') measured_at, max(occupied) occupied FROM live_once GROUP BY 1, 2
""")
def history_append(t: Tables):
    feed = roles.live_feed(t).select("site_id", "measured_at", "occupied")
    # every reading is stored once, although the feed publishes the second half twice
    history = st.newest_per_key(feed.where("measured_at < timestamp_ntz '2024-01-20 00:00:00'"), ["site_id", "measured_at"], [F.desc("occupied")])
    batch = feed.where("measured_at >= timestamp_ntz '2024-01-10 00:00:00'")
    return st.append_absent(history, batch, ["site_id", "measured_at"], "measured_at").select(
        "site_id", F.date_format("measured_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("measured_at"), "occupied")


@query("upsert_counts", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) d, count(*) n, count(*) FILTER (WHERE event_type = 'click') c FROM events GROUP BY 1, 2)
SELECT CAST(user_id AS VARCHAR) counter_id, 'day' count_period, strftime(d, '%Y-%m-%d') period_start, CASE WHEN d >= DATE '2024-01-15' THEN n ELSE c END count_value,
 user_id % 10 <> 0 has_point FROM d WHERE c > 0 OR d >= DATE '2024-01-15'
""")
def upsert_counts(t: Tables):
    uid = F.col("user_id")
    daily = t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("c"))
    lat, lon = F.when(uid % 10 != 0, 51.3).otherwise(0.0), F.lit(12.4)
    point = F.when((lat != 0) & (lon != 0), F.array(lon, lat))

    def rows(df, value):
        return df.select(uid.cast("string").alias("counter_id"), F.lit("day").alias("count_period"),
                         F.date_format("d", "yyyy-MM-dd").alias("period_start"), F.col(value).alias("count_value"), point.alias("point"))

    merged = st.merge_latest(rows(daily.where("c > 0"), "c"), rows(daily.where("d >= date'2024-01-15'"), "n"),
                             ["counter_id", "count_period", "period_start"], [F.desc("count_value")])
    return merged.withColumn("has_point", F.col("point").isNotNull()).drop("point")


@query("upsert_restrictions", ctes("restrictions") + """
SELECT dataset_id, dedup_key, CASE WHEN restriction_type = 'error' THEN 'geändert' ELSE title END title,
 strftime(valid_from, '%Y-%m-%d') valid_from, strftime(valid_until, '%Y-%m-%d') valid_until
FROM restrictions WHERE restriction_type IN ('error', 'click', 'view')
""")
def upsert_restrictions(t: Tables):
    r = roles.restrictions(t)
    batch = r.where("restriction_type = 'error'").withColumn("title", F.lit("geändert"))
    merged = st.merge_latest(r.where("restriction_type in ('error', 'click', 'view')"), batch, ["dataset_id", "dedup_key"], [F.asc("title")])
    return merged.select("dataset_id", "dedup_key", "title", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"),
                         F.date_format("valid_until", "yyyy-MM-dd").alias("valid_until"))


@query("upsert_elections", ctes("exact_results") + """
SELECT election_id, level, gebiet_code, party, zweitstimmen + CASE WHEN year >= 2000 THEN 1 ELSE 0 END zweitstimmen, gueltige_zweit FROM exact_results
""")
def upsert_elections(t: Tables):
    cols = ["election_id", "level", "gebiet_code", "party", "zweitstimmen", "gueltige_zweit", "year"]
    stored = roles.exact_results(t).select(*cols)
    corrected = stored.where("year >= 2000").withColumn("zweitstimmen", F.col("zweitstimmen") + 1)
    return st.merge_latest(stored, corrected, cols[:4], [F.desc("zweitstimmen")]).drop("year")


@query("boundary_snapshot", ctes("boundaries") + """
SELECT boundary_type, code, name, boundary_year FROM boundaries WHERE boundary_type <> 'ortsteil'
UNION ALL SELECT boundary_type, code, upper(name), boundary_year FROM boundaries WHERE boundary_type = 'ortsteil' AND name LIKE '%gear%'
""")
def boundary_snapshot(t: Tables):
    b = settled(roles.boundaries(t).drop("parent_code"), "boundaries")
    fresh = b.where("boundary_type = 'ortsteil' and name like '%gear%'").withColumn("name", F.upper("name"))
    return st.replace_snapshot(b, fresh, ["boundary_type", "boundary_year"], ["boundary_type", "code", "boundary_year"], [F.asc("name")])


@query("stale_sweep", """
SELECT c_mktsegment dataset_id, c_custkey dedup_key, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS version FROM customer
WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 0
""")
def stale_sweep(t: Tables):
    stored = t.customer.select(F.col("c_mktsegment").alias("dataset_id"), F.col("c_custkey").alias("dedup_key"), "c_acctbal", F.lit(1).alias("version"))
    # the new snapshot of one dataset lost its overdrawn accounts; another dataset delivered nothing
    batch = stored.where("(dataset_id = 'BUILDING' and c_acctbal > 0) or (dataset_id = 'MACHINERY' and c_acctbal is null)").withColumn("version", F.lit(2))
    return st.replace_snapshot(stored, batch, ["dataset_id"], ["dataset_id", "dedup_key"], [F.desc("version")]).drop("c_acctbal")


@query("registry_upsert", ctes("registry") + """
SELECT dataset_id, CASE WHEN schedule = 'live' THEN upper(title) ELSE title END title, schedule FROM registry WHERE is_active OR schedule = 'live'
""")
def registry_upsert(t: Tables):
    reg = roles.registry(t).select("dataset_id", "title", "schedule", "is_active")
    batch = reg.where("schedule = 'live'").withColumn("title", F.upper("title"))
    return st.merge_latest(reg.where("is_active"), batch, ["dataset_id"], [F.asc("title")]).drop("is_active")


@query("registry_reconcile", ctes("registry", "families") + """, o AS (SELECT family_id, title FROM families WHERE family_id NOT LIKE 'blue%'),
n AS (SELECT family_id, CASE WHEN family_id LIKE 'hot%' THEN upper(title) ELSE title END title FROM families WHERE family_id NOT LIKE 'cold%')
SELECT coalesce(n.family_id, o.family_id) family_id, CASE WHEN o.family_id IS NULL THEN 'insert' WHEN n.family_id IS NULL THEN 'delete'
  WHEN o.title = n.title THEN 'keep' ELSE 'update' END "action", coalesce(n.title, o.title) title
FROM o FULL JOIN n ON o.family_id = n.family_id
""")
def registry_reconcile(t: Tables):
    fam = roles.families(t)
    config = fam.where("family_id not like 'cold%'").withColumn(
        "title", F.when(F.col("family_id").startswith("hot"), F.upper("title")).otherwise(F.col("title")))
    return st.reconcile(fam.where("family_id not like 'blue%'"), config, ["family_id"])


@query("clear_stale_members", ctes("registry") + """
SELECT dataset_id, title, CASE WHEN schedule = 'nightly' THEN family_id END family_id, CASE WHEN schedule = 'nightly' AND family_id IS NOT NULL THEN family_year END family_year FROM registry
""")
def clear_stale_members(t: Tables):
    reg = roles.registry(t)
    members = reg.where("schedule = 'nightly' and family_id is not null")
    return st.clear_stale_members(reg.select("dataset_id", "title", "family_id", "family_year"), members)


@query("year_backfill", """
SELECT CAST(CASE WHEN l_linestatus = 'O' THEN 1995 + l_partkey % 6 ELSE year(l_shipdate) END AS INTEGER) period_year,
 CASE WHEN l_returnflag = 'A' THEN 'alt' WHEN l_linestatus = 'O' THEN CAST(1995 + l_partkey % 6 AS VARCHAR) ELSE '' END period_label, count(*) n
FROM lineitem GROUP BY 1, 2
""")
def year_backfill(t: Tables):
    rows = t.lineitem.select(
        F.col("l_partkey").cast("string").alias("dataset_id"),
        F.when(F.col("l_linestatus") != "O", F.year("l_shipdate")).cast("int").alias("period_year"),
        F.when(F.col("l_returnflag") == "A", "alt").otherwise("").alias("period_label"))
    fams = roles.registry(t).select("dataset_id", "family_year")
    return st.fill_year(rows, fams, "period_year", "period_label").groupBy("period_year", "period_label").agg(F.count(F.lit(1)).alias("n"))


@query("retention", ctes("runs") + """, m AS (SELECT max(started_at) as_of FROM runs)
SELECT status, count(*) FILTER (WHERE started_at >= as_of - INTERVAL 7 DAY) last_week,
 count(*) FILTER (WHERE status <> 'failed' OR started_at >= as_of - INTERVAL 10 DAY) scoped FROM runs, m GROUP BY 1
""")
def retention(t: Tables):
    r = roles.runs(t)
    as_of = r.agg(F.max("started_at")).scalar()
    week = st.within_retention(r, "started_at", as_of, 7).groupBy("status").agg(F.count(F.lit(1)).alias("last_week"))
    scoped = st.within_retention(r, "started_at", as_of, 10, F.col("status") == "failed").groupBy("status").agg(F.count(F.lit(1)).alias("scoped"))
    return scoped.join(week, "status", "left")


@query("change_log", ctes("runs") + """, p AS (
 SELECT *, lag(rows_total_after) OVER (PARTITION BY dataset_id, target ORDER BY started_at, run_id) prev FROM runs WHERE target IS NOT NULL),
a AS (SELECT *, greatest(0, rows_total_after - coalesce(prev, 0)) added FROM p)
SELECT dataset_id, run_id, target target_table, added rows_added, greatest(0, rows_loaded - added) rows_updated, rows_total_after FROM a
WHERE NOT (added = 0 AND greatest(0, rows_loaded - added) = 0 AND rows_loaded = 0 AND prev IS NOT NULL)
""")
def change_log(t: Tables):
    r = roles.runs(t).where("target is not null")
    logged = st.change_log(r, ["dataset_id", "target"], ["started_at", "run_id"], "day")
    return logged.select("dataset_id", "run_id", F.col("target").alias("target_table"), "rows_added", "rows_updated", "rows_total_after")


@query("run_log", ctes("runs") + """
SELECT dataset_id, status, count(*) n, CAST(sum(run_id % 600) AS BIGINT) duration_s, CAST(sum(rows_extracted) AS BIGINT) extracted, CAST(sum(rows_loaded) AS BIGINT) loaded
FROM runs GROUP BY 1, 2
""")
def run_log(t: Tables):
    logged = st.run_log(roles.runs(t).withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")}))
    return logged.groupBy("dataset_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_s").alias("duration_s"), F.sum("rows_extracted").alias("extracted"),
        F.sum("rows_loaded").alias("loaded"))


@query("dq_guard", ctes("runs") + """
SELECT run_id, dataset_id, 'DQ: raw-only ingest (no core rows)' note FROM runs WHERE rows_extracted > 0 AND rows_loaded = 0 AND target IS NULL
""")
def dq_guard(t: Tables):
    logged = st.run_log(roles.runs(t).withColumns({c: F.col(c).cast("timestamp") for c in ("started_at", "finished_at")}))
    return logged.where("note is not null").select("run_id", "dataset_id", "note")


@query("dq_raw_only", ctes("runs") + """
SELECT dataset_id, count(*) payloads FROM runs WHERE status = 'success' AND dataset_id NOT IN
 (SELECT dataset_id FROM runs WHERE target = 'core.geo_features' AND rows_loaded > 120) GROUP BY 1
""")
def dq_raw_only(t: Tables):
    r = roles.runs(t)
    changes = r.where("target = 'core.geo_features' and rows_loaded > 120")
    return st.without_changes(r.where("status = 'success'"), changes).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("payloads"))


@query("purge", ctes("facts") + """
SELECT spatial_unit, count(*) n FROM facts f WHERE metric_value >= 5 AND dataset_id NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_brand = 'Brand#3') GROUP BY 1
""")
def purge(t: Tables):
    facts = roles.facts(t).withColumn("metric_value", F.when(F.col("metric_value") >= 5, F.col("metric_value")))
    retired = t.part.where("p_brand = 'Brand#3'").select(F.col("p_partkey").cast("string").alias("dataset_id"))
    return st.purge(facts, retired).groupBy("spatial_unit").agg(F.count(F.lit(1)).alias("n"))


@query("payload_summary", """
WITH c AS (SELECT source, count(*) n, len(list(DISTINCT lang)) k FROM documents GROUP BY 1)
SELECT source, n AS count, '{"count":' || n || ',"langs":"<list len=' || k || '>"}' AS payload,
 sha256('{"count":' || n || ',"langs":"<list len=' || k || '>"}') AS checksum FROM c
""")
def payload_summary(t: Tables):
    return st.payload_summary(t.documents, "source", [st.list_marker(F.collect_set("lang")).alias("langs")])


@query("derived_cols", ctes("features") + """
SELECT feature_id, round((6371008.8 * 6371008.8 / 2) * abs(
   radians(xmax - xmin) * (2 + sin(radians(ymin)) + sin(radians(ymin))) + radians(xmin - xmax) * (2 + sin(radians(ymax)) + sin(radians(ymax)))), 0) area_m2
FROM features WHERE geom_type = 'Polygon'
""")
def derived_cols(t: Tables):
    f = roles.features(t).where("geom_type = 'Polygon'")
    return f.select("feature_id", F.round(geo.spherical_area_m2(F.col("coords")), 0).alias("area_m2"))


@query("park_ride_latest", ctes("live_feed") + """
SELECT site_id, site_name, total total_spaces, occupied occupied_spaces, round(round(CASE WHEN total > 0 THEN occupied / total * 100 END, 10), 1) occupancy_pct FROM (
 SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY measured_at DESC, event_id DESC) rn FROM live_feed) WHERE rn = 1
""")
def park_ride_latest(t: Tables):
    newest = st.newest_per_key(roles.live_feed(t), ["site_id"], [F.desc("measured_at"), F.desc("event_id")])
    pct = F.when(F.col("total") > 0, F.col("occupied") / F.col("total") * 100)
    return newest.select("site_id", "site_name", F.col("total").alias("total_spaces"), F.col("occupied").alias("occupied_spaces"),
                         numeric.settled_round(pct, 1).alias("occupancy_pct"))
