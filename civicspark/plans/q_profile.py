"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import profiling as pf
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.plans.roles import ctes


def _rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_NULLED = {"l_tax": "CASE WHEN l_returnflag <> 'N' THEN l_tax END"}


def _describe_sql(expr: str) -> str:
    return (f"count(*) n, count({expr}) non_null, round(1 - count({expr}) / count(*), 4) null_share, min({expr}) \"min\", max({expr}) \"max\", "
            f"round(avg({expr}), 4) mean, round(quantile_cont({expr}, 0.5), 4) \"median\", round(stddev_samp({expr}), 4) \"stddev\"")


@query("profile_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {_describe_sql(_NULLED.get(c, c))} FROM lineitem" for c in _NUMERIC))
def profile_numeric(t: Tables):
    rows = t.lineitem.withColumn("l_tax", F.when(F.col("l_returnflag") != "N", F.col("l_tax"))).select(*_NUMERIC)
    return _rounded(pf.profile_numeric(rows, list(_NUMERIC)), ["null_share", "mean", "median", "stddev"])


_CAT = ("o_orderpriority", "o_orderstatus", "o_custkey")
_CAT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({'CASE WHEN o_orderstatus <> ' + chr(39) + 'P' + chr(39) + ' THEN o_orderpriority END' if c == 'o_orderpriority' else c} AS VARCHAR) v FROM orders"
    for c in _CAT)


def _cat_rows(t: Tables):
    return t.orders.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))).select(*_CAT)


@query("profile_categorical", f"SELECT \"column\", count(*) n, count(v) non_null, count(DISTINCT v) distinct_n FROM ({_CAT_SQL}) GROUP BY 1")
def profile_categorical(t: Tables):
    return pf.profile_categorical(_cat_rows(t), list(_CAT))[0]


@query("profile_top_values", f"""SELECT "column", v AS value, n FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) rn FROM
 (SELECT "column", v, count(*) n FROM ({_CAT_SQL}) WHERE v IS NOT NULL GROUP BY 1, 2)) WHERE rn <= 10""")
def profile_top_values(t: Tables):
    return pf.profile_categorical(_cat_rows(t), list(_CAT))[1]


@query("profile_temporal", ctes("restrictions") + """
SELECT 'valid_from' AS "column", strftime(min(valid_from), '%Y-%m-%d %H:%M:%S') "min", strftime(max(valid_from), '%Y-%m-%d %H:%M:%S') "max" FROM restrictions
UNION ALL SELECT 'valid_until', strftime(min(valid_until), '%Y-%m-%d %H:%M:%S'), strftime(max(valid_until), '%Y-%m-%d %H:%M:%S') FROM restrictions
""")
def profile_temporal(t: Tables):
    got = pf.profile_temporal(roles.restrictions(t), ["valid_from", "valid_until"])
    return got.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min", "max")})


@query("profile_metrics", ctes("facts") + f"""
SELECT metric_name, {_describe_sql('metric_value')}, min(period_year) year_min, max(period_year) year_max FROM facts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 30
""")
def profile_metrics(t: Tables):
    return _rounded(pf.profile_metrics(roles.facts(t)), ["null_share", "mean", "median", "stddev"])


_PLACES = ctes("stats_long") + """, kv AS (SELECT dataset_id, 'spatial_key' AS "column", spatial_key AS v FROM stats_long
 UNION ALL SELECT dataset_id, 'period_label', period_label FROM stats_long)
"""


@query("profile_places", _PLACES + "SELECT dataset_id, \"column\", count(*) n, count(v) non_null, count(DISTINCT v) distinct_n FROM kv GROUP BY 1, 2")
def profile_places(t: Tables):
    return pf.profile_places(roles.stats_long(t))[0]


@query("profile_places_top", _PLACES + """
SELECT dataset_id, "column", v AS value, count(*) n FROM kv WHERE v IS NOT NULL GROUP BY 1, 2, 3
QUALIFY row_number() OVER (PARTITION BY dataset_id, "column" ORDER BY count(*) DESC, v) <= 10
""")
def profile_places_top(t: Tables):
    return pf.profile_places(roles.stats_long(t))[1].select("dataset_id", "column", "value", "n")


@query("profile_shapes", ctes("features") + """
SELECT dataset_id, geom_type, count(*) n, CAST(NULL AS INT) year_min, CAST(NULL AS INT) year_max, CAST(NULL AS BIGINT) distinct_n, FALSE is_total FROM features GROUP BY 1, 2
UNION ALL SELECT dataset_id, NULL, count(*), min(year), max(year), count(DISTINCT geom_type), TRUE FROM features GROUP BY 1
""")
def profile_shapes(t: Tables):
    return pf.profile_shapes(roles.features(t))


_PROPS = ctes("features") + """, kv AS (SELECT feature_id, 'acctbal' AS key, json_extract_string(properties, '$.acctbal') v FROM features
 UNION ALL SELECT feature_id, 'segment', json_extract_string(properties, '$.segment') FROM features WHERE dataset_id = 'customer')
"""


@query("profile_props", _PROPS + f"""
SELECT key, count(*) n, count(v) non_null, round(1 - count(v) / count(*), 4) null_share, min(CAST(v AS DOUBLE)) "min", max(CAST(v AS DOUBLE)) "max", round(avg(CAST(v AS DOUBLE)), 4) mean,
 round(quantile_cont(CAST(v AS DOUBLE), 0.5), 4) "median", round(stddev_samp(CAST(v AS DOUBLE)), 4) "stddev" FROM kv WHERE key = 'acctbal' GROUP BY 1
""")
def profile_props(t: Tables):
    feats = roles.features(t)
    numeric, _ = pf.profile_properties(feats, pf.property_keys(feats, sample=None))
    return _rounded(numeric, ["null_share", "mean", "median", "stddev"])


@query("profile_props_top", _PROPS + """
SELECT key, v AS value, count(*) n FROM kv WHERE key = 'segment' GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 10
""")
def profile_props_top(t: Tables):
    feats = roles.features(t)
    return pf.profile_properties(feats, pf.property_keys(feats, sample=None))[1]


@query("property_keys", ctes("features") + """, s AS (SELECT * FROM features WHERE properties IS NOT NULL)
SELECT 'acctbal' AS key, count(*) n, count(*) non_null, count(*) numeric_n, TRUE is_numeric FROM s
UNION ALL SELECT 'segment', count(*), count(*), 0, FALSE FROM s WHERE dataset_id = 'customer'
""")
def property_keys(t: Tables):
    return pf.property_keys(roles.features(t))


@query("histogram", ctes("facts") + """, v AS (SELECT spatial_unit, metric_value v FROM facts UNION ALL SELECT 'konstant', CAST(7 AS DOUBLE) FROM facts),
s AS (SELECT spatial_unit, min(v) lo, max(v) hi FROM v GROUP BY 1),
c AS (SELECT spatial_unit, CASE WHEN hi > lo THEN least(CAST(floor((v - lo) / (hi - lo) * 20) AS INTEGER), 19) ELSE 0 END bucket, count(*) n FROM v JOIN s USING (spatial_unit) GROUP BY 1, 2),
f AS (SELECT spatial_unit, lo, hi, CAST(unnest(range(0, CASE WHEN hi > lo THEN 20 ELSE 1 END)) AS INTEGER) bucket FROM s)
SELECT f.spatial_unit, f.bucket, round(lo + f.bucket * (hi - lo) / 20, 4) lo, round(CASE WHEN hi > lo THEN lo + (f.bucket + 1) * (hi - lo) / 20 ELSE hi END, 4) hi, coalesce(n, 0) n
FROM f LEFT JOIN c USING (spatial_unit, bucket)
""")
def histogram(t: Tables):
    facts = roles.facts(t).select("spatial_unit", "metric_value")
    both = facts.unionByName(facts.select(F.lit("konstant").alias("spatial_unit"), F.lit(7.0).alias("metric_value")))
    return _rounded(pf.histogram(both, ["spatial_unit"], "metric_value"), ["lo", "hi"])


@query("exact_median", """
SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 4) "median" FROM lineitem GROUP BY 1
""")
def exact_median(t: Tables):
    from civicspark.functions.numeric import exact_median as median

    return _rounded(median(t.lineitem, ["l_suppkey"], "l_extendedprice"), ["median"])


# --- dataset statistics ----------------------------------------------------------------------------------

@query("stats_metric", ctes("facts") + """
SELECT metric_name, count(*) n, min(metric_value) "min", max(metric_value) "max", round(avg(metric_value), 4) "avg", min(period_year) year_min, max(period_year) year_max
FROM facts GROUP BY 1 ORDER BY n DESC, 1 LIMIT 50
""")
def stats_metric(t: Tables):
    return _rounded(pf.metric_stats(roles.facts(t)), ["avg"])


@query("stats_head", ctes("facts") + "SELECT count(*) n, count(DISTINCT spatial_key) AS keys, count(DISTINCT metric_name) metrics FROM facts")
def stats_head(t: Tables):
    return pf.metric_head(roles.facts(t))


@query("stats_feature_type", ctes("features") + """
SELECT feature_type, count(*) n, min(year) first_seen, max(year) last_seen FROM features GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20
""")
def stats_feature_type(t: Tables):
    return pf.feature_type_stats(roles.features(t), "year")


@query("stats_restrictions", ctes("restrictions") + """
SELECT restriction_type, count(*) n, count(*) FILTER (WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-15') AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-15')) active
FROM restrictions GROUP BY 1
""")
def stats_restrictions(t: Tables):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    active = (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))
    return pf.restriction_stats(roles.restrictions(t), active)


@query("stats_site", ctes("live_once") + """
SELECT site_id, count(*) n, round(avg(occupied / total * 100), 4) avg_pct, round(max(occupied / total * 100), 4) max_pct FROM live_once GROUP BY 1 ORDER BY n DESC, site_id LIMIT 30
""")
def stats_site(t: Tables):
    feed = t.events.select(F.col("user_id").cast("string").alias("site_id"), F.lit(roles.CAPACITY).alias("total"), F.col("value").alias("occupied"))
    return _rounded(pf.site_stats(feed), ["avg_pct", "max_pct"])


def _counts(t: Tables):
    return t.events.select(F.col("user_id").cast("string").alias("counter_id"), F.col("ts").alias("period_start"), F.floor("value").alias("count_value"))


@query("stats_counter", """
SELECT CAST(user_id AS VARCHAR) counter_id, count(*) n, CAST(sum(floor(value)) AS BIGINT) total, round(avg(floor(value)), 4) mean FROM events GROUP BY 1 ORDER BY total DESC, 1 LIMIT 30
""")
def stats_counter(t: Tables):
    return _rounded(pf.counter_stats(_counts(t)), ["mean"])


@query("counter_daily", """
SELECT CAST(user_id AS VARCHAR) counter_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(floor(value)) AS BIGINT) total, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_seen
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 365 DAY GROUP BY 1, 2
""")
def counter_daily(t: Tables):
    c = _counts(t)
    daily = pf.counter_daily(c, c.agg(F.max("period_start")).scalar())
    return daily.select("counter_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "total", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("counter_series", """
WITH d AS (SELECT CAST(user_id AS VARCHAR) counter_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(floor(value)) AS BIGINT) total FROM events
 WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1, 2)
SELECT counter_id, string_agg(day || '=' || total, '|' ORDER BY day) series FROM d GROUP BY 1
""")
def counter_series(t: Tables):
    c = _counts(t)
    daily = pf.counter_daily(c, c.agg(F.max("period_start")).scalar(), 7)
    shown = F.array_join(F.transform("series", lambda e: F.concat(F.date_format(e["day"], "yyyy-MM-dd"), F.lit("="), e["total"].cast("string"))), "|")
    return pf.counter_series(daily).select("counter_id", shown.alias("series"))
