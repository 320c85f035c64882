"""Reshape and normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import geo, text as tx
from civicspark.operators import reshape as rs
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.plans.roles import ctes

YEARS = range(1995, 2002)


def _pick(*pairs, otherwise=None):
    """when-chain over (condition, value) pairs."""
    chain = None
    for cond, value in pairs:
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


@query("melt_values", """
WITH s AS (SELECT l_suppkey k, l_returnflag f, CAST(year(l_shipdate) AS INTEGER) y, CAST(sum(l_quantity) AS BIGINT) v
  FROM lineitem GROUP BY 1, 2, 3),
named AS (SELECT *, CASE f WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END row_no,
  CASE WHEN f = 'R' THEN 'Lieferant ' || k || ' · R' ELSE 'Lieferant ' || k END metric_name FROM s)
SELECT CAST(y AS VARCHAR) AS period, metric_name, CAST(arg_max(v, row_no) AS VARCHAR) AS value,
  CASE WHEN metric_name LIKE '%· R' THEN 'Stück' ELSE 'kg' END unit FROM named GROUP BY 1, 2, 4
""")
def melt_values(t: Tables):
    flag = F.col("l_returnflag")
    wide = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(*[
        F.sum(F.when(F.year("l_shipdate") == y, F.col("l_quantity"))).cast("bigint").cast("string").alias(str(y))
        for y in YEARS
    ]).select(
        _pick((flag == "A", 0), (flag == "N", 1), otherwise=2).alias("row_no"),
        F.concat(F.lit("K"), F.col("l_suppkey").cast("string")).alias("Kennziffer"), F.lit("Bestand").alias("Merkmal_1"),
        F.concat(F.lit("Lieferant "), F.col("l_suppkey").cast("string")).alias("Merkmal_2"),
        F.when(flag == "R", " R ").otherwise("").alias("Merkmal_3"), F.lit("  ").alias("Merkmal_4"),
        _pick((flag == "A", ""), (flag == "N", "kg"), otherwise="Stück").alias("Einheit"),
        *[F.coalesce(F.col(f"`{y}`"), F.lit("")).alias(str(y)) for y in YEARS])
    return rs.melt_values(wide, "row_no")


@query("melt_areas", """
SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, 'Gebiet ' || c_nationkey AS area, o_orderpriority metric_name,
  CAST(count(*) AS VARCHAR) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
""")
def melt_areas(t: Tables):
    per_customer = t.orders.groupBy("o_custkey", "o_orderpriority").agg(
        *[F.count_if(F.year("o_orderdate") == y).alias(str(y)) for y in YEARS])
    wide = per_customer.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "c_nationkey", "o_orderpriority").agg(*[F.sum(F.col(f"`{y}`")).alias(str(y)) for y in YEARS])
    frame = wide.select(
        F.lit(1).alias("row_no"), F.concat(F.lit(" Gebiet "), F.col("c_nationkey").cast("string")).alias("Gebiet"),
        F.col("o_orderpriority").alias("Sachmerkmal"),
        *[F.nullif(F.col(f"`{y}`").cast("string"), F.lit("0")).alias(str(y)) for y in YEARS])
    return rs.melt_areas(frame, "row_no")


@query("melt_json_long", """
WITH n AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS period, CASE WHEN event_type = 'view' THEN 'k' || user_id ELSE event_type || ' · Platz ' || user_id END metric_name,
  CASE event_type WHEN 'error' THEN 'x' ELSE CAST(event_id AS VARCHAR) END v, CASE WHEN event_type = 'click' THEN 'Stück' END u FROM events)
SELECT period, metric_name, arg_max(v, event_id) AS value, max(u) AS unit FROM n WHERE v <> 'x' GROUP BY 1, 2
""")
def melt_json_long(t: Tables):
    kind = F.col("event_type")
    rows = t.events.select(
        "event_id", F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("name"),
        F.when(kind != "view", kind).otherwise("").alias("merkmal_2"),
        F.when(kind != "view", F.concat(F.lit("Platz "), F.col("user_id").cast("string"))).alias("merkmal_3"),
        F.lit("").alias("merkmal_4"), F.date_format("ts", "yyyy-MM-dd").alias("jahr"),
        F.when(kind == "error", "x").otherwise(F.col("event_id").cast("string")).alias("wert"),
        F.when(kind == "click", "Stück").alias("einheit"))
    return rs.melt_json_long(rows, "event_id")


def _messy_lines(t: Tables):
    flag, key = F.col("l_returnflag"), F.col("l_suppkey").cast("string")
    return t.lineitem.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Datum"),
        F.when(flag == "A", F.concat(F.lit("OT "), key)).otherwise("").alias("Ortsteil"),
        F.when(flag != "N", F.concat(F.lit("SB "), key)).alias("Stadtbezirk"),
        F.replace(F.col("l_quantity").cast("decimal(10,1)").cast("string"), F.lit("."), F.lit(",")).alias("Menge"),
        F.col("l_extendedprice").cast(roles.MONEY).cast("string").alias("Preis"),
        F.when(F.col("l_linestatus") == "O", "offen").otherwise("1e2").alias("Stand"),
        F.col("l_linenumber").alias("ignoriert"))


@query("generic_to_long", """
WITH m AS (SELECT CAST(year(l_shipdate) AS INTEGER) period_year, CASE l_returnflag WHEN 'A' THEN 'ortsteil' WHEN 'R' THEN 'stadtbezirk' ELSE 'city' END spatial_unit,
  CASE l_returnflag WHEN 'A' THEN 'OT ' || l_suppkey WHEN 'R' THEN 'SB ' || l_suppkey ELSE 'Leipzig' END spatial_key,
  l_quantity q, l_extendedprice p, l_linestatus s FROM lineitem)
SELECT period_year, spatial_unit, spatial_key, 'Menge' metric_name, count(*) n, CAST(sum(CAST(q AS DECIMAL(18,2))) AS DOUBLE) total FROM m GROUP BY 1, 2, 3
UNION ALL SELECT period_year, spatial_unit, spatial_key, 'Preis', count(*), CAST(sum(CAST(p AS DECIMAL(18,2))) AS DOUBLE) FROM m GROUP BY 1, 2, 3
UNION ALL SELECT period_year, spatial_unit, spatial_key, 'Stand', count(*), CAST(count(*) * 100 AS DOUBLE) FROM m WHERE s <> 'O' GROUP BY 1, 2, 3
""")
def generic_to_long(t: Tables):
    long = rs.generic_to_long(_messy_lines(t), F.lit("d"), skip=["ignoriert"])
    return long.groupBy("period_year", "spatial_unit", "spatial_key", "metric_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("metric_value").cast(roles.MONEY)).cast("double").alias("total"))


@query("spatial_detect", """
SELECT CASE l_returnflag WHEN 'A' THEN 'ortsteil' WHEN 'R' THEN 'stadtbezirk' ELSE 'city' END spatial_unit,
  CASE l_returnflag WHEN 'A' THEN 'OT ' || l_suppkey WHEN 'R' THEN 'SB ' || l_suppkey ELSE 'Leipzig' END spatial_key, count(*) n
FROM lineitem GROUP BY 1, 2
""")
def spatial_detect(t: Tables):
    lines = _messy_lines(t)
    unit, key = rs.detect_area(lines.columns)
    return lines.groupBy(unit.alias("spatial_unit"), key.alias("spatial_key")).agg(F.count(F.lit(1)).alias("n"))


@query("period_parse", """
WITH p AS (SELECT o_orderkey % 5 w, CAST(year(o_orderdate) AS INTEGER) y, CAST(quarter(o_orderdate) AS INTEGER) q FROM orders)
SELECT CASE w WHEN 0 THEN q || '.Qu. ' || y WHEN 1 THEN y || '/' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0')
    WHEN 2 THEN 'Jan. ' || y WHEN 3 THEN CAST(y AS VARCHAR) ELSE '2001' END period_label,
  CASE WHEN w = 4 THEN 2001 ELSE y END period_year, CASE WHEN w = 0 THEN q END period_quarter,
  CASE WHEN w = 2 THEN 1 END period_month, count(*) n FROM p GROUP BY 1, 2, 3, 4
""")
def period_parse(t: Tables):
    y, way = F.year("o_orderdate"), F.col("o_orderkey") % 5
    ys = y.cast("string")
    label = _pick(
        (way == 0, F.concat(F.quarter("o_orderdate").cast("string"), F.lit(".Qu. "), ys)),
        (way == 1, F.concat(ys, F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))),
        (way == 2, F.concat(F.lit("Jan. "), ys)), (way == 3, ys), otherwise="unbekannt")
    names = ("period_label", "period_year", "period_quarter", "period_month")
    parsed = rs.parse_period(label, F.lit(2001))
    return t.orders.select(*[c.alias(n) for c, n in zip(parsed, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


@query("num_parse", """
SELECT l_linenumber, count(*) n, count(CASE WHEN l_linenumber IN (1, 2, 6, 7) THEN 1 END) parsed,
  CAST(sum(CASE WHEN l_linenumber IN (1, 2) THEN CAST(l_extendedprice AS DECIMAL(18,2)) WHEN l_linenumber = 6 THEN -CAST(l_quantity AS DECIMAL(18,2))
    WHEN l_linenumber = 7 THEN 50 END) AS DOUBLE) total,
  CAST(sum(CASE WHEN l_linenumber IN (1, 2) THEN CAST(trunc(l_extendedprice) AS BIGINT) WHEN l_linenumber = 6 THEN -CAST(trunc(l_quantity) AS BIGINT)
    WHEN l_linenumber = 7 THEN 50 END) AS BIGINT) whole
FROM lineitem GROUP BY 1
""")
def num_parse(t: Tables):
    n, price = F.col("l_linenumber"), F.col("l_extendedprice").cast(roles.MONEY).cast("string")
    text = _pick((n == 1, price), (n == 2, F.concat(F.lit(" "), F.replace(price, F.lit("."), F.lit(",")), F.lit(" "))),
                 (n == 3, "5d"), (n == 4, "nan"), (n == 5, "1_000"),
                 (n == 6, F.concat(F.lit("-"), F.col("l_quantity").cast("decimal(10,1)").cast("string"))), otherwise="5e1")
    return t.lineitem.select("l_linenumber", tx.parse_number(text).alias("v"), tx.parse_int(text).alias("w")).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("parsed"), F.sum(F.col("v").cast(roles.MONEY)).cast("double").alias("total"),
        F.sum("w").alias("whole"))


@query("prop_alias", """
SELECT CASE event_type WHEN 'click' THEN 'c' || user_id WHEN 'view' THEN 'v' || user_id WHEN 'error' THEN 'e' || user_id END feature_id,
  count(*) n FROM events GROUP BY 1
""")
def prop_alias(t: Tables):
    kind, uid = F.col("event_type"), F.col("user_id").cast("string")
    value = lambda which, mark: F.when(kind == which, F.concat(F.lit(mark), uid, F.lit(" ")))
    props = F.create_map(F.lit("id"), F.coalesce(value("click", "c"), F.lit("  ")), F.lit("ID"), value("view", " v"),
                         F.lit("objectid"), value("error", "e"), F.lit("rest"), uid)
    return t.events.select(tx.first_present(props, ["id", "ID", "objectid"]).alias("feature_id")).groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("election_unpivot", ctes("election_all") + """, areas AS (SELECT DISTINCT year, gebiet_code, gebiet_name, wahlberechtigte, waehler, gueltige_zweit FROM election_all)
SELECT a.year, a.gebiet_code, a.gebiet_name, p.party, p.party_index, e.zweitstimmen, a.wahlberechtigte, a.waehler, a.gueltige_zweit, a.waehler - a.gueltige_zweit ungueltige_zweit
FROM areas a CROSS JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5)) p(party, party_index)
LEFT JOIN election_all e ON e.year = a.year AND e.gebiet_code = a.gebiet_code AND e.party = p.party
""")
def election_unpivot(t: Tables):
    parties = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = roles.election_results(t).groupBy("year", "gebiet_code", "gebiet_name").agg(
        F.max("wahlberechtigte").cast("string").alias("A"), F.max("waehler").cast("string").alias("B"),
        (F.max("waehler") - F.max("gueltige_zweit")).cast("string").alias("C"), F.max("gueltige_zweit").cast("string").alias("D"),
        *[F.max(F.when(F.col("party") == p, F.col("zweitstimmen"))).cast("string").alias(f"D{i}") for i, p in enumerate(parties, 1)],
    ).withColumnsRenamed({"gebiet_code": "gebiet-nr", "gebiet_name": "gebiet-name"})
    # one file per election: the year is a column here, so the unpivot keeps it through the name
    tagged = wide.withColumn("gebiet-name", F.concat(F.col("year").cast("string"), F.lit("|"), F.col("gebiet-name")))
    long = rs.election_unpivot(tagged, parties, "single", "ortsteil")
    return long.select(
        F.substring_index("gebiet_name", "|", 1).cast("int").alias("year"), "gebiet_code",
        F.substring_index("gebiet_name", "|", -1).alias("gebiet_name"), "party", "party_index", "zweitstimmen",
        "wahlberechtigte", "waehler", "gueltige_zweit", "ungueltige_zweit")


_HINTS = """, members AS (SELECT dataset_id, family_id, family_year FROM registry WHERE family_id IS NOT NULL),
hints AS (SELECT dataset_id, 'ortsteil' hint_unit, 'gebiet-nr' hint_key_column, CASE WHEN p_size % 2 = 0 THEN 2020 END hint_year
  FROM registry WHERE schedule = 'live')
"""


@query("contract_stamp", ctes("registry") + _HINTS + """
SELECT r.dataset_id, m.family_id, m.family_year, hint_unit, hint_key_column, CAST(coalesce(hint_year, m.family_year) AS INTEGER) effective_year
FROM registry r LEFT JOIN members m USING (dataset_id) LEFT JOIN hints h USING (dataset_id)
""")
def contract_stamp(t: Tables):
    reg = roles.registry(t)
    members = reg.where("family_id is not null").select("dataset_id", "family_id", "family_year")
    hints = reg.where("schedule = 'live'").select(
        "dataset_id", F.lit("ortsteil").alias("hint_unit"), F.lit("gebiet-nr").alias("hint_key_column"),
        F.when(F.col("p_size") % 2 == 0, 2020).alias("hint_year"))
    return rs.stamp_contracts(reg.select("dataset_id"), members, hints).select(
        "dataset_id", "family_id", "family_year", "hint_unit", "hint_key_column", "effective_year")


@query("route_target", """
WITH c AS (SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'Radverkehr-Anzahl' WHEN 1 THEN 'dauerzaehlstellen' WHEN 2 THEN 'Baustellen-polygon'
    WHEN 3 THEN 'verkehrsraum-info' ELSE replace(p_name, ' ', '-') END AS name,
  CASE WHEN p_size % 10 = 0 THEN '' WHEN p_size % 10 = 1 THEN 'https://x/pr_anlage_belegung_lastrecord' WHEN p_size % 10 = 2 THEN 'https://statistik.leipzig.de/opendata/api/v1'
    WHEN p_size % 10 = 3 THEN 'https://x/pr_anlage_belegung_zeitreihe' ELSE 'https://x/f' END url,
  CASE p_type WHEN 'ECONOMY' THEN 'csv' WHEN 'LARGE' THEN 'GeoJSON' WHEN 'MEDIUM' THEN 'JSON' WHEN 'PROMO' THEN 'XML' WHEN 'SMALL' THEN 'ZIP' ELSE 'PDF' END fmt,
  p_brand = 'Brand#1' elec FROM part),
r AS (SELECT *, upper(fmt) f, lower(name) n, upper(fmt) = 'GEOJSON' g, (lower(name) LIKE '%radverkehr%' OR lower(name) LIKE '%dauerzaehlstell%') b FROM c)
SELECT CAST(p_partkey AS VARCHAR) dataset_id,
 CASE WHEN url = '' OR f = 'PDF' THEN 'skip' WHEN elec THEN 'election_results' WHEN url LIKE '%pr_anlage%' AND g THEN 'geo_features'
  WHEN b AND g THEN 'geo_features' WHEN b THEN 'bicycle_counts' WHEN (n LIKE '%verkehrsraum%' OR n LIKE '%baustell%') AND g THEN 'traffic_restrictions'
  WHEN f = 'ZIP' THEN 'by_content' WHEN f = 'XML' THEN 'statistics' WHEN g THEN 'geo_features' WHEN f = 'JSON' AND url LIKE '%statistik%' THEN 'statistics'
  WHEN f = 'CSV' THEN 'statistics' ELSE 'summary' END target,
 CASE WHEN url = '' THEN 'no resource URL' WHEN f = 'PDF' THEN 'unsupported format PDF' WHEN elec THEN NULL WHEN url LIKE '%lastrecord' AND g THEN 'park_ride'
  WHEN url LIKE '%zeitreihe' AND g THEN 'park_ride_history' WHEN b AND g THEN CASE WHEN n LIKE '%anzahl%' OR url LIKE '%zeitreihe%' THEN 'bicycle_count' ELSE 'bicycle_station' END
  WHEN b THEN NULL WHEN (n LIKE '%verkehrsraum%' OR n LIKE '%baustell%') AND g THEN CASE WHEN n LIKE '%polygon%' THEN 'polygon' ELSE 'point' END
  WHEN f IN ('ZIP', 'XML') THEN NULL WHEN g THEN name END detail
FROM r
""")
def route_target(t: Tables):
    size, kind = F.col("p_size"), F.col("p_type")
    contracts = t.part.select(
        F.col("p_partkey").cast("string").alias("dataset_id"),
        _pick((size % 8 == 0, "Radverkehr-Anzahl"), (size % 8 == 1, "dauerzaehlstellen"), (size % 8 == 2, "Baustellen-polygon"),
              (size % 8 == 3, "verkehrsraum-info"), otherwise=F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"),
        _pick((size % 10 == 0, ""), (size % 10 == 1, "https://x/pr_anlage_belegung_lastrecord"),
              (size % 10 == 2, "https://statistik.leipzig.de/opendata/api/v1"), (size % 10 == 3, "https://x/pr_anlage_belegung_zeitreihe"),
              otherwise="https://x/f").alias("url"),
        _pick((kind == "ECONOMY", "csv"), (kind == "LARGE", "GeoJSON"), (kind == "MEDIUM", "JSON"), (kind == "PROMO", "XML"),
              (kind == "SMALL", "ZIP"), otherwise="PDF").alias("format"),
        (F.col("p_brand") == "Brand#1").alias("elec"))
    return rs.route_target(contracts, F.col("elec")).select("dataset_id", "target", "detail")


@query("change_detect", """
WITH has AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1)
SELECT CAST(p_partkey AS VARCHAR) dataset_id, CASE WHEN p_size <= 10 THEN 'new' WHEN p_size > 40 THEN 'changed'
  WHEN p_brand = 'Brand#2' AND l_partkey IS NULL THEN 'reload' ELSE 'unchanged' END status
FROM part LEFT JOIN has ON l_partkey = p_partkey
""")
def change_detect(t: Tables):
    tag = F.md5(F.concat("p_name", F.col("p_size").cast("string")))
    key = F.col("p_partkey").cast("string").alias("dataset_id")
    manifest = t.part.select(key, tag.alias("etag"), (F.col("p_brand") == "Brand#2").alias("forced"))
    stored = t.part.where("p_size > 10").select(key, F.when(F.col("p_size") > 40, "old").otherwise(tag).alias("etag"))
    loaded = t.lineitem.where("l_returnflag = 'A' and l_linenumber = 1").select(F.col("l_partkey").cast("string").alias("dataset_id"))
    return rs.change_status(manifest, stored, loaded, F.col("forced")).select("dataset_id", "status")


@query("norm_name", r"""
SELECT doc_id, md5(lower(strip_accents(regexp_replace(replace(text, 'ß', 'ss'), '\s+', ' ', 'g')))) digest FROM documents
""")
def norm_name(t: Tables):
    return t.documents.select("doc_id", F.md5(tx.norm_name(F.col("text"))).alias("digest"))


@query("slugify", """
WITH s AS (SELECT doc_id, trim(regexp_replace(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'),
  '[^a-z0-9]+', '-', 'g'), '-') slug FROM documents)
SELECT doc_id, CASE WHEN length(slug) > 64 THEN left(slug, 55) || '-' || left(md5(slug), 8) ELSE slug END slug FROM s
""")
def slugify(t: Tables):
    return t.documents.select("doc_id", tx.slugify(F.col("text")).alias("slug"))


@query("title_base_year", """
WITH x AS (SELECT p_partkey, p_name n, 1995 + p_partkey % 6 y FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN n || ' anteil' WHEN 1 THEN n WHEN 2 THEN 'vornamenstatistik ' || n ELSE n || ' ohne jahr' END AS base,
 CASE WHEN p_partkey % 4 < 3 THEN CAST(y AS INTEGER) END AS year FROM x
""")
def title_base_year(t: Tables):
    y, way = (1995 + F.col("p_partkey") % 6), F.col("p_partkey") % 4
    ys = y.cast("string")
    title = _pick((way == 0, F.concat(F.initcap("p_name"), F.lit(" "), ys, F.lit(" - Anteil"))),
                  (way == 1, F.concat("p_name", F.lit(" "), ys, F.lit(" / "), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))),
                  (way == 2, F.concat(F.lit("Vornamensstatistik: "), F.upper("p_name"), F.lit(", "), ys)),
                  otherwise=F.concat("p_name", F.lit(" – ohne Jahr")))
    return t.part.select("p_partkey", tx.title_base(title).alias("base"), tx.title_year(title).alias("year"))


@query("indicator_normalize", """
SELECT p_partkey, CASE p_size % 5 WHEN 3 THEN p_name || ' in ' || repeat('sehr ', 6) || 'lang' ELSE p_name END canonical,
 CASE p_size % 5 WHEN 0 THEN '%' WHEN 1 THEN 'je 1.000 Einwohner' WHEN 2 THEN 'Tsd. Euro' END unit FROM part
""")
def indicator_normalize(t: Tables):
    way = F.col("p_size") % 5
    name = _pick((way == 0, F.concat("p_name", F.lit("  in %"))), (way == 1, F.concat("p_name", F.lit(", je 1.000 Einwohner"))),
                 (way == 2, F.concat(F.lit(" "), "p_name", F.lit(" IN Tsd. Euro"))),
                 (way == 3, F.concat("p_name", F.lit(" in sehr sehr sehr sehr sehr sehr lang"))), otherwise=F.col("p_name"))
    canonical, unit = tx.indicator_parts(name)
    return t.part.select("p_partkey", canonical.alias("canonical"), unit.alias("unit"))


@query("geom_force2d_multi", ctes("features") + """
SELECT 'Multi' || geom_type AS geom_type, count(*) n, CAST(sum(vertices) AS BIGINT) vertices, CAST(sum(vertices * 2) AS BIGINT) numbers
FROM features WHERE geom_type = 'Polygon' GROUP BY 1
""")
def geom_force2d_multi(t: Tables):
    f = roles.features(t).where("geom_type = 'Polygon'")
    raised = geo.map_points(F.col("coords"), lambda p: F.concat(p, F.array(F.lit(113.0))))
    flat = f.select(geo.multi_type(F.col("geom_type")).alias("geom_type"), geo.force_2d(raised).alias("coords"))
    return flat.groupBy("geom_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(geo.point_count(F.col("coords"))).alias("vertices"),
        F.sum(F.size(F.flatten(F.flatten(F.flatten("coords"))))).alias("numbers"))
