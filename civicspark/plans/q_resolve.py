"""Entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import text as tx
from civicspark.operators import resolve as rv
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.plans.roles import ctes

_TRIGRAMS = """tri AS (SELECT s, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(s), '[^\\pL\\pN]+'), lambda w: w <> ''),
   lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) g
 FROM (SELECT norm s FROM keys_n UNION SELECT norm FROM names_n))"""
_NORM = r"lower(strip_accents(regexp_replace(replace(coalesce({0}, ''), 'ß', 'ss'), '\s+', ' ', 'g')))"
_NAMED = (
    ", keys_n AS (SELECT DISTINCT unit, raw, " + _NORM.format("raw") + " AS norm FROM raw_keys),\n"
    "names_n AS (SELECT DISTINCT boundary_type unit, code, " + _NORM.format("name") + " AS norm FROM boundaries),\n" + _TRIGRAMS
    + """,
pairs AS (SELECT k.unit, k.norm left_name, b.norm right_name, len(list_intersect(x.g, y.g)) / len(list_distinct(x.g || y.g)) sim
 FROM (SELECT DISTINCT unit, norm FROM keys_n) k JOIN (SELECT DISTINCT unit, norm FROM names_n) b ON k.unit = b.unit
 JOIN tri x ON x.s = k.norm JOIN tri y ON y.s = b.norm)
""")
_FOREIGN = ", foreign_n AS (SELECT k.unit, k.raw FROM keys_n k WHERE EXISTS (SELECT 1 FROM names_n n WHERE n.unit <> k.unit AND n.norm = k.norm))\n"
_ALIASES = ", aliases AS (SELECT unit unit_type, alias, min(code) code FROM (SELECT unit, norm alias, code FROM names_n UNION ALL SELECT unit, " \
    "coalesce(nullif(ltrim(code, '0'), ''), '0'), code FROM names_n WHERE regexp_matches(code, '^[0-9]+$')) WHERE alias <> '' GROUP BY 1, 2)\n"
_RESOLVED = r""", resolved AS (
 SELECT unit, raw, code, prio, sim FROM (SELECT *, row_number() OVER (PARTITION BY unit, raw ORDER BY prio, sim DESC, code) rn FROM (
  SELECT k.unit, k.raw, a.code, 1 prio, CAST(1.0 AS DOUBLE) sim FROM keys_n k JOIN aliases a ON a.unit_type = k.unit AND a.alias = k.norm
  UNION ALL SELECT k.unit, k.raw, n.code, 2, 1.0 FROM keys_n k JOIN names_n n ON n.unit = k.unit AND n.code = trim(k.raw)
  UNION ALL SELECT k.unit, k.raw, n.code, 3, 1.0 FROM keys_n k JOIN names_n n ON n.unit = k.unit AND n.code = nullif(regexp_extract(trim(k.raw), '^(\d{1,4})\b', 1), '')
  UNION ALL SELECT k.unit, k.raw, n.code, 4, p.sim FROM keys_n k JOIN pairs p ON p.unit = k.unit AND p.left_name = k.norm AND p.sim > 0.45
   JOIN names_n n ON n.unit = p.unit AND n.norm = p.right_name WHERE (k.unit, k.raw) NOT IN (SELECT unit, raw FROM foreign_n))) WHERE rn = 1)
"""
_BASE = ctes("raw_keys") + _NAMED


@query("trigram_join", _BASE + "SELECT unit, left_name, right_name, round(sim, 4) sim FROM pairs WHERE sim > 0.45")
def trigram_join(t: Tables):
    left = roles.raw_keys(t).select("unit", tx.norm_name(F.col("raw")).alias("left_name"))
    right = roles.boundaries(t).select(F.col("boundary_type").alias("unit"), tx.norm_name(F.col("name")).alias("right_name"))
    return rv.trigram_join(left, right).select("unit", "left_name", "right_name", F.round("sim", 4).alias("sim"))


@query("resolve_spatial", _BASE + _FOREIGN + _ALIASES + _RESOLVED + """
SELECT k.unit, k.raw, r.code, r.prio, round(r.sim, 4) sim FROM keys_n k LEFT JOIN resolved r ON r.unit = k.unit AND r.raw = k.raw
""")
def resolve_spatial(t: Tables):
    b = roles.boundaries(t)
    got = rv.resolve_keys(roles.raw_keys(t), b, rv.derive_aliases(b))
    return got.select("unit", "raw", "code", "prio", F.round("sim", 4).alias("sim"))


@query("foreign_level_guard", _BASE + _FOREIGN + """
SELECT p_partkey, r.raw, (r.unit, r.raw) IN (SELECT unit, raw FROM foreign_n) is_foreign FROM raw_keys r
""")
def foreign_level_guard(t: Tables):
    return rv.foreign_level(roles.raw_keys(t), roles.boundaries(t), "unit", "raw").select("p_partkey", "raw", "is_foreign")


@query("foreign_level_repair", _BASE + _FOREIGN + """
SELECT p_partkey, r.raw spatial_key, CASE WHEN (r.unit, r.raw) NOT IN (SELECT unit, raw FROM foreign_n) THEN '0001' END spatial_code FROM raw_keys r
""")
def foreign_level_repair(t: Tables):
    stats = roles.raw_keys(t).select("p_partkey", F.col("unit").alias("spatial_unit"), F.col("raw").alias("spatial_key"), F.lit("0001").alias("spatial_code"))
    return rv.repair_foreign(stats, roles.boundaries(t)).select("p_partkey", "spatial_key", "spatial_code")


@query("derive_aliases", _BASE + _ALIASES + """
SELECT unit_type, alias, CASE WHEN unit_type = 'region' AND alias = 'asia' THEN '99' ELSE code END code,
 CASE WHEN unit_type = 'region' AND alias = 'asia' THEN 'manual' ELSE 'boundary' END source FROM aliases
""")
def derive_aliases(t: Tables):
    manual = t.spark.createDataFrame([("region", "asia", "99")], "unit_type string, alias string, code string")
    return rv.derive_aliases(roles.boundaries(t), manual)


@query("backfill_codes", _BASE + _FOREIGN + _ALIASES + _RESOLVED + """
SELECT p_partkey, x.raw spatial_key, CASE WHEN p_partkey % 10 = 0 THEN 'set' ELSE r.code END spatial_code
FROM raw_keys x LEFT JOIN resolved r ON r.unit = x.unit AND r.raw = x.raw
""")
def backfill_codes(t: Tables):
    b = roles.boundaries(t)
    stats = roles.raw_keys(t).select(
        "p_partkey", F.col("unit").alias("spatial_unit"), F.col("raw").alias("spatial_key"),
        F.when(F.col("p_partkey") % 10 == 0, "set").alias("spatial_code"))
    return rv.backfill_codes(stats, b, rv.derive_aliases(b), ["ortsteil"]).select("p_partkey", "spatial_key", "spatial_code")


@query("unresolved_keys", _BASE + _FOREIGN + _ALIASES + _RESOLVED + """
SELECT count(*) keys, count(*) FILTER (WHERE r.code IS NULL) unresolved FROM keys_n k LEFT JOIN resolved r ON r.unit = k.unit AND r.raw = k.raw
""")
def unresolved_keys(t: Tables):
    b = roles.boundaries(t)
    got = rv.resolve_keys(roles.raw_keys(t), b, rv.derive_aliases(b))
    return got.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("code").isNull()).alias("unresolved"))


@query("boundary_gate", """
SELECT lower(c_mktsegment) boundary_type, count(*) features, count(CASE WHEN c_acctbal >= 0 THEN 1 END) coded,
 round(count(CASE WHEN c_acctbal >= 0 THEN 1 END) / count(*), 4) share, count(CASE WHEN c_acctbal >= 0 THEN 1 END) / count(*) >= 0.9 passes
FROM customer GROUP BY 1
""")
def boundary_gate(t: Tables):
    code = F.when(F.col("c_acctbal") >= 0, F.col("c_custkey").cast("string")).otherwise(" ")
    feats = t.customer.select(F.lower("c_mktsegment").alias("seg"), F.create_map(F.lit("OT"), code, F.lit("Name"), F.col("c_name")).alias("props"))
    coded = feats.select(F.col("seg").alias("boundary_type"), tx.first_present(F.col("props"), ["OT", "SBZ"]).alias("code"))
    return rv.boundary_quality(coded).select("boundary_type", "features", "coded", F.round("share", 4).alias("share"), "passes")
