"""Statistics queries: series, correlation, roll-up, regression, choropleth."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import numeric
from civicspark.operators import analytics as an, browse
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.plans.roles import ctes

KEYED = ("dataset_id", "spatial_unit", "spatial_key", "metric_name")


def r(col, digits: int = 4):
    return F.round(col, digits)


@query("statistics_latest", ctes("stats_long") + """
SELECT dataset_id, spatial_unit, spatial_key, spatial_code, metric_name, period_year, period_quarter, metric_value
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, spatial_unit, spatial_key, metric_name
        ORDER BY period_year DESC NULLS LAST, period_quarter DESC NULLS LAST, period_label DESC) rn FROM stats_long)
WHERE rn = 1
""")
def statistics_latest(t: Tables):
    return an.statistics_latest(roles.stats_long(t)).select(
        *KEYED, "spatial_code", "period_year", "period_quarter", "metric_value")


@query("common_years", ctes("stats_long") + """
SELECT period_year FROM stats_long WHERE metric_name = 'orders' AND spatial_unit = 'nation'
INTERSECT SELECT period_year FROM stats_long WHERE metric_name = 'quantity' AND spatial_unit = 'nation'
""")
def common_years(t: Tables):
    s = roles.stats_long(t)
    return an.common_years(an.of_metric(s, "orders", "nation"), an.of_metric(s, "quantity", "nation"))


_CROSS = ctes("stats_long") + """, ya AS (
  SELECT max(period_year) y FROM (
    SELECT period_year FROM stats_long WHERE metric_name = 'orders' AND spatial_unit = 'nation'
    INTERSECT SELECT period_year FROM stats_long WHERE metric_name = 'quantity' AND spatial_unit = 'nation')
), a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spatial_code ORDER BY period_quarter DESC, dataset_id,
    spatial_key) rn FROM stats_long WHERE metric_name = 'orders' AND spatial_unit = 'nation'
    AND period_year = (SELECT y FROM ya)) WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spatial_code ORDER BY period_quarter DESC, dataset_id,
    spatial_key) rn FROM stats_long WHERE metric_name = 'quantity' AND spatial_unit = 'nation'
    AND period_year = (SELECT y FROM ya)) WHERE rn = 1),
pairs AS (SELECT a.spatial_code, a.spatial_key, a.metric_value value_a, b.metric_value value_b FROM a JOIN b USING (spatial_code))
"""


def _cross(t: Tables):
    return an.paired_metrics(roles.stats_long(t), an.usable("orders", "nation"), an.usable("quantity", "nation"))


@query("corr_cross_section", _CROSS + """
SELECT count(*) n, round(corr(value_a, value_b), 4) pearson_r, round(regr_slope(value_b, value_a), 4) slope,
       round(regr_intercept(value_b, value_a), 4) intercept FROM pairs
""")
def corr_cross_section(t: Tables):
    got = an.correlation_summary(_cross(t))
    return got.select("n", *[r(F.col(c)).alias(c) for c in ("pearson_r", "slope", "intercept")])


@query("corr_cross_points", _CROSS + "SELECT spatial_code, spatial_key, value_a, value_b FROM pairs")
def corr_cross_points(t: Tables):
    return _cross(t).select("spatial_code", F.col("key_a").alias("spatial_key"), "value_a", "value_b")


_YEARS = ctes("stats_long") + """, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_year
  ORDER BY period_quarter DESC, dataset_id, spatial_key) rn FROM stats_long
  WHERE metric_name = 'orders' AND spatial_unit = 'city') WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_year
  ORDER BY period_quarter DESC, dataset_id, spatial_key) rn FROM stats_long
  WHERE metric_name = 'revenue' AND spatial_unit = 'city') WHERE rn = 1),
pairs AS (SELECT period_year, a.metric_value value_a, b.metric_value value_b FROM a JOIN b USING (period_year))
"""


@query("corr_timeseries", _YEARS + """
SELECT count(*) n, round(corr(value_a, value_b), 4) pearson_r, round(regr_slope(value_b, value_a), 2) slope,
       round(regr_intercept(value_b, value_a), 2) intercept FROM pairs
""")
def corr_timeseries(t: Tables):
    s = roles.stats_long(t)
    pairs = an.paired_years(an.of_metric(s, "orders", "city"), an.of_metric(s, "revenue", "city"))
    got = an.correlation_summary(pairs)
    return got.select("n", r(F.col("pearson_r")).alias("pearson_r"), r(F.col("slope"), 2).alias("slope"),
                      r(F.col("intercept"), 2).alias("intercept"))


_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, spatial_unit, spatial_key, metric_name
  ORDER BY period_year DESC, period_quarter DESC, period_label DESC) rn FROM stats_long) WHERE rn = 1)"""


@query("corr_latest_window", ctes("stats_long") + ", " + _LATEST + """
SELECT a.spatial_unit, a.spatial_key, a.metric_value value_a, b.metric_value value_b,
       round(corr(a.metric_value, b.metric_value) OVER (PARTITION BY a.spatial_unit), 4) r
FROM latest a JOIN latest b ON a.spatial_unit = b.spatial_unit AND a.spatial_key = b.spatial_key
 AND a.period_year IS NOT DISTINCT FROM b.period_year
WHERE a.dataset_id = 'orders' AND a.metric_name = 'customers' AND b.dataset_id = 'orders' AND b.metric_name = 'revenue'
  AND a.spatial_unit <> 'city'
""")
def corr_latest_window(t: Tables):
    latest = an.statistics_latest(roles.stats_long(t)).where("spatial_unit <> 'city' and dataset_id = 'orders'")
    both = an.latest_pairs(latest, "customers", "revenue")
    return an.windowless_corr(both, ["spatial_unit"]).select(
        "spatial_unit", "spatial_key", "value_a", "value_b", r(F.col("r")).alias("r"))


@query("metric_list", ctes("stats_long") + """
SELECT DISTINCT dataset_id, spatial_unit, metric_name, metric_unit FROM stats_long
WHERE metric_value IS NOT NULL AND (spatial_unit = 'city' OR spatial_code IS NOT NULL)
""")
def metric_list(t: Tables):
    return browse.metric_list(roles.stats_long(t))


@query("timeseries", ctes("stats_long") + """
SELECT period_year, period_quarter, coalesce(period_label, CAST(period_year AS VARCHAR)) AS label, metric_value, metric_unit
FROM stats_long WHERE dataset_id = 'orders' AND metric_name = 'revenue' AND spatial_unit = 'nation'
  AND spatial_key = 'NATION_7' AND metric_value IS NOT NULL
""")
def timeseries(t: Tables):
    return browse.timeseries(roles.stats_long(t), "orders", "revenue", "nation", "NATION_7").select(
        "period_year", "period_quarter", F.coalesce("period_label", F.col("period_year").cast("string")).alias("label"),
        "metric_value", "metric_unit")


# --- regression ----------------------------------------------------------------------------------

@query("pearson_full", """
SELECT l_returnflag, l_linestatus, count(*) n, round(corr(l_quantity, l_extendedprice), 4) r,
       round(corr(l_quantity, l_extendedprice) ** 2, 4) r2 FROM lineitem GROUP BY 1, 2
""")
def pearson_full(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), numeric.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("r")
    ).select("l_returnflag", "l_linestatus", "n", r(F.col("r")).alias("r"), r(F.col("r") * F.col("r")).alias("r2"))


@query("pearson_p_value")
def pearson_p_value(t: Tables):
    rows = t.lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), numeric.pearson(F.col("l_quantity"), F.col("l_tax")).alias("r")
    ).where("n >= 3")
    return rows.select("l_suppkey", "n", r(F.col("r")).alias("r"),
                       r(numeric.pearson_p_value(F.col("r"), F.col("n").cast("double"))).alias("p"))


@query("polyfit_line", """
SELECT l_returnflag, l_linestatus, count(*) n, round(regr_r2(l_extendedprice, l_quantity), 6) r2,
       round(regr_slope(l_extendedprice, l_quantity), 3) slope, round(regr_intercept(l_extendedprice, l_quantity), 3) intercept
FROM lineitem GROUP BY 1, 2
""")
def polyfit_line(t: Tables):
    fit = an.polynomial_fit(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice", 1)
    slope = F.col("coeffs")[1] / F.col("sx")
    return fit.select("l_returnflag", "l_linestatus", "n", r(F.col("r2"), 6).alias("r2"), r(slope, 3).alias("slope"),
                      r(F.col("coeffs")[0] - slope * F.col("mx"), 3).alias("intercept"))


@query("polyfit_cubic")
def polyfit_cubic(t: Tables):
    fit = an.polynomial_fit(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice", 3)
    return fit.select("l_returnflag", "l_linestatus", "n", r(F.col("r2")).alias("r2"),
                      F.array_join(F.transform("coeffs", lambda c: r(c, 2).cast("string")), "|").alias("coeffs"))


@query("trend_curve", """
WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) s, regr_intercept(l_extendedprice, l_quantity) i,
  min(l_quantity) lo, max(l_quantity) hi FROM lineitem GROUP BY 1)
SELECT l_returnflag, CAST(step AS INTEGER) step, round(lo + (hi - lo) * step / 100, 4) x,
       round(i + s * (lo + (hi - lo) * step / 100), 2) y
FROM f, (SELECT unnest(range(0, 101)) step)
""")
def trend_curve(t: Tables):
    fit = an.polynomial_fit(t.lineitem, ["l_returnflag"], "l_quantity", "l_extendedprice", 1)
    return an.trend_curve(fit, ["l_returnflag"]).select(
        "l_returnflag", "step", r(F.col("x")).alias("x"), r(F.col("y"), 2).alias("y"))


@query("paired_fit", """
WITH o AS (SELECT n_name nm, CAST(count(*) AS DOUBLE) x FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
s AS (SELECT n_name nm, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) y FROM supplier JOIN nation
  ON s_nationkey = n_nationkey GROUP BY 1)
SELECT count(*) n, round(regr_slope(y, x), 4) slope, round(regr_intercept(y, x), 4) intercept,
  round(min(x) - 0.08 * (max(x) - min(x)), 4) x_from, round(max(x) + 0.08 * (max(x) - min(x)), 4) x_to,
  round(min(y) - 0.08 * (max(y) - min(y)), 4) y_from, round(max(y) + 0.08 * (max(y) - min(y)), 4) y_to
FROM o JOIN s USING (nm)
""")
def paired_fit(t: Tables):
    xs = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("x"))
    ys = t.supplier.groupBy("s_nationkey").agg(F.sum(F.col("s_acctbal").cast(roles.MONEY)).cast("double").alias("y"))
    named = t.nation.select("n_nationkey", "n_name")
    left = xs.join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "x")
    right = ys.join(named, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "y")
    got = an.paired_fit(left.join(right, "n_name"), "x", "y")
    return got.select("n", *[r(F.col(c)).alias(c) for c in got.columns if c != "n"])


# --- counts, shares, roll-up -----------------------------------------------------------------------

YEAR_COUNTS = """, yc AS (SELECT spatial_unit, spatial_code, period_year, metric_name, CAST(sum(CAST(metric_value AS DECIMAL(28,2))) AS DOUBLE) metric_value
 FROM stats_long WHERE dataset_id = 'orders' AND spatial_code IS NOT NULL GROUP BY 1, 2, 3, 4)
"""
RATIOS = {"urgent_share": ("urgent", "orders"), "order_value": ("revenue", "orders"),
          "orders_per_customer": ("orders", "customers")}


def _year_counts(t: Tables, unit: str | None = None):
    s = roles.stats_long(t).where("dataset_id = 'orders' and spatial_code is not null")
    if unit:
        s = s.where(F.col("spatial_unit") == unit)
    # money adds up in decimals, so the result does not depend on the order of the rows
    return s.groupBy("spatial_unit", "spatial_code", "period_year", "metric_name").agg(
        F.sum(F.col("metric_value").cast("decimal(28,2)")).cast("double").alias("metric_value"))


@query("compute_shares", ctes("stats_long") + YEAR_COUNTS + """
SELECT spatial_unit, spatial_code, period_year, round(u / nullif(o, 0), 6) urgent_share, round(v / nullif(o, 0), 4) order_value,
       round(o / nullif(c, 0), 6) orders_per_customer
FROM (SELECT spatial_unit, spatial_code, period_year, max(metric_value) FILTER (WHERE metric_name = 'urgent') u,
  max(metric_value) FILTER (WHERE metric_name = 'orders') o, max(metric_value) FILTER (WHERE metric_name = 'revenue') v,
  max(metric_value) FILTER (WHERE metric_name = 'customers') c FROM yc GROUP BY 1, 2, 3)
""")
def compute_shares(t: Tables):
    got = an.compute_shares(_year_counts(t), ["spatial_unit", "spatial_code", "period_year"], RATIOS)
    return got.select("spatial_unit", "spatial_code", "period_year", r(F.col("urgent_share"), 6).alias("urgent_share"),
                      r(F.col("order_value"), 4).alias("order_value"),
                      r(F.col("orders_per_customer"), 6).alias("orders_per_customer"))


@query("conflict_check", """
SELECT l_orderkey, l_linenumber, count(*) n, min(l_quantity) lo, max(l_quantity) hi FROM lineitem
GROUP BY 1, 2 HAVING max(l_quantity) > min(l_quantity)
""")
def conflict_check(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("metric_value"))
    return an.conflicting_duplicates(rows, ["l_orderkey", "l_linenumber"])


_ROLLUP = ctes("stats_long", "boundaries") + YEAR_COUNTS + """, up AS (
 SELECT parent_code spatial_code, period_year, metric_name, sum(metric_value) metric_value
 FROM yc JOIN boundaries b ON b.boundary_type = 'nation' AND b.code = yc.spatial_code
 WHERE spatial_unit = 'nation' AND parent_code IS NOT NULL GROUP BY 1, 2, 3)
"""


def _rolled(t: Tables):
    parents = roles.boundaries_of_nations(t)
    return an.rollup_to_parent(_year_counts(t, "nation").drop("spatial_unit"), parents)


@query("rollup_parent", _ROLLUP + """
SELECT spatial_code, period_year, round(max(metric_value) FILTER (WHERE metric_name = 'orders'), 2) orders,
  round(max(metric_value) FILTER (WHERE metric_name = 'urgent') / nullif(max(metric_value) FILTER (WHERE metric_name = 'orders'), 0), 6)
   urgent_share FROM up GROUP BY 1, 2
""")
def rollup_parent(t: Tables):
    up = _rolled(t)
    shares = an.compute_shares(up, ["spatial_code", "period_year"], {"urgent_share": ("urgent", "orders")})
    totals = up.where("metric_name = 'orders'").select("spatial_code", "period_year", F.col("metric_value").alias("orders"))
    return totals.join(shares, ["spatial_code", "period_year"]).select(
        "spatial_code", "period_year", r(F.col("orders"), 2).alias("orders"), r(F.col("urgent_share"), 6).alias("urgent_share"))


@query("rollup_validate", _ROLLUP + """
SELECT count(*) compared, count(*) FILTER (WHERE abs(up.metric_value - yc.metric_value) > 0.5) mismatches
FROM up JOIN yc ON yc.spatial_unit = 'region' AND yc.spatial_code = up.spatial_code AND yc.period_year = up.period_year
 AND yc.metric_name = up.metric_name
""")
def rollup_validate(t: Tables):
    official = _year_counts(t, "region").drop("spatial_unit")
    return an.validate_rollup(_rolled(t), official, ["spatial_code", "period_year", "metric_name"])


@query("invariants", ctes("stats_long") + """
SELECT 'nations' check_name, CAST(count(DISTINCT spatial_code) FILTER (WHERE spatial_unit = 'nation') AS DOUBLE) found,
  CAST(25 AS DOUBLE) expected, count(DISTINCT spatial_code) FILTER (WHERE spatial_unit = 'nation') = 25 holds FROM stats_long
UNION ALL SELECT 'regions', CAST(count(DISTINCT spatial_code) FILTER (WHERE spatial_unit = 'region') AS DOUBLE), 5,
  count(DISTINCT spatial_code) FILTER (WHERE spatial_unit = 'region') = 5 FROM stats_long
UNION ALL SELECT 'level_gap', CAST(sum(CASE spatial_unit WHEN 'nation' THEN metric_value WHEN 'region' THEN -metric_value ELSE 0 END) AS DOUBLE), 0,
  sum(CASE spatial_unit WHEN 'nation' THEN metric_value WHEN 'region' THEN -metric_value ELSE 0 END) = 0 FROM stats_long
 WHERE metric_name = 'orders'
""")
def invariants(t: Tables):
    unit, code, v = F.col("spatial_unit"), F.col("spatial_code"), F.col("metric_value")
    gap = F.when(F.col("metric_name") == "orders", F.when(unit == "nation", v).when(unit == "region", -v).otherwise(0.0))
    return an.invariants(roles.stats_long(t), {
        "nations": (F.count_distinct(F.when(unit == "nation", code)), 25),
        "regions": (F.count_distinct(F.when(unit == "region", code)), 5),
        "level_gap": (F.sum(gap), 0),
    })


PARTIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SERIES = [*PARTIES, "turnout"]


def _vote_shares(t: Tables):
    """One row per level, area and year: a share column per party, and turnout. Both levels come from
    one pass; region figures are summed from counts."""
    up = roles.boundaries_of_nations(t).select(
        F.col("code").alias("spatial_code"),
        F.array(F.struct(F.lit("nation").alias("unit"), F.col("code").alias("area")),
                F.struct(F.lit("region").alias("unit"), F.col("parent_code").alias("area"))).alias("levels"))
    e = roles.election_results(t).join(up, "spatial_code").select("*", F.inline("levels"))
    per_area = e.groupBy("unit", "area", "year").agg(
        *[F.sum(F.when(F.col("party") == p, F.col("zweitstimmen"))).alias(p) for p in PARTIES],
        F.sum("zweitstimmen").alias("_valid"),
        F.sum(F.when(F.col("party") == PARTIES[0], F.col("waehler"))).alias("_voters"),
        F.sum(F.when(F.col("party") == PARTIES[0], F.col("wahlberechtigte"))).alias("_eligible"),
    )
    return per_area.select(
        F.struct("unit", "area", "year").alias("spot"),
        *[(F.col(f"`{p}`") / F.nullif(F.col("_valid"), F.lit(0))).alias(p) for p in PARTIES],
        (F.col("_voters") / F.nullif(F.col("_eligible"), F.lit(0))).alias("turnout"))


def _grid(t: Tables):
    """Correlations on both levels, (unit, indicator, series, r, n)."""
    counts = _year_counts(t).withColumnsRenamed({"spatial_unit": "unit", "spatial_code": "area", "period_year": "year"})
    shares = an.compute_shares(counts, ["unit", "area", "year"], RATIOS).unpivot(
        ["unit", "area", "year"], list(RATIOS), "indicator", "value").where("value is not null")
    spots = shares.select("unit", F.struct("unit", "area", "year").alias("spot"), "indicator", "value")
    return an.correlation_grid(_vote_shares(t), "spot", SERIES, spots, ["unit", "indicator"], "value")


def _grid_sql(unit: str, area: str) -> str:
    return f""", ev_{unit} AS (SELECT {area} area, year, party, sum(zweitstimmen) v, sum(waehler) w, sum(wahlberechtigte) e
  FROM election_all JOIN boundaries b ON b.boundary_type = 'nation' AND b.code = spatial_code GROUP BY 1, 2, 3),
s_{unit} AS (SELECT area, year, party series, CAST(v AS DOUBLE) / sum(v) OVER (PARTITION BY area, year) x FROM ev_{unit}
  UNION ALL SELECT area, year, 'turnout', CAST(w AS DOUBLE) / e FROM ev_{unit} WHERE party = '1-URGENT'),
p_{unit} AS (SELECT spatial_code area, period_year AS year, max(metric_value) FILTER (WHERE metric_name = 'urgent') u,
  max(metric_value) FILTER (WHERE metric_name = 'orders') o, max(metric_value) FILTER (WHERE metric_name = 'revenue') v,
  max(metric_value) FILTER (WHERE metric_name = 'customers') c FROM yc WHERE spatial_unit = '{unit}' GROUP BY 1, 2),
i_{unit} AS (SELECT area, year, 'urgent_share' indicator, u / nullif(o, 0) y FROM p_{unit}
  UNION ALL SELECT area, year, 'order_value', v / nullif(o, 0) FROM p_{unit}
  UNION ALL SELECT area, year, 'orders_per_customer', o / nullif(c, 0) FROM p_{unit}),
g_{unit} AS (SELECT indicator, series, count(*) n, corr(x, y) r FROM s_{unit} JOIN i_{unit} USING (area, year)
  WHERE y IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3)
"""


_GRID_BASE = ctes("stats_long", "boundaries", "election_all") + YEAR_COUNTS


@query("corr_grid", _GRID_BASE + _grid_sql("nation", "spatial_code") + """
SELECT indicator, series, n, round(r, 4) r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate'
  WHEN r IS NOT NULL THEN 'weak' END strength FROM g_nation
""")
def corr_grid(t: Tables):
    return _grid(t).where("unit = 'nation'").select("indicator", "series", "n", r(F.col("r")).alias("r"),
                                     an.strength(F.col("r")).alias("strength"))


@query("maup_delta", _GRID_BASE + _grid_sql("nation", "spatial_code") + _grid_sql("region", "b.parent_code") + """
SELECT indicator, series, a.n n_child, b.n n_parent, round(a.r, 4) r_child, round(b.r, 4) r_parent, round(b.r - a.r, 4) delta
FROM g_nation a JOIN g_region b USING (indicator, series)
""")
def maup_delta(t: Tables):
    return an.scale_comparison(_grid(t), "unit", "nation", "region", ["indicator", "series"]).select(
        "indicator", "series", "n_child", "n_parent", r(F.col("r_child")).alias("r_child"), r(F.col("r_parent")).alias("r_parent"),
        r(F.col("delta")).alias("delta")).orderBy(F.abs("delta").desc(), "indicator", "series")


# --- choropleth --------------------------------------------------------------------------------------

_CHORO = ctes("stats_long", "boundaries") + """, c AS (SELECT * FROM (
 SELECT s.*, b.name boundary_name, row_number() OVER (PARTITION BY spatial_unit, metric_name, spatial_code
   ORDER BY period_year DESC, period_quarter DESC, dataset_id, spatial_key) rn
 FROM stats_long s JOIN boundaries b ON b.boundary_type = s.spatial_unit AND b.code = s.spatial_code
  AND (b.boundary_year = 0 OR b.boundary_year = s.period_year)
 WHERE spatial_unit <> 'city' AND spatial_code IS NOT NULL AND metric_value IS NOT NULL) WHERE rn = 1)
"""


@query("choropleth", _CHORO + """
SELECT spatial_unit, metric_name, spatial_code, boundary_name, dataset_id, period_year, metric_value, metric_unit FROM c
""")
def choropleth(t: Tables):
    return an.choropleth(roles.stats_long(t), roles.boundaries(t)).select(
        "spatial_unit", "metric_name", "spatial_code", "boundary_name", "dataset_id", "period_year", "metric_value",
        "metric_unit")


@query("choropleth_class", _CHORO + """
SELECT spatial_unit, metric_name, spatial_code, CASE WHEN q > 0.75 THEN 3 WHEN q > 0.5 THEN 2 WHEN q > 0.25 THEN 1 ELSE 0 END
  colour_class FROM (SELECT *, metric_value / nullif(max(metric_value) OVER (PARTITION BY spatial_unit, metric_name), 0) q FROM c)
""")
def choropleth_class(t: Tables):
    rows = an.choropleth(roles.stats_long(t), roles.boundaries(t))
    return an.colour_class(rows, ["spatial_unit", "metric_name"], "metric_value").select(
        "spatial_unit", "metric_name", "spatial_code", "colour_class")


@query("versioned_boundary_join", ctes("facts") + """, b AS (
 SELECT 'ortsteil' boundary_type, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') code, s_name AS name,
   CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE CAST(1995 + s_suppkey % 7 AS INTEGER) END boundary_year FROM supplier
 UNION ALL SELECT 'ortsteil', lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), s_name || ' neu', CAST(1993 + s_suppkey % 5 AS INTEGER)
 FROM supplier WHERE s_suppkey % 2 = 0)
SELECT name boundary_name, period_year, count(*) n, CAST(sum(CAST(metric_value AS DECIMAL(18,2))) AS DOUBLE) total
FROM facts f JOIN b ON b.boundary_type = f.spatial_unit AND b.code = f.spatial_code
  AND (b.boundary_year = f.period_year OR b.boundary_year = 0 AND NOT EXISTS (SELECT 1 FROM b x
    WHERE x.boundary_type = f.spatial_unit AND x.code = f.spatial_code AND x.boundary_year = f.period_year)) GROUP BY 1, 2
""")
def versioned_boundary_join(t: Tables):
    key = F.col("s_suppkey")
    bounds = t.supplier.select(
        F.lit("ortsteil").alias("boundary_type"), F.lpad(key.cast("string"), 6, "0").alias("code"),
        F.col("s_name").alias("name"),
        F.when(key % 2 == 0, 0).otherwise((1995 + key % 7).cast("int")).alias("boundary_year"))
    renamed = t.supplier.where(key % 2 == 0).select(
        F.lit("ortsteil").alias("boundary_type"), F.lpad(key.cast("string"), 6, "0").alias("code"),
        F.concat("s_name", F.lit(" neu")).alias("name"), (1993 + key % 5).cast("int").alias("boundary_year"))
    # one row per area and year meets the boundaries, not every observation
    yearly = roles.facts(t).groupBy("spatial_unit", "spatial_code", "period_year").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("metric_value").cast(roles.MONEY)).alias("total"))
    return an.versioned_boundaries(yearly, bounds.unionByName(renamed)).groupBy("boundary_name", "period_year").agg(
        F.sum("n").alias("n"), F.sum("total").cast("double").alias("total"))


@query("case_extract", ctes("facts") + """
SELECT DISTINCT spatial_code, spatial_key, dataset_id, metric_name, metric_value
FROM facts JOIN part ON dataset_id = CAST(p_partkey AS VARCHAR) AND metric_name = 'menge_O_' || (1 + p_size % 7)
WHERE spatial_unit = 'ortsteil' AND spatial_code IS NOT NULL
""")
def case_extract(t: Tables):
    pins = t.part.select(
        F.col("p_partkey").cast("string").alias("dataset_id"),
        F.concat(F.lit("menge_O_"), (1 + F.col("p_size") % 7).cast("string")).alias("metric_name"))
    return browse.case_extract(roles.facts(t), roles.boundaries(t), pins, "ortsteil")
