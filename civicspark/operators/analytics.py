"""Series, correlation, regression, roll-up and choropleth operators on long statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from civicspark.functions.numeric import pearson
from civicspark.operators.state import newest_per_key
from civicspark.session import settled


def newest_in_year() -> list[Column]:
    return [F.desc_nulls_last("period_quarter"), F.desc_nulls_last("period_month")]


def usable(metric: str, unit: str, dataset_id: str | None = None) -> Column:
    """Usable rows of one metric on one level. Names collide across datasets, so pin the dataset
    where it is known."""
    rows = (F.col("metric_name") == metric) & (F.col("spatial_unit") == unit) & F.col("metric_value").isNotNull()
    if unit != "city":
        rows = rows & F.col("spatial_code").isNotNull()
    return rows if dataset_id is None else rows & (F.col("dataset_id") == dataset_id)


def of_metric(stats: DataFrame, metric: str, unit: str, dataset_id: str | None = None) -> DataFrame:
    return stats.where(usable(metric, unit, dataset_id))


def statistics_latest(stats: DataFrame) -> DataFrame:
    """Newest period per (dataset, level, key, metric); the label breaks ties."""
    return newest_per_key(
        stats, ["dataset_id", "spatial_unit", "spatial_key", "metric_name"],
        [F.desc_nulls_last("period_year"), *newest_in_year(), F.desc("period_label")],
    )


def common_years(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("period_year").where("period_year is not null").intersect(
        b.select("period_year").where("period_year is not null")
    )


def one_value(rows: DataFrame, by: str, name: str) -> DataFrame:
    """One row per area (or year): newest part of the year, then dataset, then key."""
    picked = newest_per_key(rows, [by], [*newest_in_year(), F.asc("dataset_id"), F.asc("spatial_key")])
    return picked.select(by, F.col("spatial_key").alias(f"key_{name}"),
                         F.col("metric_value").alias(f"value_{name}"), F.col("metric_unit").alias(f"unit_{name}"))


def paired_metrics(stats: DataFrame, a: Column, b: Column, year: int | None = None) -> DataFrame:
    """Values of two choices of rows per area in one year; by default the newest year both have.

    One scan and one shuffle: both sides are conditional aggregates per (year, area). Without a given year these few
    rows are written, and the year is a scalar subquery over them, so nothing is derived twice."""
    newest = [x for c in ("period_quarter", "period_month") for x in (F.col(c).isNull(), -F.col(c))]
    order, row = F.struct(*newest, "dataset_id", "spatial_key"), F.struct("spatial_key", "metric_value", "metric_unit")
    rows = stats.where((a | b) & (F.col("period_year").isNotNull() if year is None else F.col("period_year") == year))
    pairs = rows.groupBy("period_year", "spatial_code").agg(
        F.min_by(row, F.when(a, order)).alias("a"), F.min_by(row, F.when(b, order)).alias("b"))
    if year is None:
        pairs = settled(pairs, "pairs")
        both = pairs.groupBy("period_year").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b")).where("n_a > 0 and n_b > 0")
        pairs = pairs.where(F.col("period_year") == both.agg(F.max("period_year")).scalar())
    return pairs.where("spatial_code is not null and a is not null and b is not null").select(
        "spatial_code", F.col("a.spatial_key").alias("key_a"), F.col("a.metric_value").alias("value_a"),
        F.col("a.metric_unit").alias("unit_a"), F.col("b.metric_value").alias("value_b"), F.col("b.metric_unit").alias("unit_b"))


def paired_areas(a: DataFrame, b: DataFrame, year: int | None = None) -> DataFrame:
    """The same for rows of two tables."""
    columns = ["dataset_id", "spatial_code", "spatial_key", "period_year", "period_quarter", "period_month", "metric_value", "metric_unit"]
    sides = a.select(*columns, F.lit(True).alias("first")).unionByName(b.select(*columns, F.lit(False).alias("first")))
    return paired_metrics(sides, F.col("first"), ~F.col("first"), year)


def paired_years(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of two city metrics per year."""
    dated = lambda df: df.where("period_year is not null")
    return one_value(dated(a), "period_year", "a").drop("key_a").join(
        one_value(dated(b), "period_year", "b").drop("key_b"), "period_year"
    )


def correlation_summary(pairs: DataFrame) -> DataFrame:
    x, y = F.col("value_a"), F.col("value_b")
    return pairs.agg(
        F.count(x + y).alias("n"), pearson(x, y).alias("pearson_r"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
    )


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size > 0.7, "strong").when(size > 0.4, "moderate").when(size.isNotNull(), "weak")


def correlation_grid(wide: DataFrame, code: str, series: list[str], long: DataFrame,
                     group: list[str], value: str, minimum: int = 3) -> DataFrame:
    """Every series column against every long group over common areas.

    ``wide`` has one row per area and one column per series (a short curated list), ``long`` one
    row per area and group. Each long row meets one wide row, and all correlations of a group are
    aggregates of the same pass, so no series-by-group pairs are ever emitted."""
    y = F.col(value)
    stats = [
        F.struct(F.lit(s).alias("series"), pearson(F.col(f"`{s}`"), y).alias("r"),
                 F.count(F.col(f"`{s}`") + y).alias("n")).alias(f"_s{i}")
        for i, s in enumerate(series)
    ]
    grouped = long.join(wide, code).groupBy(*group).agg(*stats)
    return grouped.select(
        *group, F.inline(F.array(*[F.col(f"_s{i}") for i in range(len(series))]))
    ).where(F.col("n") >= minimum)


def scale_comparison(grid: DataFrame, level: str, child: str, parent: str, keys: list[str]) -> DataFrame:
    """The same correlations on two area levels side by side, with their difference."""
    at = lambda lv, c: F.max(F.when(F.col(level) == lv, F.col(c)))
    both = grid.where(F.col(level).isin(child, parent)).groupBy(*keys).agg(
        at(child, "n").alias("n_child"), at(parent, "n").alias("n_parent"),
        at(child, "r").alias("r_child"), at(parent, "r").alias("r_parent"))
    return both.where("n_child is not null and n_parent is not null").withColumn("delta", F.col("r_parent") - F.col("r_child"))


def compute_shares(counts: DataFrame, keys: list[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Ratios from counts (name, metric, value); a missing or zero denominator gives no share."""
    needed = sorted({m for pair in ratios.values() for m in pair})
    pivoted = counts.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric_name") == m, F.col("metric_value"))).alias(m) for m in needed]
    )
    return pivoted.select(*keys, *[
        (F.col(num) / F.nullif(F.col(den), F.lit(0))).alias(name) for name, (num, den) in ratios.items()
    ])


def conflicting_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys delivered with more than one value; identical repeats are fine. Minimum against maximum
    needs no distinct, so a hot key is reduced before the shuffle."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("metric_value").alias("lo"), F.max("metric_value").alias("hi")
    ).where("hi > lo")


def build_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count table with one value per key; raises inside the job on a conflicting duplicate."""
    merged = rows.groupBy(*keys).agg(F.min("metric_value").alias("metric_value"), F.max("metric_value").alias("_hi"))
    clash = F.col("_hi") > F.col("metric_value")
    message = F.concat_ws(" ", F.lit("conflicting duplicate:"), *[F.col(k).cast("string") for k in keys])
    return merged.withColumn(
        "metric_value", F.when(clash, F.raise_error(message).cast("double")).otherwise(F.col("metric_value"))
    ).drop("_hi")


def rollup_to_parent(counts: DataFrame, parents: DataFrame) -> DataFrame:
    """Counts summed per parent; children without a parent drop out. Ratios are recomputed from the
    result, never averaged."""
    linked = parents.where("parent_code is not null").select("code", "parent_code")
    others = [c for c in counts.columns if c not in ("spatial_code", "spatial_key", "metric_value")]
    return (
        counts.groupBy("spatial_code", *others).agg(F.sum("metric_value").alias("metric_value"))
        .join(linked, F.col("spatial_code") == F.col("code"))
        .groupBy(F.col("parent_code").alias("spatial_code"), *others)
        .agg(F.sum("metric_value").alias("metric_value"))
    )


def validate_rollup(ours: DataFrame, official: DataFrame, keys: list[str], tolerance: float = 0.5) -> DataFrame:
    joined = ours.join(official.withColumnRenamed("metric_value", "_official"), keys)
    return joined.agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(F.abs(F.col("metric_value") - F.col("_official")) > tolerance).alias("mismatches"),
    )


def invariants(stats: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """Named aggregates against expected values, one row per check, one pass."""
    row = stats.agg(*[expr.cast("double").alias(f"_c{i}") for i, (expr, _) in enumerate(checks.values())])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check_name"), F.col(f"_c{i}").alias("found"),
                 F.lit(float(want)).alias("expected"), (F.col(f"_c{i}") == F.lit(float(want))).alias("holds"))
        for i, (name, (_, want)) in enumerate(checks.items())
    ])))


def require_invariants(checked: DataFrame) -> None:
    broken = [r["check_name"] for r in checked.where("not holds or holds is null").collect()]  # one row per check
    if broken:
        raise ValueError(f"invariants broken: {broken}")


def choropleth(stats: DataFrame, bounds: DataFrame, year: int | None = None, dataset_id: str | None = None) -> DataFrame:
    """Newest value per area and metric with the boundary version that applies to its year."""
    rows = stats.where("spatial_unit <> 'city' and spatial_code is not null and metric_value is not null")
    if year is not None:
        rows = rows.where(F.col("period_year") == year)
    if dataset_id is not None:
        rows = rows.where(F.col("dataset_id") == dataset_id)
    return newest_per_key(
        versioned_boundaries(rows, bounds), ["spatial_unit", "metric_name", "spatial_code"],
        [F.desc_nulls_last("period_year"), *newest_in_year(), F.asc("dataset_id"), F.asc("spatial_key")],
    )


def versioned_boundaries(rows: DataFrame, bounds: DataFrame, unit: str = "spatial_unit", code: str = "spatial_code",
                         year: str = "period_year") -> DataFrame:
    """One boundary per row: the version of its year, else the timeless one (year 0). Two equi-joins;
    rows without either are left out."""
    def version(tag: str) -> DataFrame:
        return bounds.select(F.col("boundary_type").alias(f"_bt_{tag}"), F.col("code").alias(f"_bc_{tag}"),
                             F.struct("name").alias(f"_b_{tag}"), F.col("boundary_year").alias(f"_by_{tag}"))

    def here(tag: str) -> Column:
        return (F.col(f"_bt_{tag}") == F.col(unit)) & (F.col(f"_bc_{tag}") == F.col(code))

    exact, timeless = version("e").where("_by_e <> 0"), version("t").where("_by_t = 0")
    found = rows.join(exact, here("e") & (F.col("_by_e") == F.col(year)), "left").join(timeless, here("t"), "left")
    chosen = F.coalesce("_b_e", "_b_t")
    return found.where(chosen.isNotNull()).withColumn("boundary_name", chosen["name"]).drop(
        *[f"{c}_{tag}" for c in ("_bt", "_bc", "_b", "_by") for tag in "et"])


def colour_class(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Quarter of the group maximum (0-3). The maximum is an aggregate joined back, not a window
    over the whole group."""
    top = rows.groupBy(*group).agg(F.max(value).alias("_max"))
    ratio = F.col(value) / F.nullif(F.col("_max"), F.lit(0.0))
    cls = F.when(ratio > 0.75, 3).when(ratio > 0.5, 2).when(ratio > 0.25, 1).otherwise(0)
    return rows.join(top, group).withColumn("colour_class", cls).drop("_max")


def diverging_position(score: Column) -> Column:
    """Score clamped to [-1, 1] and mapped onto [0, 1] of a two-sided ramp."""
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)) + 1) / 2


# --- polynomial fit -------------------------------------------------------------------------------

def power_sums(df: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame:
    """Sufficient statistics of a polynomial fit on standardised x: one row per group from two
    passes of partial aggregation, whatever the group size."""
    pts = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    scale = settled(
        pts.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.stddev_pop(x).alias("sx"), F.avg(y).alias("my"),
            F.min(x).alias("xmin"), F.max(x).alias("xmax")),
        "fit-scale")
    t = (F.col(x) - F.col("mx")) / F.nullif(F.col("sx"), F.lit(0.0))
    yc = F.col(y) - F.col("my")
    sums = [F.sum(F.pow(t, k)).alias(f"s{k}") for k in range(2 * degree + 1)]
    cross = [F.sum(yc * F.pow(t, k)).alias(f"b{k}") for k in range(degree + 1)]
    meta = [F.max(c).alias(c) for c in ("n", "mx", "sx", "my", "xmin", "xmax")]
    return pts.join(scale, keys).groupBy(*keys).agg(*meta, *sums, *cross, F.sum(yc * yc).alias("syy"))


def polynomial_fit(df: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame:
    """Least squares of degree 1-3 per group: coefficients on standardised x, and R². NULL for
    fewer than degree + 2 points, constant x or y, or a singular system."""
    if not 1 <= degree <= 3:
        raise ValueError("degree must be 1, 2 or 3")
    sums = power_sums(df, keys, x, y, degree)
    size = degree + 1
    fields = [sums.schema[k] for k in keys]
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema = f"{key_ddl}, n bigint, mx double, sx double, xmin double, xmax double, coeffs array<double>, r2 double"

    def solve(batches):
        for pdf in batches:
            # one stacked solve for all groups of the batch; unusable ones solve a unit system instead
            place = np.add.outer(np.arange(size), np.arange(size))
            a = pdf[[f"s{k}" for k in range(2 * degree + 1)]].to_numpy(float)[:, place]
            b = pdf[[f"b{k}" for k in range(size)]].to_numpy(float)
            syy = pdf["syy"].to_numpy(float)
            usable = (pdf["n"].to_numpy() >= degree + 2) & (pdf["sx"].to_numpy(float) > 0) & (syy > 0)
            a[~usable] = np.eye(size)
            usable &= np.abs(np.linalg.det(a)) > 1e-10
            a[~usable] = np.eye(size)
            fit = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            r2 = np.where(usable, (fit * b).sum(axis=1) / np.where(usable, syy, 1.0), np.nan)
            fit[:, 0] += pdf["my"].to_numpy(float)
            out = pdf[[*keys, "n", "mx", "sx", "xmin", "xmax"]].copy()
            out["coeffs"] = pd.Series([f if ok else None for f, ok in zip(fit.tolist(), usable, strict=True)], dtype=object, index=pdf.index)
            out["r2"] = pd.Series(np.where(usable, r2, None), dtype=object, index=pdf.index)
            yield out

    return sums.mapInPandas(solve, schema)


def trend_curve(fit: DataFrame, keys: list[str], samples: int = 101) -> DataFrame:
    """Evenly spaced points of the fitted curve between the smallest and largest x."""
    step = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("step")
    at = fit.where("coeffs is not null").select(*keys, "mx", "sx", "coeffs", "xmin", "xmax", step)
    x = F.col("xmin") + (F.col("xmax") - F.col("xmin")) * F.col("step") / (samples - 1)
    t = (x - F.col("mx")) / F.col("sx")
    y = F.aggregate(F.reverse("coeffs"), F.lit(0.0), lambda acc, c: acc * t + c)
    return at.select(*keys, "step", x.alias("x"), y.alias("y"))


def paired_fit(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Fitted line over complete pairs, with axis limits padded by 8 %."""
    ok = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pad = lambda c: 0.08 * (F.max(c) - F.min(c))
    return ok.agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        (F.min(x) - pad(x)).alias("x_from"), (F.max(x) + pad(x)).alias("x_to"),
        (F.min(y) - pad(y)).alias("y_from"), (F.max(y) + pad(y)).alias("y_to"),
    )


def latest_pairs(latest: DataFrame, a: str, b: str) -> DataFrame:
    """Newest values of two metrics of one dataset per area, where both are of the same year, in one shuffle."""
    of = lambda m, v: F.when(F.col("metric_name") == m, v)
    return latest.where(F.col("metric_name").isin(a, b)).groupBy("spatial_unit", "spatial_key", "period_year").agg(
        *[F.max(of(m, F.col("metric_value"))).alias(f"value_{n}") for m, n in ((a, "a"), (b, "b"))],
        *[F.count(of(m, F.lit(1))).alias(f"_n_{n}") for m, n in ((a, "a"), (b, "b"))]).where("_n_a > 0 and _n_b > 0").drop("_n_a", "_n_b")


def windowless_corr(latest: DataFrame, group: list[str]) -> DataFrame:
    """Legacy variant: all metric pairs of one area level share one r, computed as an aggregate and
    joined back instead of a window over everything. The pairs are written once and read twice."""
    latest = settled(latest, "latest-pairs")
    r = latest.groupBy(*group).agg(pearson(F.col("value_a"), F.col("value_b")).alias("r"))
    return latest.join(r, group)
