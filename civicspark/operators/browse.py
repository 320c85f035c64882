"""Lists, filters, pages and detail views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from civicspark.functions import text as tx
from civicspark.operators.resolve import foreign_level
from civicspark.operators.state import any_of, top_per_key

def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page; the order must name a unique key so that pages do not overlap."""
    return df.orderBy(*order).offset(offset).limit(limit)


def dataset_list(registry: DataFrame, schedule: str | None = None, has_geo: bool | None = None,
                 fmt: str | None = None, category: str | None = None, search: str | None = None) -> DataFrame:
    """Registry rows by optional filters; count it for the total, page it for the list."""
    out = registry
    if schedule:
        out = out.where(F.col("schedule") == schedule)
    if has_geo is not None:
        out = out.where(F.col("has_geo") == has_geo)
    if fmt:
        out = out.where(F.upper("best_format") == fmt.upper())
    if category:
        out = out.where(F.array_contains("categories", category))
    if search:
        out = out.where(tx.contains_text(F.col("title"), search) | tx.contains_text(F.col("dataset_id"), search))
    return out


def search_rows(df: DataFrame, columns: list[str], search_in: list[str], search: str | None) -> DataFrame:
    """Column projection with one search text over several columns."""
    hits = df if not search else df.where(
        any_of([F.coalesce(tx.contains_text(F.col(c).cast("string"), search), F.lit(False)) for c in search_in]))
    return hits.select(*columns)


def metric_list(stats: DataFrame, dataset_id: str | None = None, unit: str | None = None) -> DataFrame:
    rows = stats.where(
        "metric_value is not null and (spatial_unit = 'city' or spatial_code is not null)")
    if dataset_id:
        rows = rows.where(F.col("dataset_id") == dataset_id)
    if unit:
        rows = rows.where(F.col("spatial_unit") == unit)
    return rows.select("dataset_id", "spatial_unit", "metric_name", "metric_unit").distinct()


def timeseries(stats: DataFrame, dataset_id: str, metric: str, unit: str = "city", key: str | None = None) -> DataFrame:
    rows = stats.where(
        (F.col("dataset_id") == dataset_id) & (F.col("metric_name") == metric) & (F.col("spatial_unit") == unit)
        & F.col("metric_value").isNotNull())
    if key is not None:
        rows = rows.where(F.col("spatial_key") == key)
    return rows.orderBy(F.asc_nulls_last("period_year"), F.asc_nulls_last("period_quarter"),
                        F.asc_nulls_last("period_month"), "period_label", "spatial_key")


def indicator_timeseries(stats: DataFrame, mapping: DataFrame, indicators: DataFrame, indicator_id: str | None = None) -> DataFrame:
    """Rows of all metric variants of an indicator; the catalog unit fills a missing one."""
    wanted = mapping if indicator_id is None else mapping.where(F.col("indicator_id") == indicator_id)
    named = wanted.join(indicators.select("indicator_id", F.col("unit").alias("_unit")), "indicator_id")
    return stats.join(named, ["dataset_id", "metric_name"]).withColumn(
        "metric_unit", F.coalesce("metric_unit", "_unit")).drop("_unit")


def metrics_grouped(metrics: DataFrame, mapping: DataFrame, indicators: DataFrame) -> DataFrame:
    """Metrics with their indicator; metrics outside the catalog come last."""
    named = mapping.join(indicators, "indicator_id", "left")
    return metrics.join(named, ["dataset_id", "metric_name"], "left")


def active_at(restrictions: DataFrame, as_of: Column) -> DataFrame:
    """Validity intervals open on both sides: from <= t < until."""
    return restrictions.where(
        (F.col("valid_from").isNull() | (F.col("valid_from") <= as_of))
        & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of)))


def resolve_target(registry: DataFrame, change_log: DataFrame, stores: dict[str, DataFrame]) -> DataFrame:
    """Table a dataset lives in: its newest change entry, else the first store holding rows, in the
    given order. Every store is reduced to its dataset ids before the join."""
    allowed = change_log.where(F.col("target_table").isin(*stores))
    latest = allowed.groupBy("dataset_id").agg(
        F.max_by("target_table", F.struct("created_at", "run_id")).alias("_target"))
    out = registry.select("dataset_id").join(latest, "dataset_id", "left")
    flags = []
    for i, (name, df) in enumerate(stores.items()):
        out = out.join(df.select("dataset_id").distinct().withColumn(f"_t{i}", F.lit(name)), "dataset_id", "left")
        flags.append(F.col(f"_t{i}"))
    return out.select("dataset_id", F.coalesce("_target", *flags).alias("target_table"))


def last_runs(runs: DataFrame, k: int = 10) -> DataFrame:
    return top_per_key(runs, ["dataset_id"], [F.desc("started_at"), F.desc("run_id")], k)


def dataset_detail(registry: DataFrame, runs: DataFrame, rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Registry row with row count, category titles by position and its last ten runs (bounded)."""
    counts = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("row_count"))
    recent = last_runs(runs).groupBy("dataset_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("started_at", "run_id", "status")), asc=False),
            lambda s: s["status"]).alias("recent_status"))
    titles = (
        registry.select("dataset_id", F.explode("categories").alias("category_id"))
        .join(categories, "category_id")
        .groupBy("dataset_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda s: s["title"])
             .alias("category_titles")))
    return (
        registry.join(counts, "dataset_id", "left").join(recent, "dataset_id", "left")
        .join(titles, "dataset_id", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0))))


def change_history(changes: DataFrame, runs: DataFrame) -> DataFrame:
    return changes.join(runs.select("run_id", "status", "started_at"), "run_id", "left")


def dataset_status(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """Each dataset with its newest run; partial aggregation keeps one run per map task and key."""
    newest = runs.groupBy("dataset_id").agg(
        F.max_by(F.struct("status", "started_at", "rows_loaded"), F.struct("started_at", "run_id")).alias("_r"))
    return registry.join(newest, "dataset_id", "left").select(
        *registry.columns, F.col("_r.status").alias("last_run_status"), F.col("_r.started_at").alias("last_run_at"),
        F.col("_r.rows_loaded").alias("last_run_rows"))


def feature_detail(features: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    return features.join(registry, keys, "left")


def catalog_search(catalog: DataFrame, categories: DataFrame, text: str | None) -> DataFrame:
    """Entries by title text with their theme title and position; unknown themes sort as 99."""
    hits = catalog if not text else catalog.where(tx.contains_text(F.trim("title"), text.strip()))
    themes = categories.select(F.col("category_id").alias("theme"), F.col("title").alias("theme_title"), "position")
    return hits.join(themes, "theme", "left").withColumn("position", F.coalesce("position", F.lit(99))).withColumn(
        "theme_title", F.coalesce("theme_title", "theme"))


def case_extract(stats: DataFrame, bounds: DataFrame, pins: DataFrame, unit: str, year: int | None = None) -> DataFrame:
    """Rows of pinned (dataset_id, metric_name) pairs on one level, without rows named after another
    level."""
    rows = stats.where((F.col("spatial_unit") == unit) & F.col("spatial_code").isNotNull())
    if year is not None:
        rows = rows.where(F.col("period_year") == year)
    chosen = rows.join(pins, ["dataset_id", "metric_name"], "left_semi")
    picked = chosen.select("spatial_unit", "spatial_code", "spatial_key", "dataset_id", "metric_name", "metric_value").distinct()
    clean = foreign_level(picked, bounds, "spatial_unit", "spatial_key").where(~F.col("is_foreign"))
    return clean.select("spatial_code", "spatial_key", "dataset_id", "metric_name", "metric_value")
