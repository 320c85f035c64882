"""Keyed-table maintenance: newest per key, upserts, sweeps, history, retention, accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def newest_per_key(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    """One row per key by ``order``. Spark limits each map task to one row per key before the
    shuffle (window group limit), so a hot key never travels whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys, order: list[Column], k: int, salt: list[Column] | None = None) -> DataFrame:
    """First ``k`` rows per key. For a large ``k`` pass ``salt``: a first pass per (key, salt)
    keeps a hot key spread over tasks, the second sees at most k rows per salt value."""
    if salt:
        inner = Window.partitionBy(*keys, *salt).orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= k).drop("_rn")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def merge_latest(target: DataFrame, batch: DataFrame, keys, order: list[Column]) -> DataFrame:
    """Upsert: batch rows replace target rows of the same key; ``order`` ranks rows of one side."""
    both = target.withColumn("_side", F.lit(0)).unionByName(
        batch.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    return newest_per_key(both, keys, [F.desc("_side"), *order]).drop("_side")


def merge_newest(target: DataFrame, batch: DataFrame, keys, order: list[Column]) -> DataFrame:
    """Upsert of readings: ``order`` (the time) decides, the batch only between equals, so a late row never
    replaces a newer one."""
    both = target.withColumn("_side", F.lit(0)).unionByName(batch.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return newest_per_key(both, keys, [*order, F.desc("_side")]).drop("_side")


def merge_snapshot(target: DataFrame, batch: DataFrame, scope, keys, order: list[Column], snapshot: str) -> DataFrame:
    """Part of a snapshot into its scopes: per scope only rows of the newest snapshot id survive, whichever
    batches bring them; rows of an older snapshot that come late change nothing."""
    merged = merge_newest(target, batch, keys, [F.desc_nulls_last(snapshot), *order])
    newest = merged.groupBy(*scope).agg(F.max(snapshot).alias("_newest"))
    newest = newest.select(*[F.col(c).alias(f"_scope_{i}") for i, c in enumerate(scope)], "_newest")
    here = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_scope_{i}")) for i, c in enumerate(scope)])
    return merged.join(newest, here & F.col(snapshot).eqNullSafe(F.col("_newest")), "left_semi")


def same_values(left: DataFrame, right: DataFrame, columns, how: str) -> DataFrame:
    """Semi or anti join on ``columns`` in which NULL equals NULL."""
    other = right.select(*[F.col(c).alias(f"_same_{i}") for i, c in enumerate(columns)])
    return left.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{i}")) for i, c in enumerate(columns)]), how)


def merge_statistics(target: DataFrame, batch: DataFrame, keys, order: Column) -> DataFrame:
    """Upsert of long statistics: the batch wins, but a missing unit keeps the stored one."""
    both = target.withColumn("_rank", F.struct(F.lit(0).alias("s"), order.alias("o"))).unionByName(
        batch.withColumn("_rank", F.struct(F.lit(1).alias("s"), order.alias("o")))
    )
    rest = [c for c in target.columns if c not in keys and c != "metric_unit"]
    merged = both.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "_rank").alias("_row"),
        F.max_by("metric_unit", F.when(F.col("metric_unit").isNotNull(), F.col("_rank"))).alias("metric_unit"),
    )
    return merged.select(*keys, "_row.*", "metric_unit").select(*target.columns)


def replace_snapshot(target: DataFrame, batch: DataFrame, scope, keys, order: list[Column]) -> DataFrame:
    """Full-snapshot load: inside the scopes present in the batch only batch rows survive.
    A scope without batch rows (failed or empty extraction) keeps all its rows."""
    seen = batch.select(*scope).distinct()
    return same_values(target, seen, list(scope), "left_anti").unionByName(
        newest_per_key(batch, keys, order), allowMissingColumns=True
    )


def append_absent(history: DataFrame, batch: DataFrame, keys, time_col: str) -> DataFrame:
    """History plus batch rows whose key is not stored yet; rows without a time are skipped.
    The batch is reduced to one row per key first."""
    fresh = batch.where(F.col(time_col).isNotNull()).dropDuplicates(list(keys))
    # older rows cannot match, so the scan of the history starts at the oldest reading of the batch
    since = batch.agg(F.min(time_col)).scalar()
    new = fresh.join(history.where(F.col(time_col) >= since).select(*keys), list(keys), "left_anti")
    return history.unionByName(new)


def reconcile(stored: DataFrame, config: DataFrame, keys) -> DataFrame:
    """Stored registry against the curated one: action insert / update / delete / keep per key.

    Both sides are one row per key, so one full outer join on the key decides everything."""
    fields = [c for c in config.columns if c not in keys]
    old = stored.select(*keys, F.struct(*[F.col(c) for c in fields]).alias("_old"))
    new = config.select(*keys, F.struct(*[F.col(c) for c in fields]).alias("_new"))
    joined = old.join(new, list(keys), "full_outer")
    action = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "keep")
        .otherwise("update")
    )
    out = [F.coalesce(F.col(f"_new.{c}"), F.when(F.col("_new").isNull(), F.col(f"_old.{c}"))).alias(c)
           for c in fields]
    return joined.select(*keys, action.alias("action"), *out)


def clear_stale_members(registry: DataFrame, members: DataFrame) -> DataFrame:
    """Family id and year from the member list; datasets no longer listed lose theirs."""
    return registry.drop("family_id", "family_year").join(
        members.select("dataset_id", "family_id", "family_year"), "dataset_id", "left"
    )


def fill_year(df: DataFrame, families: DataFrame, year_col: str, label_col: str | None = None) -> DataFrame:
    """Family year where a row has none; the label only where it is empty."""
    out = df.join(families.select("dataset_id", "family_year"), "dataset_id", "left")
    if label_col:
        stamped = F.when(F.col(year_col).isNull(), F.col("family_year").cast("string"))
        out = out.withColumn(label_col, F.coalesce(F.nullif(F.col(label_col), F.lit("")), stamped, F.col(label_col)))
    return out.withColumn(year_col, F.coalesce(year_col, "family_year")).drop("family_year")


def canonical_json(props: Column, volatile=()) -> Column:
    """Property map as JSON text with sorted keys, without volatile keys."""
    kept = F.map_filter(props, lambda k, v: ~k.isin(*volatile)) if volatile else props
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def dedup_key(feature_id: Column, props: Column, geom_text: Column, volatile=()) -> Column:
    """The source id if there is one, else a hash of properties and geometry."""
    return F.coalesce(
        F.nullif(feature_id, F.lit("")), F.md5(F.concat(canonical_json(props, volatile), geom_text))
    )


def within_retention(df: DataFrame, ts: str, as_of: Column, days: int, scope: Column | None = None) -> DataFrame:
    """Rows younger than ``days``; with a scope only rows inside it can expire."""
    fresh = F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(fresh if scope is None else (~scope) | fresh)


def previous_value(df: DataFrame, keys, order: list[str], chunk: str, value: str, out: str) -> DataFrame:
    """Value of the preceding row per key, computed per time chunk.

    A plain lag would sort a hot key in one task; here only one row per chunk is ordered across
    the whole key, and rows are ordered inside their chunk."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(chunk)
    carried = (
        df.groupBy(*keys, chunk)
        .agg(F.max_by(value, F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(across))
        .drop("_last")
    )
    first = F.row_number().over(inside) == 1
    return (
        df.withColumn("_lag", F.lag(value).over(inside))
        .withColumn("_first", first)
        .join(carried, [*keys, chunk])
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_lag", "_first", "_carry")
    )


def change_log(runs: DataFrame, keys, order: list[str], chunk: str) -> DataFrame:
    """rows_added / rows_updated per run from total and loaded counts; no-op runs that follow an
    earlier entry are left out."""
    prev = previous_value(runs, keys, order, chunk, "rows_total_after", "_prev")
    added = F.greatest(F.lit(0), F.col("rows_total_after") - F.coalesce("_prev", F.lit(0)))
    out = prev.withColumn("rows_added", added).withColumn(
        "rows_updated", F.greatest(F.lit(0), F.col("rows_loaded") - F.col("rows_added"))
    )
    idle = (F.col("rows_added") == 0) & (F.col("rows_updated") == 0) & (F.col("rows_loaded") == 0)
    return out.where(~(idle & F.col("_prev").isNotNull())).drop("_prev")


def run_log(runs: DataFrame) -> DataFrame:
    """Duration and data-quality note per run."""
    raw_only = (F.col("rows_extracted") > 0) & (F.col("rows_loaded") == 0) & F.col("target").isNull()
    return runs.withColumn(
        "duration_s", F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    ).withColumn("note", F.when(raw_only, "DQ: raw-only ingest (no core rows)"))


def without_changes(payloads: DataFrame, changes: DataFrame) -> DataFrame:
    """Datasets that delivered a payload but never changed a core table."""
    return payloads.join(changes.select("dataset_id").distinct(), "dataset_id", "left_anti")


def purge(df: DataFrame, datasets: DataFrame) -> DataFrame:
    """Drop rows without a value and rows of retired datasets."""
    return df.where("metric_value is not null").join(
        datasets.select("dataset_id").distinct(), "dataset_id", "left_anti"
    )


def payload_summary(rows: DataFrame, group: str, extra: list[Column]) -> DataFrame:
    """Per dataset: record count, summary JSON (lists shown by length only) and its sha-256."""
    counted = rows.groupBy(group).agg(F.count(F.lit(1)).alias("count"), *extra)
    names = [c for c in counted.columns if c != group]
    summary = F.to_json(F.struct(*[F.col(c) for c in names]))
    return counted.select(group, "count", summary.alias("payload"), F.sha2(summary, 256).alias("checksum"))


def list_marker(values: Column) -> Column:
    return F.format_string("<list len=%d>", F.size(values))


def upsert_path(spark: SparkSession, path: str, batch: DataFrame, keys, order: list[Column],
                parts: list[str], snapshot_scope=None, merge=None) -> None:
    """Keyed upsert into a Parquet folder partitioned by ``parts``.

    Only the partitions the batch touches are read and rewritten (dynamic overwrite). Running the
    same batch again gives the same folder, so a retried micro-batch is harmless. The partition
    columns must be part of the key; NULL is a partition like any other. An empty batch changes nothing."""
    missing = [p for p in parts if p not in keys]
    if missing:
        raise ValueError(f"partition columns outside the key: {missing}")
    if batch.isEmpty():
        return
    if _exists(spark, path):
        current = _touched(spark.read.schema(batch.schema).parquet(path), batch, parts)
        if snapshot_scope:
            merged = replace_snapshot(current, batch, snapshot_scope, keys, order)
        elif merge:
            merged = merge(current, newest_per_key(batch, keys, order))
        else:
            merged = merge_latest(current, batch, keys, order)
    else:
        merged = newest_per_key(batch, keys, order)
    (
        merged.select(*batch.columns)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*parts)
        .parquet(path)
    )


def _touched(stored: DataFrame, batch: DataFrame, parts: list[str]) -> DataFrame:
    """Stored rows in the partitions of the batch, any number of them, NULL included. The range of each
    partition column is a static filter, so folders outside it are not opened; the join does the rest."""
    # an empty text and NULL share one folder
    seen = batch.select(*[F.nullif(F.col(p), F.lit("")).alias(p) if batch.schema[p].dataType.simpleString() == "string" else F.col(p) for p in parts]).distinct()
    ends = seen.agg(*[f(p).alias(f"{n}_{i}") for i, p in enumerate(parts) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for i, p in enumerate(parts):
        if ends[f"lo_{i}"] is None:
            stored = stored.where(F.col(p).isNull())
        else:
            stored = stored.where(F.col(p).isNull() | F.col(p).between(ends[f"lo_{i}"], ends[f"hi_{i}"]))
    return same_values(stored, seen, parts, "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
