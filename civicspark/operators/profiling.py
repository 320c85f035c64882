"""Column profiles and histograms. All columns of a kind are profiled in one pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from civicspark.functions import text as tx
from civicspark.functions.numeric import bucket_of, describe_groups
from civicspark.operators.state import top_per_key
from civicspark.session import settled

BUCKETS = 20  # fixed value
NUMERIC_SHARE = 0.8  # fixed value
MAX_PROPERTY_KEYS = 12  # fixed value: keys of the report


def _null_share() -> Column:
    return 1 - F.col("non_null") / F.nullif(F.col("n"), F.lit(0))


def profile_numeric(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """n, non_null, null_share, min, max, mean, exact median and sample deviation per column."""
    keys = keys or []
    long = df.unpivot(keys, [F.col(c).cast("double").alias(c) for c in columns], "column", "value")
    return numeric_groups(long, [*keys, "column"], "value")


def numeric_groups(long: DataFrame, keys: list[str], value: str, *extra: Column) -> DataFrame:
    return describe_groups(long, keys, value, *extra).withColumn("null_share", _null_share())


def profile_categorical(df: DataFrame, columns: list[str], k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(head, top): counts and distinct values per column; the k most frequent values, ties by value."""
    counts = (
        df.unpivot([], [F.col(c).cast("string").alias(c) for c in columns], "column", "value")
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    head = counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
        F.count("value").alias("distinct_n"))
    top = top_per_key(counts.where("value is not null"), ["column"], [F.desc("n"), F.asc("value")], k)
    return head, top


def profile_temporal(df: DataFrame, columns: list[str]) -> DataFrame:
    long = df.unpivot([], [F.col(c).cast("timestamp_ntz").alias(c) for c in columns], "column", "value")
    return long.groupBy("column").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def profile_metrics(stats: DataFrame, k: int = 30) -> DataFrame:
    """Each metric of a long table profiled like a column; the k largest by rows."""
    years = [F.min("period_year").alias("year_min"), F.max("period_year").alias("year_max")]
    largest = stats.groupBy("metric_name").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), F.asc("metric_name")).limit(k)
    chosen = stats.join(largest.select("metric_name"), "metric_name", "left_semi")
    return numeric_groups(chosen, ["metric_name"], "metric_value", *years)


def distributions(df: DataFrame, columns: list[str], keys: list[str], k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(head, top) per group and column: n, non_null and distinct values; the k most frequent values, ties by value.

    All columns are counted in one scan and one shuffle, as grouping sets of the keys with each of them."""
    sets = [[F.col(c) for c in (*keys, column)] for column in columns]
    name = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c).cast("string")) for c in columns])
    counted = df.groupingSets(sets, *keys, *columns).agg(F.count(F.lit(1)).alias("n"), name.alias("column"), value.alias("value"))
    counts = settled(counted.select(*keys, "column", "value", "n"), "distributions")
    head = counts.groupBy(*keys, "column").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("value").alias("distinct_n"))
    top = top_per_key(counts.where("value is not null"), [*keys, "column"], [F.desc("n"), F.asc("value")], k)
    return head, top


def profile_places(stats: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Distributions of area keys and period labels per dataset of a long table."""
    return distributions(stats, ["spatial_key", "period_label"], ["dataset_id"], k)


def profile_shapes(features: DataFrame) -> DataFrame:
    """Per dataset the features of each geometry type, and in the row without a type all of them with their range of
    years; one scan."""
    sets = [[F.col("dataset_id"), F.col("geom_type")], [F.col("dataset_id")]]
    whole = F.grouping("geom_type") == 1
    return features.groupingSets(sets, "dataset_id", "geom_type").agg(
        F.count(F.lit(1)).alias("n"), F.when(whole, F.min("year")).alias("year_min"), F.when(whole, F.max("year")).alias("year_max"),
        F.when(whole, F.count_distinct("geom_type")).alias("distinct_n"), whole.alias("is_total"))


def property_keys(features: DataFrame, sample: int | None = None, order: str = "feature_id",
                  k: int = MAX_PROPERTY_KEYS) -> DataFrame:
    """Most frequent property keys and whether they look numeric. With ``sample`` only the first
    rows by ``order`` are looked at, as a bounded preview; None looks at all rows."""
    rows = features.where("properties is not null")
    if sample is not None:
        rows = rows.orderBy(order).limit(sample)
    pairs = rows.select(F.explode(F.from_json("properties", "map<string,string>")).alias("key", "value"))
    keyed = pairs.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("non_null"),
        F.count_if(tx.parse_number(F.col("value")).isNotNull()).alias("numeric_n"))
    top = keyed.orderBy(F.desc("n"), F.asc("key")).limit(k)
    return top.withColumn("is_numeric", F.coalesce(F.col("numeric_n") / F.nullif(F.col("non_null"), F.lit(0)), F.lit(0.0)) >= NUMERIC_SHARE)


def _property_rows(features: DataFrame, keys: DataFrame) -> DataFrame:
    """(feature row id, key, value) of the chosen keys over all features, one row per feature and key."""
    pairs = features.select(F.explode(F.from_json("properties", "map<string,string>")).alias("key", "value"))
    return pairs.join(keys.select("key", "is_numeric"), "key")


def profile_properties(features: DataFrame, keys: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(numeric, top): numeric profile of numeric keys, top values of the others, over all features."""
    rows = _property_rows(features, keys)
    numbers = rows.where("is_numeric").select("key", tx.parse_number(F.col("value")).alias("value"))
    counts = rows.where("not is_numeric and value is not null").groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return numeric_groups(numbers, ["key"], "value"), top_per_key(counts, ["key"], [F.desc("n"), F.asc("value")], k)


def histogram(df: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """Equal-width histogram per group: the largest value falls into the last bucket, empty buckets
    count zero, a constant group has one bucket, an empty group none."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    # settled, so that the rows meet a broadcast of the ranges instead of a shuffle
    span = settled(rows.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")), "histogram-range")
    spot = bucket_of(F.col("_v"), F.col("lo"), F.col("hi"), buckets)
    counted = rows.join(span, keys).groupBy(*keys, spot.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    last = F.when(F.col("hi") > F.col("lo"), buckets - 1).otherwise(0)
    frame = span.withColumn("bucket", F.explode(F.sequence(F.lit(0), last)))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / buckets).otherwise(F.lit(0.0))
    return frame.join(counted, [*keys, "bucket"], "left").select(
        *keys, "bucket", (F.col("lo") + F.col("bucket") * width).alias("lo"),
        F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("bucket") + 1) * width).otherwise(F.col("hi")).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"))


# --- dataset statistics -------------------------------------------------------------------------------

def metric_stats(stats: DataFrame, k: int = 50) -> DataFrame:
    return stats.groupBy("metric_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("metric_value").alias("min"), F.max("metric_value").alias("max"),
        F.avg("metric_value").alias("avg"), F.min("period_year").alias("year_min"), F.max("period_year").alias("year_max"),
    ).orderBy(F.desc("n"), F.asc("metric_name")).limit(k)


def metric_head(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("spatial_key").alias("keys"),
                     F.count_distinct("metric_name").alias("metrics"))


def feature_type_stats(features: DataFrame, seen: str, k: int = 20) -> DataFrame:
    return features.groupBy("feature_type").agg(
        F.count(F.lit(1)).alias("n"), F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"),
    ).orderBy(F.desc("n"), F.asc_nulls_last("feature_type")).limit(k)


def restriction_stats(restrictions: DataFrame, active: Column) -> DataFrame:
    return restrictions.groupBy("restriction_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(active, F.lit(False))).alias("active"))


def site_stats(feed: DataFrame, k: int = 30) -> DataFrame:
    pct = F.when(F.col("total") > 0, F.col("occupied") / F.col("total") * 100)
    return feed.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(pct).alias("avg_pct"), F.max(pct).alias("max_pct"),
    ).orderBy(F.desc_nulls_last("n"), F.asc("site_id")).limit(k)


def counter_stats(counts: DataFrame, k: int = 30) -> DataFrame:
    return counts.groupBy("counter_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("count_value").alias("total"), F.avg("count_value").alias("mean"),
    ).orderBy(F.desc_nulls_last("total"), F.asc("counter_id")).limit(k)


def counter_daily(counts: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """Daily total per counter inside the window."""
    fresh = counts.where(F.col("period_start") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    return fresh.groupBy("counter_id", F.to_date("period_start").alias("day")).agg(
        F.sum("count_value").alias("total"), F.max("period_start").alias("last_seen"))


def counter_series(daily: DataFrame) -> DataFrame:
    """Ordered (day, total) array per counter; at most one entry per day of the window."""
    return daily.groupBy("counter_id").agg(F.array_sort(F.collect_list(F.struct("day", "total"))).alias("series"))
