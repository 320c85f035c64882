"""Core tables as partitioned Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# partition columns (part of each key) and the order inside files that row-group statistics use
LAYOUT = {
    "statistics": (["dataset_id"], ["spatial_unit", "metric_name", "period_year"]),
    "geo_features": (["dataset_id"], ["xmin", "ymin"]),
    "traffic_restrictions": (["dataset_id"], ["valid_until"]),
    "election_results": (["election_id"], ["level", "gebiet_code"]),
    "bicycle_counts": (["count_period", "month"], ["counter_id", "period_start"]),
}


def laid_out(df: DataFrame, name: str) -> DataFrame:
    """With the partition columns that follow from the key: a poll rewrites its own months and leaves the
    rest of the history alone."""
    if name == "bicycle_counts":
        return df.withColumn("month", F.date_format("period_start", "yyyy-MM"))
    return df


def write_table(df: DataFrame, folder: str, name: str) -> None:
    """Full rewrite in the table's layout. Range partitioning over partition and sort columns spreads a
    dataset that holds a third of all rows over many files."""
    parts, order = LAYOUT[name]
    (
        laid_out(df, name).repartitionByRange(*parts, *order).sortWithinPartitions(*parts, *order)
        .write.mode("overwrite").partitionBy(*parts).parquet(f"{folder}/{name}"))


def read_table(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}")
