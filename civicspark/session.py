"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "civicspark", cores: str | int = "*", **conf: str) -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", os.environ.get("CIVICSPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_BASE: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder the cluster names.

    Only a local master may fall back to a temporary folder: on a cluster such
    a folder would exist on one machine only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset; name a folder every executor can reach")
        app = spark.sparkContext.applicationId
        base = _LOCAL_BASE.setdefault(app, tempfile.mkdtemp(prefix="civicspark-"))
    return f"{base.rstrip('/')}/civicspark/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """A derived side table written to the shared folder and read back.

    Spark then knows its real size and broadcasts it only below its threshold, instead of shuffling
    the large side of a join because the size of an aggregate is unknown. The files also survive a
    lost executor."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
