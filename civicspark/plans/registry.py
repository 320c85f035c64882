"""Query and oracle registration."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same question for a SQL engine over the same tables."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


_OPENED: dict[tuple[str, str], object] = {}


class Tables:
    """Lazy readers: ``t.orders`` is the orders table of this scale. The tables never change, so a
    reader (schema and file list, no data) is opened once per application."""

    def __init__(self, spark, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        key = (self.spark.sparkContext.applicationId, self.path(name))
        if key not in _OPENED:
            _OPENED[key] = self.spark.read.parquet(self.path(name))
        return _OPENED[key]
