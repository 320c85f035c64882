"""Batch ingest of one landed dataset: route, read, reshape, resolve, upsert, account.

Scheduling and fetching belong to the platform; the input is a contract and a landed file.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from civicspark import schemas
from civicspark.operators import loaders, reshape, resolve, state
from civicspark.session import settled
from civicspark.sources import archives, delimited, jsonfiles
from civicspark.sources.tables import LAYOUT, laid_out

STATISTICS_API = "statistik.leipzig.de/opendata/api"  # fixed value
UNDECODED = ("XLSX", "XLS", "ODS", "SHP", "GPKG")  # formats without a reader here
RESOLVABLE_LEVELS = ("ortsteil", "stadtbezirk", "wahlbezirk")  # fixed value


@dataclass(frozen=True)
class Target:
    """A core table below ``folder`` with its upsert key."""

    folder: str
    name: str
    keys: tuple[str, ...]

    @property
    def path(self) -> str:
        return f"{self.folder}/{self.name}"

    def upsert(self, spark: SparkSession, batch: DataFrame, sweep: bool = False) -> None:
        """Rows numbered by ``_row``: of those with one key the last wins; a missing unit keeps an earlier one."""
        parts, _ = LAYOUT[self.name]
        batch = laid_out(batch, self.name)
        keys = list(dict.fromkeys((*self.keys, *parts)))
        unit = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_row"))).alias(c) for c in batch.columns if c == "metric_unit"]
        rest = [c for c in batch.columns if c not in (*keys, "_row", "metric_unit")]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_row").alias("_last"), *unit)
        batch = last.select("*", "_last.*").select(*[c for c in batch.columns if c != "_row"])
        order = [F.desc_nulls_last(c) for c in batch.columns if c not in (*keys, "coords")]
        merge = None
        if self.name == "statistics":
            merge = lambda old, new: state.merge_statistics(old, new, keys, F.col("metric_value"))
        state.upsert_path(spark, self.path, batch, keys, order, parts, ["dataset_id"] if sweep else None, merge)


KEYS = {
    "statistics": schemas.STATISTICS_KEY, "geo_features": schemas.FEATURE_KEY, "traffic_restrictions": schemas.FEATURE_KEY,
    "election_results": schemas.ELECTION_KEY, "bicycle_counts": schemas.COUNT_KEY,
}


def route(spark: SparkSession, contract: dict[str, Any], is_election: bool = False) -> tuple[str, str | None, bool]:
    """(target, detail, sweep) of one contract by the same rules that route a whole catalog."""
    one = spark.createDataFrame(
        [(contract.get("name") or "", contract.get("url") or "", contract.get("format") or "")], "name string, url string, format string")
    row = reshape.route_target(one, F.lit(is_election)).first()
    return row["target"], row["detail"], row["sweep"]


def _records(spark: SparkSession, contract: dict[str, Any], landed: str) -> DataFrame:
    fmt = contract["format"].upper()
    if fmt == "JSON":
        return jsonfiles.read_records(spark, landed, order="_row")
    if fmt == "XML":
        return _json_rows(archives.xml_records(archives.read_binary(spark, landed)), "record")
    return delimited.read_delimited(spark, landed, order="_row")


def _json_rows(df: DataFrame, column: str) -> DataFrame:
    """Records kept as JSON texts become columns; the header set is one distinct aggregate of key names."""
    names = sorted(r["k"] for r in df.select(F.explode(F.json_object_keys(column)).alias("k")).distinct().collect())
    parsed = F.from_json(column, "map<string,string>")
    return df.select(parsed.alias("m")).select(*[F.col("m")[n].alias(n) for n in names])


def _numbered(df: DataFrame) -> DataFrame:
    """With the place of each row in its file, if the reader has not told it."""
    return df if "_row" in df.columns else df.withColumn("_row", F.monotonically_increasing_id())


def _order(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "_row"]


def statistics_rows(records: DataFrame, contract: dict[str, Any]) -> DataFrame:
    """Long statistics of a record source; the city statistics layouts are melted first."""
    hints = contract.get("hints") or {}
    default = hints.get("year") or contract.get("family_year")
    dataset = F.lit(contract["id"])
    unit, key_column = hints.get("spatial_unit") or "city", hints.get("spatial_key_column")
    if STATISTICS_API in (contract.get("url") or ""):
        is_area = "kdvalues" in contract["url"]
        rows = _numbered(records)
        if is_area:
            cells = reshape.melt_areas(rows, "_row").withColumn("unit", F.lit(None).cast("string"))
        elif contract["format"].upper() == "JSON":
            cells = reshape.melt_json_long(rows, "_row")
        else:
            cells = reshape.melt_values(rows, "_row")
        label, year, quarter, month = reshape.parse_period(F.col("period"), F.lit(default))
        usable = cells.where(reshape.tx.is_number(F.col("value")))
        long = usable.select(
            dataset.alias("dataset_id"), F.lit("year").alias("period_type"), label.alias("period_label"), year.alias("period_year"),
            quarter.alias("period_quarter"), month.alias("period_month"),
            (F.lit("ortsteil") if is_area else F.lit(unit)).alias("spatial_unit"),
            (F.col("area") if is_area else F.lit(reshape.DEFAULT_KEY)).alias("spatial_key"), "metric_name",
            reshape.tx.to_number(F.col("value")).alias("metric_value"), F.col("unit").alias("metric_unit"))
    else:
        long = reshape.generic_to_long(records, dataset, unit, key_column, default, hints.get("skip_columns") or (),
                                       _order(records)).withColumn(
            "metric_unit", F.lit(None).cast("string"))
    return long.withColumn("spatial_code", F.lit(None).cast("string"))


def load_dataset(spark: SparkSession, contract: dict[str, Any], landed: str, folder: str, boundaries: DataFrame | None = None,
                 election: dict[str, Any] | None = None) -> dict[str, Any]:
    """Load one landed file into its core table and return the run: status, target, counts, note.

    ``election`` carries election_id, vote_mode, parties and level for election files."""
    where, detail, whole = route(spark, contract, election is not None)
    run = {"dataset_id": contract["id"], "status": "success", "target": None, "rows_loaded": 0, "note": None}
    if where == "skip":
        return {**run, "status": "skipped", "note": detail}
    year = (contract.get("hints") or {}).get("year") or contract.get("family_year")
    fmt = contract["format"].upper()
    if fmt in UNDECODED:
        return {**run, "status": "skipped", "note": f"no reader for {fmt}; land it as CSV or GeoJSON"}
    sweep = False
    if where == "by_content":
        zipped = archives.zip_rows(archives.read_binary(spark, landed))
        kind = zipped.select("kind").first()["kind"]
        where = {"GeoJSON": "geo_features", "CSV": "statistics"}.get(kind, "summary")
        payload, detail = zipped.where("payload is not null"), (contract.get("name") or "")[:64]  # the same label as of other geodata
    if where == "summary":
        return {**run, "note": "DQ: raw-only ingest (no core rows)"}
    if where in ("geo_features", "traffic_restrictions"):
        if fmt == "GTFS":
            feats = archives.gtfs_stops(archives.read_binary(spark, landed))
        elif fmt == "ZIP":
            parsed = payload.select(F.from_json("payload", jsonfiles.FEATURE).alias("f")).select("f.*")
            feats = jsonfiles.geojson_features(parsed.withColumn("epsg", F.lit(4326)))
        else:
            feats = jsonfiles.read_geojson(spark, landed, order="_row")
            sweep = whole
        rows = (
            loaders.restriction_rows(feats, contract["id"], detail, _order(feats)) if where == "traffic_restrictions"
            else loaders.feature_rows(feats, contract["id"], detail, year, _order(feats)))
        rows = _numbered(rows)
    elif where == "bicycle_counts":
        records = _records(spark, contract, landed)
        rows = _numbered(loaders.count_rows(records, carry=_order(records)).where("period_start is not null"))
    elif where == "election_results":
        records = _records(spark, contract, landed)
        rows = reshape.election_unpivot(records, election["parties"], election["vote_mode"], election["level"], _order(records))
        rows = rows.withColumn("election_id", F.lit(election["election_id"])).withColumn("dataset_id", F.lit(contract["id"]))
        rows = _with_codes(_numbered(rows.withColumn("spatial_code", F.lit(None).cast("string"))), boundaries, "level", "gebiet_code")
    else:
        records = _json_rows(payload, "payload") if fmt == "ZIP" else _records(spark, contract, landed)
        rows = _with_codes(_numbered(statistics_rows(records, contract)), boundaries, "spatial_unit", "spatial_key")
        rows = rows.select(*[f.split()[0] for f in schemas.STATISTICS.split(", ")], "_row")
    # read and reshaped once: the write that the upsert starts from also counts, and outlives lost executors
    seen = Observation("load")
    rows = settled(rows.observe(seen, F.count(F.lit(1)).alias("n")), "load")
    loaded = seen.get["n"]
    if loaded:
        Target(folder, where, KEYS[where]).upsert(spark, rows, sweep)
    return {**run, "target": where, "rows_loaded": loaded}


def _with_codes(rows: DataFrame, boundaries: DataFrame | None, unit: str, key: str) -> DataFrame:
    """Canonical codes for resolvable levels; each distinct key is resolved once."""
    if boundaries is None:
        return rows
    renamed = rows.withColumnsRenamed({unit: "spatial_unit", key: "spatial_key"})
    coded = resolve.backfill_codes(renamed, boundaries, resolve.derive_aliases(boundaries), RESOLVABLE_LEVELS)
    return coded.withColumnsRenamed({"spatial_unit": unit, "spatial_key": key})


RUN_FIELDS = ("dataset_id string, status string, target string, rows_loaded bigint, rows_extracted bigint, note string, "
              "run_id string, started_at timestamp, finished_at timestamp, rows_total_after bigint, day date")


def record_run(spark: SparkSession, folder: str, run: dict[str, Any], run_id: str, started_at, finished_at) -> None:
    """Append one run, skipped ones included, with the rows its dataset now holds. The change log is
    ``state.change_log`` over these rows."""
    total = None
    if run["target"]:
        table = spark.read.parquet(f"{folder}/{run['target']}")
        total = (table.where(F.col("dataset_id") == run["dataset_id"]) if "dataset_id" in table.columns else table).count()
    row = (run["dataset_id"], run["status"], run["target"], run["rows_loaded"], run.get("rows_extracted", run["rows_loaded"]), run["note"], run_id,
           started_at, finished_at, total, started_at.date())
    spark.createDataFrame([row], RUN_FIELDS).coalesce(1).write.mode("append").partitionBy("day").parquet(f"{folder}/runs")
