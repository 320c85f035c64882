"""Batch run over the contracts of a schedule: change detection, load, run log, payload summary, change log.

Two tables stand beside the core tables of a folder and only grow: ``runs`` (one row per contract and batch,
skipped and failed ones included) and ``payloads`` (validator and summary of every load; the newest counts).
The change log is a view of the runs. A contract names its landed files in ``landed``; the loop over contracts
is a list the caller holds, and every load is a Spark job of its own.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from civicspark import jobs
from civicspark.operators import reshape, state
from civicspark.sources import jsonfiles

PAYLOAD = ("dataset_id string, resource_url string, format string, etag string, payload string, checksum string, "
           "ingested_at timestamp, day date")


def validator(spark: SparkSession, landed: str) -> str:
    """Names, sizes and times of the landed files in one value; contents are not opened."""
    files = spark.read.format("binaryFile").load(landed).select("path", "length", "modificationTime")
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"),
                    F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("mark")).first()
    return f"{row['n']}-{row['size']}-{row['mark']}"


def latest_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The last load of every dataset."""
    path = f"{folder}/payloads"
    if not state._exists(spark, path):
        return spark.createDataFrame([], PAYLOAD)
    return state.newest_per_key(spark.read.schema(PAYLOAD).parquet(path), ["dataset_id"], [F.desc("ingested_at"), F.asc("checksum")])


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Added and updated rows per run that reached a core table."""
    runs = spark.read.schema(jobs.RUN_FIELDS).parquet(f"{folder}/runs").where("target is not null and status = 'success'")
    return state.change_log(runs, ["dataset_id", "target"], ["started_at", "run_id"], "day")


def statuses(spark: SparkSession, contracts: list[dict[str, Any]], folder: str, forced: Iterable[str] = ()) -> dict[str, tuple[str, str | None]]:
    """(status, validator) per contract: new, changed, unchanged or reload. A contract without ``etag`` is known by
    its landed files. A forced dataset without rows in its table is loaded again, changed or not."""
    marks = {c["id"]: c.get("etag") or (validator(spark, c["landed"]) if c.get("landed") else None) for c in contracts}
    forced = set(forced)
    manifest = spark.createDataFrame([(i, m, i in forced) for i, m in marks.items()], "dataset_id string, etag string, forced boolean")
    results = f"{folder}/election_results"
    if forced and state._exists(spark, results):
        loaded = spark.read.parquet(results).join(manifest.where("forced"), "dataset_id", "left_semi").select("dataset_id")
    else:
        loaded = spark.createDataFrame([], "dataset_id string")
    stored = latest_payloads(spark, folder).select("dataset_id", "etag")
    found = reshape.change_status(manifest, stored, loaded, F.col("forced"))
    return {r["dataset_id"]: (r["status"], r["etag"]) for r in found.collect()}  # a row per contract of the call


def _raw_records(spark: SparkSession, contract: dict[str, Any]) -> int:
    """Records of a file that reaches no core table."""
    if (contract.get("format") or "").upper() == "JSON":
        return jsonfiles.read_records(spark, contract["landed"]).count()
    return spark.read.text(contract["landed"]).count()


def run_batch(spark: SparkSession, contracts: list[dict[str, Any]], folder: str, boundaries: DataFrame | None = None,
              elections: dict[str, dict[str, Any]] | None = None, batch: str | None = None) -> list[dict[str, Any]]:
    """Load what is new or changed and account for everything; one run per contract.

    ``elections`` names the layout of election files by dataset id. A file without a validator from the last load is
    loaded. A load that fails leaves its validator as it was, is logged as failed with the reason, and the rest goes
    on; the next batch tries it again. Run ids are the batch and the contract's place."""
    elections = elections or {}
    batch = batch or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S")
    known = statuses(spark, contracts, folder, elections)
    done = []
    for place, contract in enumerate(contracts):
        started, run_id = dt.datetime.now(dt.timezone.utc), f"{batch}-{place:05d}"
        status, etag = known[contract["id"]]
        run = {"dataset_id": contract["id"], "status": "skipped", "target": None, "rows_loaded": 0, "note": "unchanged"}
        if status != "unchanged":
            try:
                run = jobs.load_dataset(spark, contract, contract.get("landed") or "", folder, boundaries, elections.get(contract["id"]))
                if run["status"] == "success":
                    run["rows_extracted"] = run["rows_loaded"] if run["target"] else _raw_records(spark, contract)
                    _keep_payload(spark, folder, contract, etag, run["rows_extracted"], started)
            except Exception as problem:  # one broken file must not stop the batch
                run = {**run, "status": "failed", "target": None, "rows_loaded": 0, "note": f"{type(problem).__name__}: {problem}"}
        jobs.record_run(spark, folder, run, run_id, started, dt.datetime.now(dt.timezone.utc))
        done.append({**run, "run_id": run_id, "change": status})
    return done


def _keep_payload(spark: SparkSession, folder: str, contract: dict[str, Any], etag: str | None, count: int, at: dt.datetime) -> None:
    row = [(contract["id"], contract.get("url"), contract.get("format"), etag, json.dumps({"count": count}, separators=(",", ":")), at, at.date())]
    rows = spark.createDataFrame(row, "dataset_id string, resource_url string, format string, etag string, payload string, ingested_at timestamp, day date")
    rows = rows.withColumn("checksum", F.sha2("payload", 256))
    rows.coalesce(1).write.mode("append").partitionBy("day").parquet(f"{folder}/payloads")
