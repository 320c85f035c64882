"""The batch ingest over two snapshots of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark import ingest
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.session import work_path
from civicspark.sources import delimited


@query("ingest_snapshots", """
WITH c AS (SELECT count(c_acctbal) FILTER (WHERE c_custkey % 2 = 1 AND c_acctbal > 0) a, count(c_acctbal) FILTER (WHERE c_custkey % 2 = 1) b,
  count(c_acctbal) FILTER (WHERE c_custkey % 2 = 0) e FROM customer),
r AS (SELECT 's1-00000' run_id, 'odd' dataset_id, 'success' status, a rows_loaded, a rows_added, 0 rows_updated, a rows_total_after, b last FROM c
 UNION ALL SELECT 's1-00001', 'even', 'success', e, e, 0, e, e FROM c
 UNION ALL SELECT 's2-00000', 'odd', 'success', b, b - a, a, b, b FROM c
 UNION ALL SELECT 's2-00001', 'even', 'skipped', 0, NULL, NULL, NULL, e FROM c)
SELECT run_id, dataset_id, status, CAST(rows_loaded AS BIGINT) rows_loaded, CAST(rows_added AS BIGINT) rows_added,
 CAST(rows_updated AS BIGINT) rows_updated, CAST(rows_total_after AS BIGINT) rows_total_after,
 '{"count":' || last || '}' payload, sha256('{"count":' || last || '}') checksum FROM r
""")
def ingest_snapshots(t: Tables):
    # the second snapshot of one dataset has more rows, the file of the other is the same
    def rows(which: str):
        return t.customer.where(which).select(
            F.col("c_custkey").cast("string").alias("ortsteil"), F.col("c_acctbal").cast(roles.MONEY).cast("string").alias("wert"))

    folder, landed = work_path(t.spark, "tables"), work_path(t.spark, "landed")
    for name, part in (("odd1", "c_custkey % 2 = 1 and c_acctbal > 0"), ("odd2", "c_custkey % 2 = 1"), ("even", "c_custkey % 2 = 0")):
        delimited.write_delimited(rows(part), f"{landed}/{name}")
    hints = {"spatial_unit": "kunde", "spatial_key_column": "ortsteil", "year": 2020}
    contract = lambda name, file: {"id": name, "name": name, "url": f"https://x/{name}", "format": "CSV",
                                   "landed": f"{landed}/{file}", "hints": hints}
    for batch in ("s1", "s2"):
        ingest.run_batch(t.spark, [contract("odd", f"odd{batch[1]}"), contract("even", "even")], folder, batch=batch)
    runs = t.spark.read.parquet(f"{folder}/runs").select("run_id", "dataset_id", "status", "rows_loaded")
    log = ingest.changes(t.spark, folder).select("run_id", "rows_added", "rows_updated", "rows_total_after")
    last = ingest.latest_payloads(t.spark, folder).select("dataset_id", "payload", "checksum")
    return runs.join(log, "run_id", "left").join(last, "dataset_id")
