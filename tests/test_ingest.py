"""The batch run: change detection, accounting, failures."""

import json
import os

from civicspark import ingest
from civicspark.sources.tables import laid_out, write_table


def _land(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def _files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_second_batch_loads_only_what_changed(spark, tmp_path):
    folder = str(tmp_path / "t")
    a = {"id": "a", "name": "a", "url": "u", "format": "CSV", "landed": _land(tmp_path / "a.csv", "ortsteil,wert\nA,1\nB,2\n")}
    b = {"id": "b", "name": "b", "url": "u", "format": "CSV", "etag": "x", "landed": _land(tmp_path / "b.csv", "ortsteil,wert\nA,1\n")}
    raw = {"id": "raw", "name": "raw", "url": "u", "format": "JSON", "landed": _land(tmp_path / "r.json", json.dumps([{"k": 1}, {"k": 2}]))}
    broken = {"id": "bad", "name": "bad", "url": "u", "format": "CSV", "landed": str(tmp_path / "bad"), "etag": "y"}
    none = {"id": "none", "name": "n", "url": "", "format": "CSV"}
    first = ingest.run_batch(spark, [a, b, raw, broken, none], folder, batch="1")
    assert [(r["status"], r["rows_loaded"]) for r in first] == [("success", 2), ("success", 1), ("success", 0), ("failed", 0), ("skipped", 0)]
    assert first[2]["note"].startswith("DQ") and first[3]["change"] == "new"
    kept = _files(f"{folder}/statistics/dataset_id=a")
    _land(tmp_path / "b.csv", "ortsteil,wert\nA,5\nC,7\n")
    _land(tmp_path / "bad", "ortsteil,wert\nA,1\n")
    second = ingest.run_batch(spark, [a, {**b, "etag": "z"}, raw, broken, none], folder, batch="2")
    assert [(r["change"], r["status"]) for r in second] == [
        ("unchanged", "skipped"), ("changed", "success"), ("unchanged", "skipped"), ("new", "success"), ("new", "skipped")]
    assert _files(f"{folder}/statistics/dataset_id=a") == kept
    log = {r["run_id"]: (r["rows_added"], r["rows_updated"], r["rows_total_after"]) for r in ingest.changes(spark, folder).collect()}
    assert log == {"1-00000": (2, 0, 2), "1-00001": (1, 0, 1), "2-00001": (1, 1, 2), "2-00003": (1, 0, 1)}
    payloads = {r["dataset_id"]: (r["etag"], r["payload"]) for r in ingest.latest_payloads(spark, folder).collect()}
    assert payloads["b"] == ("z", '{"count":2}') and payloads["raw"][1] == '{"count":2}' and set(payloads) == {"a", "b", "raw", "bad"}


def test_election_without_rows_is_loaded_again(spark, tmp_path):
    contracts = [{"id": i, "etag": "same"} for i in ("e", "f", "g")]
    folder = str(tmp_path / "t")
    for c in contracts:
        ingest._keep_payload(spark, folder, {**c, "url": "u", "format": "CSV"}, "same", 1, ingest.dt.datetime(2024, 1, 1, tzinfo=ingest.dt.timezone.utc))
    assert {k: s for k, (s, _) in ingest.statuses(spark, contracts, folder, ["e", "f"]).items()} == {"e": "reload", "f": "reload", "g": "unchanged"}
    spark.createDataFrame([("f", "x")], "dataset_id string, election_id string").write.parquet(f"{folder}/election_results")
    assert {k: s for k, (s, _) in ingest.statuses(spark, contracts, folder, ["e", "f"]).items()} == {"e": "reload", "f": "unchanged", "g": "unchanged"}


def test_counts_lie_by_month(spark, tmp_path):
    rows = spark.sql("""select 'c1' counter_id, 'hour' count_period, timestamp'2024-01-31 23:00:00' period_start, 1 count
                        union all select 'c1', 'hour', timestamp'2024-02-01 00:00:00', 2""")
    write_table(rows, str(tmp_path), "bicycle_counts")
    assert sorted(os.listdir(tmp_path / "bicycle_counts" / "count_period=hour"))[-2:] == ["month=2024-01", "month=2024-02"]
    assert "month" in laid_out(rows, "bicycle_counts").columns and laid_out(rows, "statistics") is rows
