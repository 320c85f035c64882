"""Physical plans of hot operators, and answers on a skewed table."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from civicspark.functions.numeric import describe_groups
from civicspark.operators import analytics as an, profiling as pf, state as st, tiles as tl


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dedupe_newest", "statistics_latest", "latest_per_site", "upsert_features", "choropleth", "catalog_samples"])
def test_top_rows_are_limited_before_the_shuffle(spark, sf_dir, name):
    plan = plan_of(entry.queries()[name](spark, sf_dir))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name, unused", [
    ("pearson_full", ["l_tax", "l_shipdate", "l_orderkey"]), ("stats_counter", ["props", "event_type"]), ("conflict_check", ["l_extendedprice", "l_partkey"]),
    ("dataset_status", ["props"]), ("tile_clusters", ["c_name", "c_acctbal"])])
def test_scans_read_only_what_is_needed(spark, sf_dir, name, unused):
    schemas = " ".join(re.findall(r"ReadSchema: (struct<.*?>)", plan_of(entry.queries()[name](spark, sf_dir))))
    assert schemas and not [c for c in unused if f"{c}:" in schemas]


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(entry.queries()["purge"](spark, sf_dir))
    assert "EqualTo(p_brand,Brand#3)" in plan
    assert "In(event_type" in plan_of(entry.queries()["upsert_restrictions"](spark, sf_dir)) or "EqualTo(event_type" in plan_of(
        entry.queries()["upsert_restrictions"](spark, sf_dir))


def test_group_ranges_are_broadcast_by_their_real_size(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    for out in (pf.histogram(df, ["g"], "v"), an.power_sums(df.withColumn("y", F.col("v") * 2), ["g"], "v", "y", 1)):
        assert "BroadcastHashJoin" in plan_of(out)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, and that key has the most distinct values."""
    hot = spark.range(30000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 10007).cast("double").alias("v"), "id")
    rest = spark.range(60000).select((F.col("id") % 300).cast("string").alias("k"), (F.col("id") * 104729 % 97).cast("double").alias("v"), "id")
    return hot.unionByName(rest).repartition(8).persist()


def test_skewed_medians_match_the_builtin(spark, skewed):
    ours = {r["k"]: (r["n"], r["median"]) for r in describe_groups(skewed, ["k"], "v", accuracy=64).collect()}
    theirs = {r["k"]: (r["n"], r["m"]) for r in skewed.groupBy("k").agg(F.count("v").alias("n"), F.expr("percentile(v, 0.5)").alias("m")).collect()}
    assert ours == theirs


def test_skewed_newest_and_top(spark, skewed):
    newest = {r["k"]: r["id"] for r in st.newest_per_key(skewed, ["k"], [F.desc("v"), F.desc("id")]).collect()}
    want = {r["k"]: r["m"]["id"] for r in skewed.groupBy("k").agg(F.max(F.struct("v", "id")).alias("m")).collect()}
    assert newest == want
    top = st.top_per_key(skewed, ["k"], [F.desc("v"), F.asc("id")], 5000, [F.col("id") % 16])
    assert top.where("k = 'hot'").count() == 5000 and top.count() == 5000 + 60000


def test_skewed_tiles_keep_every_point(spark, skewed):
    feats = skewed.select(
        F.col("k").alias("dataset_id"), F.concat("k", F.lit("-"), F.col("id").cast("string")).alias("feature_id"), F.lit("Point").alias("geom_type"),
        F.lit(2020).alias("year"), F.array(F.array(F.array(F.array(F.when(F.col("k") == "hot", 12.3700).otherwise(12.0 + F.col("v") / 200), F.lit(51.3301))))).alias("coords"))
    boxed = tl.with_bbox(feats)
    assigned = tl.assign_tiles(boxed, [12])
    clusters = tl.cluster_tiles(boxed, [12])
    assert clusters.agg(F.sum("point_count")).first()[0] == assigned.count() >= 90000
    assert max(r["count"] for r in tl.detail_tiles(boxed, [14], cap=1000).groupBy("z", "x", "y").count().collect()) == 1000


def test_pairs_take_one_scan_and_one_shuffle(spark, tmp_path):
    rows = [("d", 2020, 1, None, "nation", f"k{i}", str(i), m, float(i * f)) for i in range(9) for m, f in (("a", 1), ("b", 2))]
    path = str(tmp_path / "s")
    spark.createDataFrame(rows, "dataset_id string, period_year int, period_quarter int, period_month int, spatial_unit string, "
                          "spatial_key string, spatial_code string, metric_name string, metric_value double").withColumn(
        "metric_unit", F.lit("x")).write.parquet(path)
    stats, sides = spark.read.parquet(path), (an.usable("a", "nation"), an.usable("b", "nation"))
    plan = plan_of(an.paired_metrics(stats, *sides, year=2020))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert path not in plan_of(an.paired_metrics(stats, *sides))  # the newest year comes from the written pairs
    assert an.paired_metrics(stats, *sides).count() == an.paired_metrics(stats, *sides, year=2020).count() == 9
    # a metric against itself
    assert {r["value_a"] == r["value_b"] for r in an.paired_metrics(stats, sides[0], sides[0]).collect()} == {True}
