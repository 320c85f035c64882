"""Place names to canonical codes, and the alias tables behind it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from civicspark.functions import text as tx
from civicspark.operators.state import newest_per_key
from civicspark.session import settled

FUZZY_THRESHOLD = 0.45  # fixed value


HOT_ROWS = 4096  # names of one gram on one side that one task takes


def trigram_join(left: DataFrame, right: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Pairs (unit, left_name, right_name, sim) with trigram similarity above the threshold.

    Expects (unit, left_name) and (unit, right_name); a null name or unit is in no pair. The survivors of
    :func:`trigram_candidates` are compared in full."""
    pairs = trigram_candidates(left, right, threshold)
    return pairs.withColumn("sim", tx.similarity(F.col("left_name"), F.col("right_name"))).where(
        F.col("sim") > threshold
    )


def trigram_candidates(left: DataFrame, right: DataFrame, threshold: float = FUZZY_THRESHOLD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct pairs (unit, left_name, right_name) that may be above the threshold; no pair above it is missing.

    All grams stand in one global order, rare first. Names of ln and rn grams above the threshold have at least
    ``need = ceil(t / (1 + t) * (ln + rn))`` grams in common, so the first common one stands in the prefix of each
    (``n - ceil(t n) + 1``), and behind its places are enough grams left to reach ``need``: the length
    filter and the positional filter drop other meetings. The length band is part of the join key: sizes of a
    pair differ by less than 1 / t, so a name meets its own band and the next on each side. A gram with more
    than ``hot_rows`` names on a side is laid out as a grid of pieces."""
    l_sets, r_sets = _gram_sets(left, "left_name"), _gram_sets(right, "right_name")
    l_grams = l_sets.select("unit", "name", "n", F.explode("grams").alias("gram"))
    r_grams = r_sets.select("unit", "name", "n", F.explode("grams").alias("gram"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = l_grams.select("unit", "gram", one.alias("l"), none.alias("r")).unionByName(r_grams.select("unit", "gram", none.alias("l"), one.alias("r")))
    # how often a side has a gram also bounds how many of its names meet in it
    counts = both.groupBy("unit", "gram").agg(F.sum("r").alias("freq"), *[
        F.ceil(F.sum(side) / hot_rows).cast("int").alias(f"{side}_cuts") for side in "lr"])
    # grams the right side lacks cannot match, but they still count as positions of the left prefix
    l_prefix = _prefix(l_grams.join(counts, ["unit", "gram"]), threshold).where("l_cuts > 0 and r_cuts > 0")
    r_prefix = _prefix(r_grams.join(counts, ["unit", "gram"]), threshold).where("l_cuts > 0 and r_cuts > 0")
    # the size changes by at most one band within a pair; the rim keeps a rounded logarithm inside
    band = F.floor(F.log("n") / F.lit(math.log(1 / threshold) * (1 + 1e-9))).cast("int")
    l_rows = _piece(l_prefix, "l", "r").select(
        "unit", "gram", "l_piece", "r_piece", F.explode(F.array(band - 1, band, band + 1)).alias("band"),
        F.col("name").alias("left_name"), F.col("n").alias("ln"), F.col("_pos").alias("lp"))
    r_rows = _piece(r_prefix, "r", "l").select(
        "unit", "gram", "l_piece", "r_piece", band.alias("band"),
        F.col("name").alias("right_name"), F.col("n").alias("rn"), F.col("_pos").alias("rp"))
    need = F.ceil(F.lit(threshold / (1 + threshold) * (1 - 1e-12)) * (F.col("ln") + F.col("rn")))
    reachable = 1 + F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp"))
    sized = (F.col("rn") >= threshold * F.col("ln")) & (F.col("ln") >= threshold * F.col("rn"))
    met = l_rows.join(r_rows, ["unit", "gram", "band", "l_piece", "r_piece"])
    return met.where(sized & (reachable >= need)).select("unit", "left_name", "right_name").distinct()


def _piece(rows: DataFrame, own: str, other: str) -> DataFrame:
    """Rows with their own piece of the gram, once for every piece of the other side."""
    return rows.withColumn(f"{own}_piece", F.pmod(F.xxhash64("name"), F.col(f"{own}_cuts")).cast("int")).withColumn(
        f"{other}_piece", F.explode(F.sequence(F.lit(0), F.col(f"{other}_cuts") - 1)))


def _gram_sets(df: DataFrame, name: str) -> DataFrame:
    named = df.select("unit", F.col(name).alias("name")).distinct()
    return named.withColumn("grams", tx.trigrams(F.col("name"))).withColumn("n", F.size("grams"))


def _prefix(grams: DataFrame, threshold: float) -> DataFrame:
    """The first grams of each name with their place (from 1) in the global order."""
    w = Window.partitionBy("unit", "name").orderBy("freq", "gram")
    keep = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1
    return grams.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= keep)


def level_names(boundaries: DataFrame) -> DataFrame:
    """One row per normalised boundary name with the (few) levels that use it."""
    return (
        boundaries.where("name is not null")
        .groupBy(tx.norm_name(F.col("name")).alias("norm"))
        .agg(F.array_sort(F.collect_set("boundary_type")).alias("levels"))
    )


def foreign_level(df: DataFrame, boundaries: DataFrame, unit: str, name: str) -> DataFrame:
    """Flag rows whose raw name is exactly the name of a boundary on another level."""
    joined = df.withColumn("norm", tx.norm_name(F.col(name))).join(level_names(boundaries), "norm", "left")
    other = F.size(F.array_except(F.coalesce("levels", F.array().cast("array<string>")), F.array(F.col(unit)))) > 0
    return joined.withColumn("is_foreign", other).drop("norm", "levels")


def shared_names(boundaries: DataFrame) -> DataFrame:
    """Names used on more than one level; the guard is only safe while this is empty."""
    return level_names(boundaries).where(F.size("levels") > 1)


def derive_aliases(boundaries: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(unit_type, alias, code, source): normalised names and codes without leading zeros. The newest
    boundary year wins; a manual alias is never replaced."""
    alias_arr = F.array(
        tx.norm_name(F.col("name")),
        F.when(F.col("code").rlike("^[0-9]+$"),
               F.coalesce(F.nullif(F.ltrim(F.col("code"), F.lit("0")), F.lit("")), F.lit("0"))),
    )
    derived = (
        boundaries.select(
            F.col("boundary_type").alias("unit_type"),
            F.explode(F.when(F.col("name").isNull(), F.slice(alias_arr, 2, 1)).otherwise(alias_arr)).alias("alias"),
            "code", "boundary_year", F.lit("boundary").alias("source"),
        ).where("alias is not null and alias <> ''")
    )
    if manual is not None:
        derived = derived.unionByName(
            manual.select("unit_type", "alias", "code", F.lit(None).cast("int").alias("boundary_year"),
                          F.lit("manual").alias("source"))
        )
    best = newest_per_key(
        derived, ["unit_type", "alias"],
        [F.desc(F.col("source") == "manual"), F.desc_nulls_last("boundary_year"), F.asc("code")],
    )
    return best.select("unit_type", "alias", "code", "source")


def resolve_keys(keys: DataFrame, boundaries: DataFrame, aliases: DataFrame,
                 threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """(unit, raw) to (unit, raw, code, prio, sim): alias, code, leading code, then fuzzy name.

    Works on distinct keys only; the fuzzy branch sees just the keys no exact branch resolved and
    that are not the name of another level. Boundaries and graded keys are each derived once and settled, as the
    branches read them several times."""
    boundaries = settled(boundaries.select("boundary_type", "code", "name").distinct(), "boundary-names")
    wanted = keys.select("unit", "raw").distinct()
    codes = boundaries.select(F.col("boundary_type").alias("unit"), "code").distinct()
    trimmed = F.trim(F.col("raw"))
    lead = F.nullif(F.regexp_extract(trimmed, r"^(\d{1,4})\b", 1), F.lit(""))
    probes = wanted.select(
        "unit", "raw", tx.norm_name(F.col("raw")).alias("norm"), trimmed.alias("plain"), lead.alias("lead")
    )
    exact = (
        probes.join(
            aliases.select(F.col("unit_type").alias("unit"), F.col("alias").alias("norm"),
                           F.col("code").alias("c1")), ["unit", "norm"], "left")
        .join(codes.withColumnRenamed("code", "plain").withColumn("c2", F.col("plain")), ["unit", "plain"], "left")
        .join(codes.withColumnRenamed("code", "lead").withColumn("c3", F.col("lead")), ["unit", "lead"], "left")
    )
    graded = exact.select(
        "unit", "raw", F.coalesce("c1", "c2", "c3").alias("code"),
        F.when(F.col("c1").isNotNull(), 1).when(F.col("c2").isNotNull(), 2)
        .when(F.col("c3").isNotNull(), 3).alias("prio"),
    )
    graded = settled(graded, "graded-keys")
    open_keys = foreign_level(graded.where("code is null"), boundaries, "unit", "raw").where(~F.col("is_foreign"))
    named = boundaries.where("name is not null").select(
        F.col("boundary_type").alias("unit"), "code", tx.norm_name(F.col("name")).alias("right_name")
    ).distinct()
    pairs = trigram_join(
        open_keys.select("unit", tx.norm_name(F.col("raw")).alias("left_name")),
        named.select("unit", "right_name"), threshold,
    )
    best = newest_per_key(
        pairs.join(named, ["unit", "right_name"]), ["unit", "left_name"], [F.desc("sim"), F.asc("code")]
    ).select("unit", "left_name", F.col("code").alias("c4"), "sim")
    fuzzy = open_keys.withColumn("left_name", tx.norm_name(F.col("raw"))).join(best, ["unit", "left_name"])
    return (
        graded.join(fuzzy.select("unit", "raw", "c4", "sim"), ["unit", "raw"], "left")
        .select(
            "unit", "raw", F.coalesce("code", "c4").alias("code"),
            F.coalesce("prio", F.when(F.col("c4").isNotNull(), 4)).alias("prio"),
            F.when(F.col("prio").isNotNull(), 1.0).otherwise(F.col("sim")).alias("sim"),
        )
    )


def backfill_codes(stats: DataFrame, boundaries: DataFrame, aliases: DataFrame, units) -> DataFrame:
    """Fill missing codes of resolvable levels, resolving each distinct key once."""
    open_keys = stats.where(F.col("spatial_code").isNull() & F.col("spatial_unit").isin(*units)).select(
        F.col("spatial_unit").alias("unit"), F.col("spatial_key").alias("raw")
    )
    found = resolve_keys(open_keys, boundaries, aliases).where("code is not null").select(
        F.col("unit").alias("spatial_unit"), F.col("raw").alias("spatial_key"), F.col("code").alias("_code")
    )
    return stats.join(found, ["spatial_unit", "spatial_key"], "left").withColumn(
        "spatial_code", F.coalesce("spatial_code", "_code")
    ).drop("_code")


def repair_foreign(stats: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Clear codes that were assigned from a name of another level."""
    flagged = foreign_level(stats, boundaries, "spatial_unit", "spatial_key")
    return flagged.withColumn(
        "spatial_code", F.when(F.col("is_foreign"), None).otherwise(F.col("spatial_code"))
    ).drop("is_foreign")


def boundary_rows(features: DataFrame, code_names, name_names, level: str, year: int = 0) -> DataFrame:
    """Boundary rows from features with a property map; the parent is the first digit of the code."""
    code = tx.first_present(F.col("props"), code_names)
    return features.select(
        F.lit(level).alias("boundary_type"), code.alias("code"),
        tx.first_present(F.col("props"), name_names).alias("name"),
        F.substring(code, 1, 1).alias("parent_code"), F.lit(year).alias("boundary_year"),
    )


def boundary_quality(rows: DataFrame, minimum: float = 0.9) -> DataFrame:
    """Per level: features, coded features, share, and whether the load may proceed."""
    counted = rows.groupBy("boundary_type").agg(
        F.count(F.lit(1)).alias("features"), F.count("code").alias("coded")
    )
    share = F.col("coded") / F.col("features")
    return counted.withColumn("share", share).withColumn("passes", share >= minimum)


def require_boundary_quality(rows: DataFrame, minimum: float = 0.9) -> None:
    """Raise when a level falls below the gate or nothing was read (one small aggregate)."""
    checked = boundary_quality(rows, minimum).agg(
        F.count(F.lit(1)).alias("levels"), F.count_if(~F.col("passes")).alias("bad")
    ).first()
    if not checked["levels"] or checked["bad"]:
        raise ValueError("boundary load refused: too few features carry a code")
