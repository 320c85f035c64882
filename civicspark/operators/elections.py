"""Election results: unified shares, spectrum scores, rankings, column matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from civicspark.functions.numeric import settled_round
from civicspark.operators.analytics import versioned_boundaries
from civicspark.operators.state import newest_per_key
from civicspark.session import settled

SHARE_PREFIX = "Stimmenanteile "  # fixed value
TURNOUT_METRIC = "Wahlbeteiligung"  # fixed value
OTHERS, OTHERS_COLOR = "Sonstige", "#6b7683"  # fixed values
MATCH_TOLERANCE = 0.02  # fixed value


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Exact decimal percentage, rounded half up."""
    wide = "decimal(20,0)"
    return F.round((part * 100).cast(wide) / F.nullif(whole, F.lit(0)).cast(wide), digits).cast("double")


def party_aliases(parties: DataFrame) -> DataFrame:
    """(alias_norm, party_key) from names and aliases of the curated registry."""
    spelled = parties.select(
        F.col("key").alias("party_key"),
        F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("a"))
    return newest_per_key(spelled.select(F.lower(F.trim("a")).alias("alias_norm"), "party_key"), ["alias_norm"], [F.asc("party_key")])


def with_party(df: DataFrame, parties: DataFrame, raw: str = "raw_party") -> DataFrame:
    """Party key, name, position and colour of a raw name; unmapped names stay as they are.

    The registry is a short curated list, so the lookup is a broadcast of a few dozen rows."""
    lookup = party_aliases(parties).join(
        parties.select(F.col("key").alias("party_key"), F.col("name").alias("_pn"), F.col("position").alias("party_position"),
                       F.col("color").alias("party_color")), "party_key")
    joined = df.withColumn("alias_norm", F.lower(F.trim(F.col(raw)))).join(lookup, "alias_norm", "left")
    return joined.withColumn("party_name", F.coalesce("_pn", raw)).drop("_pn", "alias_norm")


def party_shares(results: DataFrame, stats: DataFrame, sources: DataFrame, parties: DataFrame) -> DataFrame:
    """Vote share and turnout per election type, year, level, area and party.

    Exact results win; published shares only fill (type, year, level) combinations without any. Each source is read
    once: its sums per area and party are written, and combinations, shares and turnout come from those few rows."""
    counted = lambda c: F.when(F.col("zweitstimmen").isNotNull(), F.col(c))
    sums = settled(
        results.where("spatial_code is not null")
        .groupBy("election_type", "year", "level", "spatial_code", F.col("party").alias("raw_party"))
        .agg(F.min(counted("gebiet_name")).alias("gebiet_name"), F.sum("zweitstimmen").alias("votes"),
             *[F.sum(counted(c)).alias(n) for c, n in (("gueltige_zweit", "_valid"), ("waehler", "_voters"), ("wahlberechtigte", "_eligible"))]),
        "result-sums")
    ratio = lambda a, b: F.col(a) * 100.0 / F.nullif(F.col(b), F.lit(0))
    keys = ["election_type", "year", "level", "spatial_code", "gebiet_name", "raw_party"]
    from_results = sums.where("votes is not null").select(
        *keys, ratio("votes", "_valid").alias("share_pct"), "votes", ratio("_voters", "_eligible").alias("turnout_pct"), F.lit("results").alias("source"))
    have = sums.select("election_type", F.col("year").alias("period_year"), F.col("level").alias("spatial_unit")).distinct()
    # the turnout is the row without a party
    party = F.when(F.col("metric_name").startswith(SHARE_PREFIX), F.substring("metric_name", len(SHARE_PREFIX) + 1, 10**6))
    published = settled(
        stats.where("spatial_code is not null and period_year is not null and metric_value is not null")
        .where(party.isNotNull() | (F.col("metric_name") == TURNOUT_METRIC)).join(sources, "dataset_id")
        .groupBy("election_type", "dataset_id", "period_year", "spatial_unit", "spatial_code", party.alias("raw_party"))
        .agg(F.min("spatial_key").alias("_key"), F.sum("metric_value").alias("_sum"), F.count(F.lit(1)).alias("_n")), "published-sums")
    turnout = published.where("raw_party is null").groupBy("dataset_id", "spatial_code", "period_year").agg(
        (F.sum("_sum") / F.sum("_n")).alias("turnout_pct"))
    shares = (
        published.where("raw_party is not null")
        .join(have, ["election_type", "period_year", "spatial_unit"], "left_anti")
        .join(turnout, ["dataset_id", "spatial_code", "period_year"], "left")
        .groupBy("election_type", F.col("period_year").alias("year"), F.col("spatial_unit").alias("level"), "spatial_code", "raw_party")
        .agg(F.min("_key").alias("gebiet_name"), (F.sum("_sum") / F.sum("_n")).alias("share_pct"), F.min("turnout_pct").alias("turnout_pct")))
    from_stats = shares.select(*keys, "share_pct", F.lit(None).cast("bigint").alias("votes"), "turnout_pct", F.lit("statistik").alias("source"))
    return with_party(from_results.unionByName(from_stats), parties)


def spectrum(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Share-weighted mean position of mapped parties, their coverage, and the party list by share with
    unmapped parties folded into one entry. The list is as long as a ballot."""
    known = F.col("party_position").isNotNull() & F.col("share_pct").isNotNull()
    covered = F.sum(F.when(known, F.col("share_pct")))
    weighted = F.sum(F.when(known, F.col("party_position") * F.col("share_pct")))
    others = F.sum(F.when(F.col("party_position").isNull(), F.col("share_pct")))
    entry = F.struct((-F.col("share_pct")).alias("rank"), F.col("party_name").alias("name"), F.col("party_key").alias("key"),
                     settled_round(F.col("share_pct"), 2).alias("share"), F.col("party_color").alias("color"))
    grouped = shares.groupBy(*keys).agg(
        covered.alias("_cov"), weighted.alias("_w"), others.alias("_oth"), F.max("turnout_pct").alias("turnout_pct"),
        F.array_sort(F.collect_list(F.when(known, entry))).alias("_list"))
    shown = F.transform("_list", lambda e: F.struct(e["key"].alias("key"), e["name"].alias("name"), e["share"].alias("share"), e["color"].alias("color")))
    rest = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(OTHERS).alias("name"),
                            settled_round(F.col("_oth"), 2).alias("share"), F.lit(OTHERS_COLOR).alias("color")))
    return grouped.select(
        *keys, settled_round(F.when(F.col("_cov") > 0, F.col("_w") / F.col("_cov")), 4).alias("score"),
        settled_round(F.coalesce("_cov", F.lit(0.0)), 2).alias("coverage_pct"), "turnout_pct",
        F.when(F.col("_oth") > 0, F.concat(shown, rest)).otherwise(shown).alias("parties"))


def spectrum_areas(shares: DataFrame, bounds: DataFrame) -> DataFrame:
    """Spectrum per area with the boundary version of the election year."""
    named = versioned_boundaries(shares, bounds, "level", "spatial_code", "year")
    return spectrum(named, ["election_type", "year", "level", "spatial_code", "boundary_name"])


def spectrum_options(shares: DataFrame, bounds: DataFrame) -> DataFrame:
    """(election_type, year) with the sorted levels that have boundaries. Combinations are reduced to
    a handful before the existence test."""
    combos = shares.select("election_type", "year", "level").distinct()
    b = bounds.select(F.col("boundary_type").alias("_bt"), F.col("boundary_year").alias("_by")).distinct()
    mapped = combos.join(b, (F.col("_bt") == F.col("level")) & ((F.col("_by") == 0) | (F.col("_by") == F.col("year"))), "left_semi")
    return mapped.groupBy("election_type", "year").agg(F.array_sort(F.collect_set("level")).alias("levels"))


def election_list(results: DataFrame) -> DataFrame:
    return results.groupBy("election_id", "election_type", "year").agg(
        F.array_sort(F.collect_set("level")).alias("levels"), F.count_distinct("party").alias("parties"))


def city_totals(results: DataFrame) -> DataFrame:
    """City rows from area rows: counts are summed, ratios recomputed from them."""
    return results.groupBy("election_id", "election_type", "year", "party").agg(
        *[F.sum(c).alias(c) for c in ("zweitstimmen", "gueltige_zweit", "wahlberechtigte", "waehler")])


def election_summary(city: DataFrame, parties: DataFrame, chart_minimum: float = 1.0) -> DataFrame:
    """Parties of each election by votes with share, turnout, colour and whether a chart shows them."""
    out = with_party(city, parties, "party").withColumn("anteil_pct", percent(F.col("zweitstimmen"), F.col("gueltige_zweit")))
    return out.withColumn("turnout_pct", percent(F.col("waehler"), F.col("wahlberechtigte"))).withColumn(
        "in_chart", F.col("anteil_pct") >= chart_minimum)


def election_rows(results: DataFrame, election_id: str, level: str, party: str | None = None) -> DataFrame:
    rows = results.where((F.col("election_id") == election_id) & (F.col("level") == level))
    if party is not None:
        rows = rows.where(F.col("party") == party)
    return rows.withColumn("anteil_pct", percent(F.col("zweitstimmen"), F.col("gueltige_zweit")))


def election_choropleth(results: DataFrame, bounds: DataFrame, party: str) -> DataFrame:
    rows = results.where((F.col("party") == party) & F.col("spatial_code").isNotNull())
    named = versioned_boundaries(rows, bounds, "level", "spatial_code", "year")
    return named.withColumn("anteil_pct", percent(F.col("zweitstimmen"), F.col("gueltige_zweit")))


def match_columns(columns: DataFrame, named: DataFrame, tolerance: float = MATCH_TOLERANCE) -> DataFrame:
    """Anonymous ballot columns (election_id, idx, share) to official names (election_id, name, ref).

    Greedy in column order: each column takes the nearest unused name within the tolerance, else a
    neutral label. A ballot has a few dozen columns, so both sides fit one array per election."""
    ballots = columns.groupBy("election_id").agg(F.array_sort(F.collect_list(F.struct("idx", "share"))).alias("cols"))
    official = named.groupBy("election_id").agg(F.array_sort(F.collect_list(F.struct("name", "ref"))).alias("names"))
    start = F.from_json(F.lit('{"used":[],"out":[]}'), "used array<string>, out array<struct<idx:int,label:string,delta:double>>")

    def take(state: Column, col: Column) -> Column:
        free = F.filter(F.coalesce("names", F.array().cast("array<struct<name:string,ref:double>>")),
                        lambda n: ~F.array_contains(state["used"], n["name"]))
        best = F.array_min(F.transform(free, lambda n: F.struct(F.abs(n["ref"] - col["share"]).alias("d"), n["name"].alias("name"))))
        hit = F.coalesce(best["d"] < tolerance, F.lit(False))
        label = F.when(hit, best["name"]).otherwise(F.concat(F.lit("Liste "), col["idx"].cast("string")))
        row = F.struct(col["idx"].cast("int").alias("idx"), label.alias("label"), best["d"].alias("delta"))
        return F.struct(
            F.when(hit, F.concat(state["used"], F.array(best["name"]))).otherwise(state["used"]).alias("used"),
            F.concat(state["out"], F.array(row)).alias("out"))

    matched = ballots.join(official, "election_id", "left").select("election_id", F.aggregate("cols", start, take)["out"].alias("out"))
    return matched.select("election_id", F.inline("out"))
