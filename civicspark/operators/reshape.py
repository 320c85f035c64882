"""Wide-to-long reshaping and record normalisation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from civicspark.functions import text as tx

# fixed values: column names of the statistics layouts
META_COLUMNS = ("Kennziffer", "Merkmal_1", "Merkmal_2", "Merkmal_3", "Merkmal_4", "Einheit",
                "Gebiet", "Sachmerkmal")
PERIOD_COLUMNS = ("Jahr", "year", "Periode", "periode", "period", "Datum", "datum", "date")
SPATIAL_COLUMNS = ("Ortsteil", "ortsteil", "Stadtbezirk", "stadtbezirk", "Wahlbezirk", "wahlbezirk",
                   "Briefwahlbezirk", "briefwahlbezirk", "Gebiet")
# fixed values: first three letters of the German month names
MONTHS = ("jan", "feb", "mär", "apr", "mai", "jun", "jul", "aug", "sep", "okt", "nov", "dez")
NAME_SEPARATOR = " · "
DEFAULT_KEY = "Leipzig"


def period_columns(columns) -> list[str]:
    """Columns whose header carries a year; looks at the schema only."""
    return [c for c in columns if c not in META_COLUMNS and re.search(r"(19|20)\d{2}", c)]


def _joined_name(parts: list[Column], fallback: Column) -> Column:
    """Non-empty parts of a name hierarchy joined, else the fallback."""
    cleaned = [tx.blank_to_null(p) for p in parts]
    return F.coalesce(F.nullif(F.concat_ws(NAME_SEPARATOR, *cleaned), F.lit("")), tx.blank_to_null(fallback))


def _unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, [F.col(f"`{v}`").cast("string").alias(v) for v in values], name, value)


def _last_row_wins(long: DataFrame, keys: list[str], row: str, *extra: str) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.max_by("value", row).alias("value"), *[F.max_by(c, row).alias(c) for c in extra]
    )


def melt_values(df: DataFrame, row_index: str) -> DataFrame:
    """City-wide layout (one row per indicator, one column per period) to
    (period, metric_name, value, unit); the last source row wins per cell."""
    periods = period_columns(df.columns)
    named = df.select(
        F.col(row_index).alias("_row"),
        _joined_name([F.col("Merkmal_2"), F.col("Merkmal_3"), F.col("Merkmal_4")], F.col("Kennziffer"))
        .alias("metric_name"),
        tx.blank_to_null(F.col("Einheit")).alias("unit"),
        *[F.col(f"`{p}`") for p in periods],
    ).where("metric_name is not null")
    long = _unpivot(named, ["_row", "metric_name", "unit"], periods, "period", "value")
    cells = long.groupBy("period", "metric_name").agg(
        F.max_by("value", F.when(_present("value"), F.col("_row"))).alias("value")
    ).where("value is not null")
    units = named.groupBy("metric_name").agg(
        F.max_by("unit", F.when(F.col("unit").isNotNull(), F.col("_row"))).alias("unit")
    )
    return cells.join(units, "metric_name", "left").select("period", "metric_name", "value", "unit")


def _present(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name) != "")


def melt_areas(df: DataFrame, row_index: str) -> DataFrame:
    """Small-area layout (one row per area and indicator) to (period, area, metric_name, value)."""
    periods = period_columns(df.columns)
    named = df.select(
        F.col(row_index).alias("_row"),
        tx.blank_to_null(F.col("Gebiet")).alias("area"),
        tx.blank_to_null(F.col("Sachmerkmal")).alias("metric_name"),
        *[F.col(f"`{p}`") for p in periods],
    ).where("area is not null and metric_name is not null")
    long = _unpivot(named, ["_row", "area", "metric_name"], periods, "period", "value")
    return _last_row_wins(long.where(_present("value")), ["period", "area", "metric_name"], "_row")


def melt_json_long(df: DataFrame, row_index: str) -> DataFrame:
    """Already long variant (name, merkmal_2..4, jahr, wert, einheit); 'x' marks suppressed cells."""
    named = df.select(
        F.col(row_index).alias("_row"),
        _joined_name([F.col("merkmal_2"), F.col("merkmal_3"), F.col("merkmal_4")], F.col("name"))
        .alias("metric_name"),
        tx.blank_to_null(F.col("jahr")).alias("period"),
        tx.blank_to_null(F.col("einheit")).alias("unit"),
        F.col("wert").cast("string").alias("value"),
    ).where("metric_name is not null and period is not null")
    usable = _present("value") & (F.col("value") != "x")
    units = named.groupBy("metric_name").agg(
        F.max_by("unit", F.when(F.col("unit").isNotNull(), F.col("_row"))).alias("unit")
    )
    cells = _last_row_wins(named.where(usable), ["period", "metric_name"], "_row")
    return cells.join(units, "metric_name", "left").select("period", "metric_name", "value", "unit")


def parse_period(label: Column, default_year: Column | None = None) -> tuple[Column, Column, Column, Column]:
    """(period_label, year, quarter, month) of a raw period text; the contract year fills gaps."""
    default_year = F.lit(None).cast("int") if default_year is None else default_year
    year = F.nullif(F.regexp_extract(label, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")
    quarter = F.nullif(F.regexp_extract(label, r"^\s*([1-4])\.\s*Qu", 1), F.lit("")).cast("int")
    word = F.lower(F.regexp_extract(label, r"^\s*(\p{L}{3})", 1))
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), word), F.lit(0)).cast("int")
    found = year.isNotNull()
    return (
        F.when(found, label).otherwise(F.coalesce(default_year.cast("string"), F.lit(""))),
        F.coalesce(year, default_year),
        F.when(found, quarter),
        F.when(found, month),
    )


def unit_of_column(name: str, fallback: str) -> str:
    """Area level named by a column header."""
    lowered = name.lower()
    for part in ("wahlbezirk", "ortsteil", "stadtbezirk"):  # a postal district is a voting district
        if part in lowered:
            return part
    return fallback


def detect_area(columns, unit: str = "city", key_column: str | None = None) -> tuple[Column, Column]:
    """(spatial_unit, spatial_key): a pinned column, or the first filled area column of each row."""
    if key_column:
        return F.lit(unit), F.coalesce(F.nullif(F.col(f"`{key_column}`"), F.lit("")), F.lit(DEFAULT_KEY))
    present = [c for c in SPATIAL_COLUMNS if c in columns]
    filled = [F.nullif(F.col(f"`{c}`"), F.lit("")) for c in present]
    unit_col = F.coalesce(
        *[F.when(f.isNotNull(), F.lit(unit_of_column(c, unit))) for c, f in zip(present, filled)], F.lit(unit)
    )
    return unit_col, F.coalesce(*filled, F.lit(DEFAULT_KEY))


def generic_to_long(df: DataFrame, dataset_id: Column, unit: str = "city", key_column: str | None = None,
                    default_year: int | None = None, skip=(), carry=()) -> DataFrame:
    """Any wide record to long statistics: columns that are neither period, area nor skipped become
    metrics, and cells that are not numbers vanish. Reads the schema once, the data once."""
    periods = [c for c in PERIOD_COLUMNS if c in df.columns]
    label = F.col(f"`{periods[0]}`").cast("string") if periods else F.lit("")
    default = F.lit(default_year).cast("int")
    period_label, year, quarter, month = parse_period(F.coalesce(label, F.lit("")), default)
    spatial_unit, spatial_key = detect_area(df.columns, unit, key_column)
    excluded = {*PERIOD_COLUMNS, *SPATIAL_COLUMNS, *skip, *carry, key_column}
    metrics = [c for c in df.columns if c not in excluded]
    ids = ["dataset_id", "period_type", "period_label", "period_year", "period_quarter", "period_month",
           "spatial_unit", "spatial_key", *carry]
    wide = df.select(
        dataset_id.alias("dataset_id"), F.lit("year").alias("period_type"),
        period_label.alias("period_label"), year.alias("period_year"), quarter.alias("period_quarter"),
        month.alias("period_month"), spatial_unit.alias("spatial_unit"), spatial_key.alias("spatial_key"),
        *carry, *[F.col(f"`{m}`") for m in metrics],
    )
    long = _unpivot(wide, ids, metrics, "metric_name", "_raw")
    # the guard filters, so the pattern runs once per cell and only numbers are converted
    numbers = long.where(tx.is_number(F.col("_raw")))
    return numbers.withColumn("metric_value", tx.to_number(F.col("_raw"))).drop("_raw")


def stamp_contracts(contracts: DataFrame, members: DataFrame, hints: DataFrame) -> DataFrame:
    """Contracts with family id, family year and loader hints; hint year beats family year."""
    return (
        contracts.join(members.select("dataset_id", "family_id", "family_year"), "dataset_id", "left")
        .join(hints.select("dataset_id", "hint_unit", "hint_key_column", "hint_year"), "dataset_id", "left")
        .withColumn("effective_year", F.coalesce("hint_year", "family_year"))
    )


def _has(col: Column, *needles: str) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(n) for n in needles])


def route_target(df: DataFrame, is_election: Column) -> DataFrame:
    """Target table, feature type or skip reason (detail), and sweep: whether a file is a whole snapshot of
    its dataset, so that rows it no longer holds go. Ordered first match.

    Expects columns name, url, format. One expression, so routing a catalog is one narrow pass. The label
    of other geodata is the first 64 characters of its name, a fixed value; nothing is decided by it.
    """
    name = F.lower(F.coalesce("name", F.lit("")))
    url = F.coalesce("url", F.lit(""))
    fmt = F.upper(F.coalesce("format", F.lit("")))
    geo = fmt.isin("GEOJSON", "WFS")
    short = F.substring(F.coalesce("name", F.lit("")), 1, 64)
    bicycle = _has(name, "dauerzaehlstell", "radverkehr")
    counts = _has(name, "anzahl", "gesamt") | F.lower(url).contains("zeitreihe")
    works = _has(name, "verkehrsraum", "baustell") & geo
    # fixed values: rule order and target names
    rules = [
        (url == "", "skip", F.lit("no resource URL")),
        (fmt.isin("PDF", "XLS"), "skip", F.concat(F.lit("unsupported format "), fmt)),
        (is_election, "election_results", None),
        (url.contains("pr_anlage_belegung_lastrecord") & geo, "geo_features", F.lit("park_ride")),
        (url.contains("pr_anlage_belegung_zeitreihe") & geo, "geo_features", F.lit("park_ride_history")),
        (bicycle & geo, "geo_features",
         F.when(counts, "bicycle_count").otherwise("bicycle_station")),
        (bicycle, "bicycle_counts", None),
        (works, "traffic_restrictions",
         F.when(name.contains("polygon"), "polygon").otherwise("point"), True),
        (fmt == "GTFS", "geo_features", F.lit("gtfs_stop")),
        (fmt.isin("SHP", "GPKG"), "geo_features", short),
        (fmt == "ZIP", "by_content", None),
        (fmt.isin("XLSX", "ODS", "XML"), "statistics", None),
        (geo, "geo_features", short, True),
        (fmt.isin("CSV", "JSON") & url.contains("statistik.leipzig.de/opendata/api"), "statistics", None),
        (fmt == "CSV", "statistics", None),
    ]
    target = detail = sweep = None
    for cond, where, what, *whole in rules:
        what = F.lit(None).cast("string") if what is None else what
        target = F.when(cond, where) if target is None else target.when(cond, where)
        detail = F.when(cond, what) if detail is None else detail.when(cond, what)
        sweep = F.when(cond, bool(whole)) if sweep is None else sweep.when(cond, bool(whole))
    return df.withColumns({"target": target.otherwise("summary"), "detail": detail, "sweep": sweep.otherwise(False)})


def change_status(manifest: DataFrame, stored: DataFrame, loaded: DataFrame, forced: Column) -> DataFrame:
    """new / changed / unchanged / reload per landed file.

    ``stored`` holds the validators of the last load, ``loaded`` the datasets with rows in the
    target; a forced dataset without rows is reloaded even if its validator did not change.
    """
    has_rows = loaded.select("dataset_id").distinct().withColumn("_has", F.lit(True))
    joined = manifest.join(stored.withColumnRenamed("etag", "_etag"), "dataset_id", "left").join(
        has_rows, "dataset_id", "left"
    )
    same = F.col("etag").isNotNull() & (F.col("etag") == F.col("_etag"))
    status = (
        F.when(F.col("_etag").isNull(), "new")
        .when(same & forced & F.col("_has").isNull(), "reload")
        .when(same, "unchanged")
        .otherwise("changed")
    )
    return joined.withColumn("status", status).drop("_etag", "_has")


def election_unpivot(df: DataFrame, parties: list[str], vote_mode: str, level: str, carry=()) -> DataFrame:
    """Wide election file (A, B, B1, C..F, then one numbered column per party) to one row per
    area and party. The party list is a short curated definition, in column order."""
    # fixed values: vote-mode letters of the standard layout
    party_letter = {"erst_zweit": "F", "kommunal": "E"}.get(vote_mode, "D")
    number = {"nr": F.trim(F.coalesce(F.col("`gebiet-nr`"), F.lit(""))),
              "name": F.trim(F.coalesce(F.col("`gebiet-name`"), F.lit("")))}

    def cell(col_name: str) -> Column:
        return tx.parse_int(F.col(f"`{col_name}`")) if col_name in df.columns else F.lit(None).cast("bigint")

    if level == "stadt":
        code = F.lit("leipzig")
        shown = F.when(number["name"] == "", "Stadt Leipzig").otherwise(number["name"])
    elif level == "wahlbezirk":
        padded = F.when(F.length(number["nr"]) < 4, F.lpad(number["nr"], 4, "0")).otherwise(number["nr"])
        code, shown = F.when(number["nr"] != "", padded), number["name"]
    else:
        code = F.coalesce(F.nullif(number["nr"], F.lit("")), F.nullif(number["name"], F.lit("")))
        shown = number["name"]
    two_votes = vote_mode == "erst_zweit"
    valid = {"erst_zweit": "F", "single": "D"}.get(vote_mode, "E")
    votes = F.array(
        *[
            F.struct(
                F.lit(p).alias("party"), F.lit(i).alias("party_index"),
                (cell(f"D{i}") if two_votes else F.lit(None).cast("bigint")).alias("erststimmen"),
                cell(f"{party_letter}{i}").alias("zweitstimmen"),
            )
            for i, p in enumerate(parties, start=1)
        ]
    )
    return (
        df.select(
            F.lit(level).alias("level"), code.alias("gebiet_code"),
            F.nullif(shown, F.lit("")).alias("gebiet_name"),
            cell("A").alias("wahlberechtigte"), cell("B").alias("waehler"), cell("B1").alias("briefwaehler"),
            (cell("C") if two_votes else F.lit(None).cast("bigint")).alias("ungueltige_erst"),
            (cell("D") if two_votes else F.lit(None).cast("bigint")).alias("gueltige_erst"),
            (cell("E") if two_votes else cell("C")).alias("ungueltige_zweit"),
            cell(valid).alias("gueltige_zweit"),
            F.inline(votes), *carry,
        )
        .where("gebiet_code is not null")
    )
