"""Catalog derivation: families, categories, indicators, capabilities, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from civicspark.functions import geo, text as tx
from civicspark.operators.state import any_of, top_per_key

FALLBACK_THEME = "sonstiges"  # fixed value
# fixed values: numeric statistics category to theme ids
KATEGORIE_THEMES = {
    1: ["regionen-und-staedte"],
    2: ["bevoelkerung-und-gesellschaft"],
    3: ["bevoelkerung-und-gesellschaft"],
    4: ["bevoelkerung-und-gesellschaft"],
    5: ["bildung-kultur-und-sport"],
    6: ["regionen-und-staedte"],
    7: ["wirtschaft-und-finanzen"],
    8: ["wirtschaft-und-finanzen"],
    9: ["bevoelkerung-und-gesellschaft"],
    10: ["verkehr"],
    11: ["bildung-kultur-und-sport"],
    12: ["justiz-rechtssystem-und-oeffentliche-sicherheit"],
    13: ["umwelt"],
    14: ["regierung-und-oeffentlicher-sektor"],
    15: ["bevoelkerung-und-gesellschaft", "regierung-und-oeffentlicher-sektor"],
}
# fixed values: live feature types of the mobility preset
LIVE_FEATURE_TYPES = ("park_ride", "park_ride_history", "bicycle_count", "bicycle_station", "gtfs_stop")


def sorted_set(col) -> Column:
    return F.array_sort(F.collect_set(col))


def detect_families(datasets: DataFrame) -> DataFrame:
    """Members (family_id, family_title, dataset_id, title, year) of titles that differ only by year:
    at least two datasets, at least one dated. Members stay rows, whatever the family size."""
    titled = datasets.select("dataset_id", "title", tx.title_base(F.col("title")).alias("base"),
                             tx.title_year(F.col("title")).alias("year"))
    dated_title = F.when(F.col("year").isNotNull(), F.col("title"))
    kept = (
        titled.groupBy("base")
        .agg(F.count(F.lit(1)).alias("_n"), F.count("year").alias("_dated"),
             F.min_by(dated_title, F.when(dated_title.isNotNull(), F.struct(F.length("title"), "title"))).alias("_short"))
        .where("_n >= 2 and _dated >= 1")
        .select("base", tx.title_display(F.col("_short")).alias("family_title"), tx.slugify(F.col("base")).alias("family_id"))
    )
    return titled.join(kept, "base").select(
        "family_id", "family_title", "dataset_id", "title", "year", F.col("year").isNull().alias("needs_review"))


def assign_categories(datasets: DataFrame, group_members: DataFrame, family_members: DataFrame) -> DataFrame:
    """(dataset_id, category_id, source): own groups, else those of family siblings, else the numeric
    statistics category in the URL, else the catch-all. Each step only sees what is still open."""
    known = datasets.select("dataset_id")
    own = group_members.join(known, "dataset_id", "left_semi").select("dataset_id", "category_id").distinct()
    open1 = datasets.join(own, "dataset_id", "left_anti")
    family_cats = family_members.join(group_members, "dataset_id").select("family_id", "category_id").distinct()
    inherited = open1.select("dataset_id").join(family_members, "dataset_id").join(family_cats, "family_id").select(
        "dataset_id", "category_id").distinct()
    open2 = open1.join(inherited, "dataset_id", "left_anti")
    themes = F.create_map(*[x for k, v in KATEGORIE_THEMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    number = F.nullif(F.regexp_extract("url", r"kategorie_nr=(\d+)", 1), F.lit("")).cast("int")
    found = F.when(F.col("url").contains("statistik.leipzig.de"), F.try_element_at(themes, number))
    rest = open2.withColumn("_cats", found)
    mapped = rest.where("_cats is not null").select("dataset_id", F.explode("_cats").alias("category_id"))
    fallback = rest.where("_cats is null").select("dataset_id", F.lit(FALLBACK_THEME).alias("category_id"))
    tagged = lambda df, s: df.withColumn("source", F.lit(s))
    return tagged(own, "group").union(tagged(inherited, "family")).union(tagged(mapped, "kategorie_nr")).union(
        tagged(fallback, "fallback"))


def fold_indicators(metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indicators, mapping) from metric rows (dataset_id, title, topic, raw_name, unit, pos).

    A canonical name used under several title stems gets the stem as prefix. Topic by majority (first
    seen wins a tie), unit by first occurrence."""
    canonical, hint = tx.indicator_parts(F.col("raw_name"))
    rows = metrics.select(
        "dataset_id", "raw_name", "topic", "pos", tx.title_stem(F.col("title")).alias("stem"),
        canonical.alias("canonical"), F.coalesce("unit", hint).alias("unit")).where("canonical <> ''")
    spread = rows.groupBy("canonical").agg((F.min("stem") < F.max("stem")).alias("_ambiguous"))
    shown = F.when(F.col("_ambiguous"), F.concat("stem", F.lit(": "), "canonical")).otherwise(F.col("canonical"))
    named = rows.join(spread, "canonical").select(
        "dataset_id", "raw_name", "topic", "pos", "unit", shown.alias("name")).withColumn(
        "indicator_id", tx.slugify(F.col("name"), 80))
    per_topic = named.groupBy("indicator_id", "topic").agg(
        F.count(F.lit(1)).alias("_n"), F.min("pos").alias("_first"), F.min_by("name", "pos").alias("_name"),
        F.min_by("unit", F.when(F.col("unit").isNotNull(), F.col("pos"))).alias("_unit"),
        F.min(F.when(F.col("unit").isNotNull(), F.col("pos"))).alias("_upos"))
    indicators = per_topic.groupBy("indicator_id").agg(
        F.min_by("_name", "_first").alias("name"), F.min_by("_unit", "_upos").alias("unit"),
        F.max_by("topic", F.struct(F.col("_n"), -F.col("_first"))).alias("topic"), F.sum("_n").alias("metrics"))
    return indicators, named.select("indicator_id", "dataset_id", F.col("raw_name").alias("metric_name"))


def best_theme(registry: DataFrame, categories: DataFrame) -> DataFrame:
    """Per dataset the category with the lowest position, the catch-all last."""
    rank = F.struct((F.col("category_id") == FALLBACK_THEME).alias("last"), "position", "category_id")
    return (
        registry.select("dataset_id", F.explode("categories").alias("category_id"))
        .join(categories.select("category_id", "position"), "category_id")
        .groupBy("dataset_id").agg(F.min_by("category_id", rank).alias("theme_id")))


def capabilities(registry: DataFrame, features: DataFrame, stats: DataFrame, restrictions: DataFrame,
                 categories: DataFrame) -> DataFrame:
    """Per active dataset: row counts and distinct kinds, types, metrics and years in every store.

    Each store is pre-aggregated to one row per dataset. Statistics are first reduced to (dataset, mark), a
    mark being a metric or a year of the city, so distinct counts are plain counts of those rows and no
    row is copied once per distinct count. Marks are dealt out to all shuffle partitions of the session before they
    are grouped, so that a task only holds its part of them, however the rows lie in their files."""
    geo_part = features.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("geo_n"), sorted_set(geo.geom_kind(F.col("geom_type"))).alias("geomkinds"),
        sorted_set("feature_type").alias("ftypes"), sorted_set("year").alias("gyears"))
    city = F.col("spatial_unit") == "city"
    ort = F.col("spatial_unit").isin("ortsteil", "stadtbezirk", "wahlbezirk") & F.col("spatial_code").isNotNull()
    one = lambda mark, o, c: F.struct(mark.alias("mark"), o.cast("int").alias("ort"), c.cast("int").alias("city"))
    metric = F.coalesce(F.concat(F.lit("m"), "metric_name"), F.lit("n"))  # n: counts as a row, not as a metric
    year = F.when(city & F.col("period_year").isNotNull(), one(F.concat(F.lit("y"), "period_year"), F.lit(0), F.lit(0)))
    tasks = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = stats.where(city | ort).select("dataset_id", F.inline(F.array_compact(F.array(one(metric, ~city, city), year)))).repartition(
        tasks, "dataset_id", "mark").groupBy("dataset_id", "mark").agg(F.sum("ort").alias("ort"), F.sum("city").alias("city"))
    named = F.col("mark").startswith("m")
    stat_part = small.groupBy("dataset_id").agg(
        F.sum("ort").alias("ort_n"), F.count_if(named & (F.col("ort") > 0)).alias("ort_metrics"),
        F.sum("city").alias("city_n"), F.count_if(named & (F.col("city") > 0)).alias("city_metrics"),
        F.count_if(F.col("mark").startswith("y")).alias("city_years"))
    works = restrictions.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("traffic_n"))
    out = registry.where("is_active").join(geo_part, "dataset_id", "left").join(stat_part, "dataset_id", "left").join(
        works, "dataset_id", "left").join(best_theme(registry, categories), "dataset_id", "left")
    counts = ["geo_n", "ort_n", "ort_metrics", "city_n", "city_metrics", "city_years", "traffic_n"]
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def catalog(caps: DataFrame, families: DataFrame) -> DataFrame:
    """One entry per family or single dataset that holds data, with kind, badges and geometry.

    Set-valued columns come from few distinct values, so collecting distinct sets stays small; the
    member list is the separate ``catalog_members``, as it has no bound."""
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    grouped = (
        caps.where("geo_n + ort_n + city_n + traffic_n > 0")
        .join(families.select("family_id", F.col("title").alias("_ft")), "family_id", "left")
        .groupBy(F.coalesce("family_id", "dataset_id").alias("group_id"))
        .agg(
            F.bool_or(F.col("family_id").isNotNull()).alias("is_family"),
            F.coalesce(F.max("_ft"), F.min("title")).alias("title"), F.min("slug").alias("slug"),
            F.coalesce(F.min("theme_id"), F.lit(FALLBACK_THEME)).alias("theme"), F.count(F.lit(1)).alias("datasets"),
            *[F.sum(c).alias(c) for c in ("geo_n", "ort_n", "city_n", "traffic_n", "ort_metrics", "city_metrics")],
            F.max("city_years").alias("city_years"), F.bool_or(F.col("schedule") == "live").alias("live"),
            merged("geomkinds").alias("geomkinds"), merged("ftypes").alias("feature_types"), merged("gyears").alias("years")))
    return grouped.withColumn("kind", entry_kind()).withColumn("badges", entry_badges()).withColumn(
        "geometry", entry_geometry()).withColumn("feature_count", F.nullif(F.col("geo_n") + F.col("traffic_n"), F.lit(0)))


def catalog_members(caps: DataFrame) -> DataFrame:
    return caps.where("geo_n + ort_n + city_n + traffic_n > 0").select(
        F.coalesce("family_id", "dataset_id").alias("group_id"), "dataset_id")


def _mapped() -> Column:
    return (F.col("geo_n") > 0) | (F.col("traffic_n") > 0)


def entry_kind() -> Column:
    """Primary representation by the stores that hold data."""
    return (
        F.when(_mapped(), "geo").when(F.col("ort_n") > 0, "choropleth")
        .when((F.col("city_n") > 0) & (F.col("city_years") > 1), "timeseries").otherwise("distribution"))


def entry_badges() -> Column:
    return F.array_compact(F.array(
        F.when(F.col("live"), "Live"), F.when(_mapped(), "Geo"), F.when(F.col("ort_n") > 0, "Ortsteil"),
        F.when(F.col("city_n") > 0, "Stadt"),
        F.when((F.col("city_years") > 1) | (F.size("years") > 1), "Zeitreihe")))


def entry_geometry() -> Column:
    """Dominant geometry for styling: the most areal one; restrictions count as areas."""
    has = lambda k: F.array_contains("geomkinds", k)
    return F.when((F.col("traffic_n") > 0) | has("area"), "area").when(has("line"), "line").when(has("point"), "point")


def preset_rules() -> dict[str, Column]:
    """Selection rule of each preset over catalog entries."""
    title_has = lambda *words: any_of([F.lower("title").contains(w) for w in words])
    # fixed values: title words and theme ids of the presets
    return {
        "mobilitaet": F.arrays_overlap("feature_types", F.array(*map(F.lit, LIVE_FEATURE_TYPES)))
        | title_has("straßennetz", "radverkehr", "park+ride", "park + ride"),
        "stadtklima": title_has("baumkataster", "luftqualität", "luftreinhalte", "no2", "bodenrichtwerte"),
        "wahlen": title_has("wahlbezirke", "wahlkreise") & (F.col("kind") == "geo"),
        "bevoelkerung": (F.col("theme") == "bevoelkerung-und-gesellschaft") & F.col("kind").isin("choropleth", "timeseries"),
    }


def preset_members(entries: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """(preset, group_id) for every entry a preset selects; one pass for all presets."""
    rules = preset_rules() if rules is None else rules
    hit = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return entries.select(F.explode(hit).alias("preset"), "group_id")


def category_counts(registry: DataFrame, categories: DataFrame) -> DataFrame:
    """Datasets, datasets with geometry and families per category, empty categories included."""
    linked = registry.where("is_active").select(F.explode(F.array_distinct("categories")).alias("category_id"), "has_geo", "family_id")
    counted = linked.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("dataset_count"), F.count_if("has_geo").alias("geo_count"),
        F.count_distinct("family_id").alias("family_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return categories.join(counted, "category_id", "left").select(
        "category_id", "title", "position", zero("dataset_count"), zero("geo_count"), zero("family_count"))


def category_groups(registry: DataFrame, families: DataFrame) -> DataFrame:
    """Per category: families collapsed to one group with member count and sorted years, plus singles."""
    linked = registry.where("is_active").withColumn("category_id", F.explode(F.array_distinct("categories")))
    return (
        linked.join(families.select("family_id", F.col("title").alias("_ft")), "family_id", "left")
        .groupBy("category_id", F.coalesce("family_id", "dataset_id").alias("group_id"))
        .agg(F.bool_or(F.col("family_id").isNotNull()).alias("is_family"), F.coalesce(F.max("_ft"), F.min("title")).alias("title"),
             F.count(F.lit(1)).alias("members"), sorted_set("family_year").alias("years")))


def feature_groups(features: DataFrame, registry: DataFrame, families: DataFrame) -> DataFrame:
    """Map layers: families collapsed, with years, counts and geometry types."""
    per_dataset = features.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"), sorted_set("year").alias("ys"), sorted_set("geom_type").alias("gs"))
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return (
        per_dataset.join(registry.where("is_active").select("dataset_id", "family_id", "title"), "dataset_id")
        .join(families.select("family_id", F.col("title").alias("_ft")), "family_id", "left")
        .groupBy(F.coalesce("family_id", "dataset_id").alias("group_id"))
        .agg(F.coalesce(F.max("_ft"), F.min("title")).alias("title"), F.sum("n").alias("feature_count"),
             merged("ys").alias("years"), merged("gs").alias("geom_types")))


def timeline_years(groups: DataFrame) -> DataFrame:
    """Sorted union of the years of the selected groups."""
    return groups.select(F.explode("years").alias("year")).distinct().orderBy("year")


def indicator_topics(indicators: DataFrame) -> DataFrame:
    return indicators.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def indicator_list(indicators: DataFrame, mapping: DataFrame, stats: DataFrame, topic: str | None = None,
                   search: str | None = None) -> DataFrame:
    """Indicators with source count, distinct units and latest year."""
    chosen = indicators
    if topic:
        chosen = chosen.where(F.col("topic") == topic)
    if search:
        chosen = chosen.where(tx.contains_text(F.col("name"), search))
    reduced = stats.groupBy("dataset_id", "metric_name").agg(
        sorted_set("metric_unit").alias("_us"), F.max("period_year").alias("_y"))
    facts = mapping.join(reduced, ["dataset_id", "metric_name"], "left").groupBy("indicator_id").agg(
        F.count_distinct("dataset_id").alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_us")))).alias("units"), F.max("_y").alias("latest_year"))
    return chosen.select("indicator_id", "name", "topic", "unit").join(facts, "indicator_id", "left")


# --- package metadata -------------------------------------------------------------------------------

def package_formats(packages: DataFrame) -> DataFrame:
    """Title, notes, creation and the distinct upper-case formats of a package's resources."""
    formats = F.array_sort(F.array_distinct(F.filter(
        F.transform("resources", lambda r: F.upper(F.trim(r["format"]))), lambda f: f.isNotNull() & (f != ""))))
    return packages.select("id", "title", "notes", "metadata_created", F.array_join(formats, ", ").alias("formats"))


def package_detail(packages: DataFrame, preview: int = 200) -> DataFrame:
    """Flat view; the notes column keeps the whole text, the preview is an extra column."""
    return packages.select(
        "id", "title", F.coalesce("organization", F.lit("")).alias("organization"), F.array_join("groups", ", ").alias("groups"),
        F.array_join("tags", ", ").alias("tags"), F.size("resources").alias("resource_count"),
        F.substring("notes", 1, preview).alias("notes_preview"), "notes")


def package_samples(packages: DataFrame, rows: DataFrame, order: list[Column], k: int = 5) -> DataFrame:
    """First k rows of each package's first queryable resource, and a note where there is none.
    ``rows`` carries resource_id; the window limit keeps k rows per map task and key."""
    active = F.filter("resources", lambda r: r["datastore_active"])
    first = packages.select("id", F.get(active, F.lit(0))["id"].alias("resource_id"))
    sampled = top_per_key(rows, ["resource_id"], order, k)
    return first.join(sampled, "resource_id", "left").withColumn(
        "note", F.when(F.col("resource_id").isNull(), "no queryable resource"))


def package_counters(packages: DataFrame) -> DataFrame:
    """(dimension, value, n): packages by organisation, group and licence, resources by format."""
    one = lambda d, c: F.struct(F.lit(d).alias("dimension"), c.alias("value"))
    groups = F.when(F.size("groups") > 0, F.col("groups")).otherwise(F.array(F.lit("(No group)")))
    fmt = lambda r: F.coalesce(F.nullif(F.upper(F.trim(r["format"])), F.lit("")), F.lit("UNKNOWN"))
    entries = F.concat(
        F.array(one("organization", F.coalesce("organization", F.lit("(No organization)"))),
                one("license", F.coalesce("license", F.lit("UNKNOWN")))),
        F.transform(groups, lambda g: one("group", g)), F.transform("resources", lambda r: one("format", fmt(r))))
    return packages.select(F.inline(entries)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def resource_spread(packages: DataFrame) -> DataFrame:
    n = F.size("resources")
    return packages.agg(F.count(F.lit(1)).alias("packages"), F.avg(n).alias("avg_resources"),
                        F.max(n).alias("max_resources"), F.min(n).alias("min_resources"))


def group_availability(packages: DataFrame, k: int = 15) -> DataFrame:
    """Share of packages with a queryable resource per group; the k best groups."""
    live = F.exists("resources", lambda r: F.coalesce(r["datastore_active"], F.lit(False)))
    groups = F.when(F.size("groups") > 0, F.col("groups")).otherwise(F.array(F.lit("(No group)")))
    rated = packages.select(F.explode(groups).alias("group"), live.alias("live")).groupBy("group").agg(
        F.count(F.lit(1)).alias("packages"), F.count_if("live").alias("available"))
    return rated.withColumn("rate", F.col("available") / F.col("packages")).orderBy(
        F.desc("rate"), F.desc("packages"), F.asc("group")).limit(k)
