"""Catalog and browse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import browse as br, catalog as ct
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.plans.roles import ctes

_PACKAGES = """packages AS (
 SELECT p_partkey id, p_name || ' ' || p_partkey title, p_brand organization, CASE WHEN p_size % 9 = 0 THEN [] ELSE [lower(p_type)] END "groups",
  string_split(p_name, ' ') tags, CASE WHEN p_size % 4 <> 0 THEN 'dl-de-' || p_size % 4 END license, repeat(p_name || ' / ', 1 + CAST(p_size AS INTEGER)) notes,
  list_filter([{'id': p_partkey || '-a', 'format': CASE WHEN p_size % 2 = 0 THEN 'csv' ELSE 'CSV' END, 'active': p_size % 3 = 0},
   {'id': p_partkey || '-b', 'format': CASE WHEN p_size % 5 = 0 THEN '' ELSE 'GeoJSON' END, 'active': p_size % 2 = 0},
   {'id': p_partkey || '-c', 'format': 'csv', 'active': NULL}], lambda r: p_size > 10 OR right(r.id, 1) = 'a') resources, p_size FROM part)"""


def _packages(t: Tables):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    res = lambda mark, fmt, active: F.struct(
        F.concat(key, F.lit("-" + mark)).alias("id"), fmt.alias("format"), active.cast("boolean").alias("datastore_active"))
    resources = F.array(
        res("a", F.when(size % 2 == 0, "csv").otherwise("CSV"), size % 3 == 0),
        res("b", F.when(size % 5 == 0, "").otherwise("GeoJSON"), size % 2 == 0),
        res("c", F.lit("csv"), F.lit(None)))
    return t.part.select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), key).alias("title"), F.col("p_brand").alias("organization"),
        F.when(size % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("p_type"))).alias("groups"),
        F.split("p_name", " ").alias("tags"),
        F.when(size % 4 != 0, F.concat(F.lit("dl-de-"), (size % 4).cast("string"))).alias("license"),
        F.expr("repeat(concat(p_name, ' / '), 1 + p_size)").alias("notes"), F.lit("2024-01-01").alias("metadata_created"),
        F.filter(resources, lambda r: (size > 10) | r["id"].endswith("a")).alias("resources"))


@query("catalog_formats", "WITH " + _PACKAGES + """
SELECT id, title, CASE WHEN p_size <= 10 OR p_size % 5 = 0 THEN 'CSV' ELSE 'CSV, GEOJSON' END formats FROM packages
""")
def catalog_formats(t: Tables):
    return ct.package_formats(_packages(t)).select("id", "title", "formats")


@query("catalog_detail", "WITH " + _PACKAGES + """
SELECT id, title, organization, array_to_string("groups", ', ') AS "groups", array_to_string(tags, ', ') tags, CAST(len(resources) AS INTEGER) resource_count,
 left(notes, 200) notes_preview, notes FROM packages
""")
def catalog_detail(t: Tables):
    return ct.package_detail(_packages(t))


@query("catalog_samples", "WITH " + _PACKAGES + """, f AS (SELECT id, list_filter(resources, lambda r: r.active)[1].id resource_id FROM packages),
s AS (SELECT * FROM (SELECT l_partkey || '-a' resource_id, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) rn
  FROM lineitem) WHERE rn <= 5)
SELECT id, f.resource_id, l_orderkey, l_linenumber, l_quantity, CASE WHEN f.resource_id IS NULL THEN 'no queryable resource' END note FROM f LEFT JOIN s ON s.resource_id = f.resource_id
""")
def catalog_samples(t: Tables):
    rows = t.lineitem.select(F.concat(F.col("l_partkey").cast("string"), F.lit("-a")).alias("resource_id"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    order = [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")]
    return ct.package_samples(_packages(t), rows, order).drop("l_extendedprice")


@query("catalog_counters", "WITH " + _PACKAGES + """
SELECT 'organization' dimension, organization AS value, count(*) n FROM packages GROUP BY 2
UNION ALL SELECT 'license', coalesce(license, 'UNKNOWN'), count(*) FROM packages GROUP BY 2
UNION ALL SELECT 'group', coalesce("groups"[1], '(No group)'), count(*) FROM packages GROUP BY 2
UNION ALL SELECT 'format', coalesce(nullif(upper(r.format), ''), 'UNKNOWN'), count(*) FROM (SELECT unnest(resources) r FROM packages) GROUP BY 2
""")
def catalog_counters(t: Tables):
    return ct.package_counters(_packages(t))


@query("resource_spread", "WITH " + _PACKAGES + """
SELECT count(*) packages, round(avg(len(resources)), 4) avg_resources, CAST(max(len(resources)) AS INTEGER) max_resources, CAST(min(len(resources)) AS INTEGER) min_resources FROM packages
""")
def resource_spread(t: Tables):
    return ct.resource_spread(_packages(t)).withColumn("avg_resources", F.round("avg_resources", 4))


@query("group_availability", "WITH " + _PACKAGES + """
SELECT coalesce("groups"[1], '(No group)') AS "group", count(*) packages, count(*) FILTER (WHERE p_size % 3 = 0 OR (p_size > 10 AND p_size % 2 = 0)) available,
 round(count(*) FILTER (WHERE p_size % 3 = 0 OR (p_size > 10 AND p_size % 2 = 0)) / count(*), 4) rate FROM packages GROUP BY 1 ORDER BY 4 DESC, 2 DESC, 1 LIMIT 15
""")
def group_availability(t: Tables):
    return ct.group_availability(_packages(t)).withColumn("rate", F.round("rate", 4))


# --- families, categories, indicators -------------------------------------------------------------

@query("families_detect", ctes("registry") + """, b AS (SELECT dataset_id, title, lower(left(title, length(title) - 5)) base, left(title, length(title) - 5) shown, CAST(right(title, 4) AS INTEGER) y FROM registry),
k AS (SELECT base, min(shown) family_title FROM b GROUP BY 1 HAVING count(*) >= 2)
SELECT replace(base, ' ', '-') family_id, family_title, dataset_id, title, y AS year, FALSE needs_review FROM b JOIN k USING (base)
""")
def families_detect(t: Tables):
    return ct.detect_families(roles.registry(t))


_CATS = """, own AS (SELECT DISTINCT dataset_id, lower(p_type) category_id FROM registry r JOIN part ON p_partkey = CAST(dataset_id AS BIGINT) WHERE part.p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4','Brand#5')),
members AS (SELECT family_id, dataset_id FROM registry WHERE family_id IS NOT NULL),
urls AS (SELECT dataset_id, CASE WHEN p_size % 3 = 1 THEN 'https://statistik.leipzig.de/x?kategorie_nr=' || p_size % 17 ELSE 'https://other/x?kategorie_nr=1' END url FROM registry),
km(k, c) AS (VALUES (1,'regionen-und-staedte'),(2,'bevoelkerung-und-gesellschaft'),(3,'bevoelkerung-und-gesellschaft'),(4,'bevoelkerung-und-gesellschaft'),(5,'bildung-kultur-und-sport'),
 (6,'regionen-und-staedte'),(7,'wirtschaft-und-finanzen'),(8,'wirtschaft-und-finanzen'),(9,'bevoelkerung-und-gesellschaft'),(10,'verkehr'),(11,'bildung-kultur-und-sport'),
 (12,'justiz-rechtssystem-und-oeffentliche-sicherheit'),(13,'umwelt'),(14,'regierung-und-oeffentlicher-sektor'),(15,'bevoelkerung-und-gesellschaft'),(15,'regierung-und-oeffentlicher-sektor')),
inh AS (SELECT DISTINCT m.dataset_id, o.category_id FROM members m JOIN members s USING (family_id) JOIN own o ON o.dataset_id = s.dataset_id WHERE m.dataset_id NOT IN (SELECT dataset_id FROM own)),
rest AS (SELECT * FROM urls WHERE dataset_id NOT IN (SELECT dataset_id FROM own UNION SELECT dataset_id FROM inh)),
mapped AS (SELECT dataset_id, c FROM rest JOIN km ON k = CAST(nullif(regexp_extract(url, 'kategorie_nr=([0-9]+)', 1), '') AS INTEGER) WHERE url LIKE '%statistik%')
"""


@query("categories_assign", ctes("registry") + _CATS + """
SELECT dataset_id, category_id, 'group' source FROM own UNION ALL SELECT dataset_id, category_id, 'family' FROM inh UNION ALL SELECT dataset_id, c, 'kategorie_nr' FROM mapped
UNION ALL SELECT dataset_id, 'sonstiges', 'fallback' FROM rest WHERE dataset_id NOT IN (SELECT dataset_id FROM mapped)
""")
def categories_assign(t: Tables):
    reg = roles.registry(t)
    url = F.when(F.col("p_size") % 3 == 1, F.concat(F.lit("https://statistik.leipzig.de/x?kategorie_nr="), (F.col("p_size") % 17).cast("string"))).otherwise(
        "https://other/x?kategorie_nr=1")
    listed = reg.where(F.array_contains("categories", "brand#1") | F.arrays_overlap("categories", F.array(*[F.lit(f"brand#{i}") for i in range(2, 6)])))
    own = listed.select("dataset_id", F.col("categories")[0].alias("category_id"))
    members = reg.where("family_id is not null").select("family_id", "dataset_id")
    return ct.assign_categories(reg.select("dataset_id", url.alias("url")), own, members)


@query("indicator_fold", ctes("registry") + """, m AS (SELECT dataset_id, CAST(dataset_id AS BIGINT) pos, p_name || CASE WHEN p_size % 7 = 0 THEN ' netto' ELSE '' END canonical,
  best_format topic, CASE WHEN p_size % 2 = 0 THEN 'Euro' ELSE NULL END unit, CASE WHEN p_size % 7 = 0 THEN title ELSE 'Bestand' END stem FROM registry),
a AS (SELECT canonical, min(stem) < max(stem) amb FROM m GROUP BY 1),
n AS (SELECT m.*, CASE WHEN amb THEN stem || ': ' || canonical ELSE canonical END AS name FROM m JOIN a USING (canonical)),
i AS (SELECT *, left(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), 80) indicator_id FROM n),
tp AS (SELECT indicator_id, topic, count(*) c, min(pos) f FROM i GROUP BY 1, 2)
SELECT indicator_id, arg_min(name, pos) AS name, arg_min(unit, pos) FILTER (WHERE unit IS NOT NULL) unit,
 (SELECT topic FROM tp WHERE tp.indicator_id = i.indicator_id ORDER BY c DESC, f LIMIT 1) topic, count(*) metrics FROM i GROUP BY indicator_id
""")
def indicator_fold(t: Tables):
    odd = F.col("p_size") % 7 == 0
    raw = F.concat("p_name", F.when(odd, " netto").otherwise(""), F.when(F.col("p_size") % 2 == 0, " in Euro").otherwise(""))
    metrics = roles.registry(t).select(
        "dataset_id", F.when(odd, F.concat("title", F.lit(" (kleinräumig)"))).otherwise("Bestand").alias("title"),
        F.col("best_format").alias("topic"), raw.alias("raw_name"), F.lit(None).cast("string").alias("unit"),
        F.col("dataset_id").cast("bigint").alias("pos"))
    return ct.fold_indicators(metrics)[0]


# --- capabilities and catalog ------------------------------------------------------------------------

def _geo_store(t: Tables):
    return roles.features(t).withColumn("dataset_id", F.col("feature_id"))


def _works(t: Tables):
    return roles.restrictions(t).withColumn("dataset_id", F.regexp_replace("dataset_id", "^r", ""))


def _caps(t: Tables):
    return ct.capabilities(roles.registry(t), _geo_store(t), roles.facts(t), _works(t), roles.categories(t))


_THEME = """th AS (SELECT dataset_id, arg_min(category_id, (category_id = 'sonstiges', "position", category_id)) theme_id FROM (SELECT dataset_id, unnest(categories) category_id FROM registry) JOIN categories USING (category_id) GROUP BY 1)"""
_CATALOG = ctes("registry", "families", "features", "restrictions", "facts", "categories") + ", " + _THEME + """,
g AS (SELECT feature_id dataset_id, count(*) n, list(DISTINCT CASE WHEN geom_type LIKE '%Polygon' THEN 'area' WHEN geom_type LIKE '%Line%' THEN 'line' ELSE 'point' END) ks,
  list(DISTINCT feature_type) fts, list(DISTINCT year) ys FROM features GROUP BY 1),
so AS (SELECT dataset_id, count(*) n, count(DISTINCT metric_name) m FROM facts WHERE spatial_unit <> 'city' GROUP BY 1),
sc AS (SELECT dataset_id, count(*) n, count(DISTINCT metric_name) m, count(DISTINCT period_year) y FROM facts WHERE spatial_unit = 'city' GROUP BY 1),
tr AS (SELECT replace(dataset_id, 'r', '') dataset_id, count(*) n FROM restrictions GROUP BY 1),
caps AS (SELECT r.*, coalesce(g.n, 0) geo_n, g.ks, g.fts, g.ys, coalesce(so.n, 0) ort_n, coalesce(so.m, 0) ort_metrics, coalesce(sc.n, 0) city_n, coalesce(sc.m, 0) city_metrics,
  coalesce(sc.y, 0) city_years, coalesce(tr.n, 0) traffic_n, theme_id FROM registry r LEFT JOIN g USING (dataset_id) LEFT JOIN so USING (dataset_id) LEFT JOIN sc USING (dataset_id)
  LEFT JOIN tr USING (dataset_id) LEFT JOIN th USING (dataset_id) WHERE is_active),
cat AS (SELECT coalesce(family_id, dataset_id) group_id, bool_or(family_id IS NOT NULL) is_family, coalesce(max(families.title), min(caps.title)) title, min(slug) slug,
  coalesce(min(theme_id), 'sonstiges') theme, count(*) datasets, CAST(sum(geo_n) AS BIGINT) geo_n, CAST(sum(ort_n) AS BIGINT) ort_n, CAST(sum(city_n) AS BIGINT) city_n, CAST(sum(traffic_n) AS BIGINT) traffic_n,
  CAST(sum(ort_metrics) AS BIGINT) ort_metrics, CAST(sum(city_metrics) AS BIGINT) city_metrics, max(city_years) city_years, bool_or(schedule = 'live') live,
  list_sort(list_distinct(flatten(list(ks) FILTER (WHERE ks IS NOT NULL)))) ks, list_sort(list_distinct(flatten(list(fts) FILTER (WHERE fts IS NOT NULL)))) fts,
  list_sort(list_distinct(flatten(list(ys) FILTER (WHERE ys IS NOT NULL)))) ys
 FROM caps LEFT JOIN families USING (family_id) WHERE geo_n + ort_n + city_n + traffic_n > 0 GROUP BY 1),
kinds AS (SELECT *, CASE WHEN geo_n > 0 OR traffic_n > 0 THEN 'geo' WHEN ort_n > 0 THEN 'choropleth' WHEN city_n > 0 AND city_years > 1 THEN 'timeseries' ELSE 'distribution' END kind,
  array_to_string(list_filter([CASE WHEN live THEN 'Live' END, CASE WHEN geo_n > 0 OR traffic_n > 0 THEN 'Geo' END, CASE WHEN ort_n > 0 THEN 'Ortsteil' END, CASE WHEN city_n > 0 THEN 'Stadt' END,
   CASE WHEN city_years > 1 OR len(ys) > 1 THEN 'Zeitreihe' END], lambda b: b IS NOT NULL), '|') badges,
  CASE WHEN traffic_n > 0 OR list_contains(ks, 'area') THEN 'area' WHEN list_contains(ks, 'line') THEN 'line' WHEN list_contains(ks, 'point') THEN 'point' END geometry FROM cat)
"""


@query("catalog", _CATALOG + """
SELECT group_id, is_family, title, slug, theme, datasets, geo_n, ort_n, city_n, traffic_n, ort_metrics, city_metrics, city_years, live, coalesce(array_to_string(fts, '|'), '') feature_types,
 coalesce(array_to_string(ys, '|'), '') AS years FROM kinds
""")
def catalog(t: Tables):
    got = ct.catalog(_caps(t), roles.families(t))
    return got.select(
        "group_id", "is_family", "title", "slug", "theme", "datasets", "geo_n", "ort_n", "city_n", "traffic_n", "ort_metrics", "city_metrics", "city_years", "live",
        F.array_join("feature_types", "|").alias("feature_types"), F.array_join("years", "|").alias("years"))


@query("catalog_kind", _CATALOG + "SELECT group_id, kind, badges, geometry, nullif(geo_n + traffic_n, 0) feature_count FROM kinds")
def catalog_kind(t: Tables):
    return ct.catalog(_caps(t), roles.families(t)).select("group_id", "kind", F.array_join("badges", "|").alias("badges"), "geometry", "feature_count")


@query("catalog_members", _CATALOG + "SELECT coalesce(family_id, dataset_id) group_id, dataset_id FROM caps WHERE geo_n + ort_n + city_n + traffic_n > 0")
def catalog_members(t: Tables):
    return ct.catalog_members(_caps(t))


@query("catalog_presets", _CATALOG + """
SELECT 'formen' preset, group_id FROM kinds WHERE list_contains(fts, 'zone') OR lower(title) LIKE '%gear%' UNION ALL
SELECT 'raeder', group_id FROM kinds WHERE (lower(title) LIKE '%widget%' OR lower(title) LIKE '%ring%') AND kind = 'geo' UNION ALL
SELECT 'bestand', group_id FROM kinds WHERE theme = 'economy' AND kind IN ('choropleth', 'timeseries')
""")
def catalog_presets(t: Tables):
    title = F.lower("title")
    rules = {
        "formen": F.arrays_overlap("feature_types", F.array(F.lit("zone"))) | title.contains("gear"),
        "raeder": (title.contains("widget") | title.contains("ring")) & (F.col("kind") == "geo"),
        "bestand": (F.col("theme") == "economy") & F.col("kind").isin("choropleth", "timeseries"),
    }
    return ct.preset_members(ct.catalog(_caps(t), roles.families(t)), rules)


@query("catalog_search", _CATALOG + """
SELECT group_id, kinds.title, theme, coalesce(c.title, theme) theme_title, coalesce(c."position", 99) AS "position" FROM kinds LEFT JOIN categories c ON c.category_id = theme
WHERE lower(kinds.title) LIKE '%hot g%'
""")
def catalog_search(t: Tables):
    hits = br.catalog_search(ct.catalog(_caps(t), roles.families(t)), roles.categories(t), " Hot G")
    return hits.select("group_id", "title", "theme", "theme_title", "position").orderBy("position", "theme_title", "title", "group_id")


@query("theme_of_dataset", ctes("registry", "categories") + ", " + _THEME + " SELECT dataset_id, theme_id FROM th")
def theme_of_dataset(t: Tables):
    return ct.best_theme(roles.registry(t), roles.categories(t))


@query("category_counts", ctes("registry", "categories") + """
SELECT c.category_id, c.title, c."position", count(d.dataset_id) dataset_count, count(d.dataset_id) FILTER (WHERE d.has_geo) geo_count, count(DISTINCT d.family_id) family_count
FROM categories c LEFT JOIN registry d ON list_contains(d.categories, c.category_id) AND d.is_active GROUP BY 1, 2, 3
""")
def category_counts(t: Tables):
    return ct.category_counts(roles.registry(t), roles.categories(t))


@query("category_detail", ctes("registry", "families") + """
SELECT category_id, coalesce(family_id, dataset_id) group_id, bool_or(family_id IS NOT NULL) is_family, coalesce(max(f.title), min(r.title)) title, count(*) members,
 array_to_string(list_sort(list(DISTINCT family_year)), '|') AS years
FROM (SELECT *, unnest(categories) category_id FROM registry WHERE is_active) r LEFT JOIN families f USING (family_id) GROUP BY 1, 2
""")
def category_detail(t: Tables):
    return ct.category_groups(roles.registry(t), roles.families(t)).withColumn("years", F.array_join("years", "|"))


_GROUPS = ctes("registry", "families", "features") + """, fg AS (
 SELECT coalesce(r.family_id, r.dataset_id) group_id, coalesce(max(f.title), min(r.title)) title, count(*) feature_count, list_sort(list(DISTINCT x.year)) AS ys, list_sort(list(DISTINCT geom_type)) geom_types
 FROM features x JOIN registry r ON r.dataset_id = x.feature_id AND r.is_active LEFT JOIN families f USING (family_id) GROUP BY 1)
"""


@query("feature_groups", _GROUPS + "SELECT group_id, title, feature_count, array_to_string(ys, '|') AS years, array_to_string(geom_types, '|') geom_types FROM fg")
def feature_groups(t: Tables):
    got = ct.feature_groups(_geo_store(t), roles.registry(t), roles.families(t))
    return got.withColumns({"years": F.array_join("years", "|"), "geom_types": F.array_join("geom_types", "|")})


@query("timeline_years", _GROUPS + "SELECT DISTINCT unnest(ys) AS year FROM fg WHERE list_contains(geom_types, 'Polygon')")
def timeline_years(t: Tables):
    got = ct.feature_groups(_geo_store(t), roles.registry(t), roles.families(t))
    return ct.timeline_years(got.where(F.array_contains("geom_types", "Polygon")))


# --- indicators on statistics --------------------------------------------------------------------------

def _indicators(t: Tables):
    """Catalog of the long metrics: every metric of a linestatus forms one indicator."""
    named = roles.facts(t).select("dataset_id", "metric_name").distinct().withColumn(
        "indicator_id", F.regexp_replace(F.regexp_replace("metric_name", "_[0-9]$", ""), "_", "-"))
    mapping = named.where("metric_name not like '%_7'")
    indicators = mapping.select("indicator_id").distinct().select(
        "indicator_id", F.initcap(F.replace("indicator_id", F.lit("-"), F.lit(" "))).alias("name"),
        F.when(F.col("indicator_id").endswith("O"), "Offen").otherwise("Fertig").alias("topic"), F.lit("Stück").alias("unit"))
    return indicators, mapping


_IND = """, mp AS (SELECT DISTINCT dataset_id, metric_name, replace(left(metric_name, 7), '_', '-') indicator_id FROM facts WHERE right(metric_name, 2) <> '_7'),
ind AS (SELECT DISTINCT indicator_id, 'Menge ' || right(indicator_id, 1) AS name, CASE WHEN indicator_id LIKE '%O' THEN 'Offen' ELSE 'Fertig' END topic, 'Stück' unit FROM mp)
"""


@query("indicator_topics", ctes("facts") + _IND + "SELECT topic, count(*) n FROM ind GROUP BY 1")
def indicator_topics(t: Tables):
    return ct.indicator_topics(_indicators(t)[0])


@query("indicator_list", ctes("facts") + _IND + """
SELECT i.indicator_id, i.name, i.topic, i.unit, count(DISTINCT m.dataset_id) sources, '' AS units, max(f.period_year) latest_year
FROM ind i JOIN mp m USING (indicator_id) JOIN facts f ON f.dataset_id = m.dataset_id AND f.metric_name = m.metric_name GROUP BY 1, 2, 3, 4
""")
def indicator_list(t: Tables):
    ind, mp = _indicators(t)
    stats = roles.facts(t).withColumn("metric_unit", F.lit(None).cast("string"))
    return ct.indicator_list(ind, mp, stats).withColumn("units", F.array_join("units", "|"))


@query("indicator_timeseries", ctes("facts") + _IND + """
SELECT indicator_id, period_year, spatial_unit, i.unit metric_unit, count(*) n, CAST(sum(CAST(metric_value AS DECIMAL(18,2))) AS DOUBLE) total
FROM facts f JOIN mp USING (dataset_id, metric_name) JOIN ind i USING (indicator_id) GROUP BY 1, 2, 3, 4
""")
def indicator_timeseries(t: Tables):
    ind, mp = _indicators(t)
    stats = roles.facts(t).withColumn("metric_unit", F.lit(None).cast("string"))
    return br.indicator_timeseries(stats, mp, ind).groupBy("indicator_id", "period_year", "spatial_unit", "metric_unit").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("metric_value").cast(roles.MONEY)).cast("double").alias("total"))


@query("metrics_grouped", ctes("facts") + _IND + """
SELECT f.metric_name, i.indicator_id, i.name, count(*) datasets FROM (SELECT DISTINCT dataset_id, metric_name FROM facts) f LEFT JOIN mp USING (dataset_id, metric_name)
LEFT JOIN ind i USING (indicator_id) GROUP BY 1, 2, 3
""")
def metrics_grouped(t: Tables):
    ind, mp = _indicators(t)
    metrics = roles.facts(t).select("dataset_id", "metric_name").distinct()
    return br.metrics_grouped(metrics, mp, ind).groupBy("metric_name", "indicator_id", "name").agg(F.count(F.lit(1)).alias("datasets")).orderBy(
        F.asc_nulls_last("indicator_id"), "metric_name")


# --- browse ----------------------------------------------------------------------------------------------

@query("dataset_list", ctes("registry") + """, h AS (SELECT * FROM registry WHERE schedule = 'nightly' AND list_contains(categories, 'economy') AND (lower(title) LIKE '%g%' OR dataset_id LIKE '%g%'))
SELECT dataset_id, title, best_format, (SELECT count(*) FROM h) total FROM h ORDER BY title, dataset_id LIMIT 50 OFFSET 5
""")
def dataset_list(t: Tables):
    hits = br.dataset_list(roles.registry(t), schedule="nightly", category="economy", search="G")
    total = hits.agg(F.count(F.lit(1))).scalar()
    return br.page(hits.select("dataset_id", "title", "best_format"), [F.asc("title"), F.asc("dataset_id")], 50, 5).withColumn("total", total)


@query("row_browse", """
SELECT o_orderkey, o_orderpriority, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE lower(o_orderpriority) LIKE '%spec%' OR lower(o_orderstatus) LIKE '%spec%'
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500 OFFSET 100
""")
def row_browse(t: Tables):
    hits = br.search_rows(t.orders, ["o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate"], ["o_orderpriority", "o_orderstatus"], "SPEC")
    page = br.page(hits, [F.desc("o_orderdate"), F.desc("o_orderkey")], 500, 100)
    return page.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("resolve_target", ctes("registry", "features", "facts", "restrictions", "runs") + """,
lt AS (SELECT dataset_id, arg_max(target, (started_at, run_id)) tg FROM runs WHERE target = 'core.statistics' GROUP BY 1)
SELECT r.dataset_id, coalesce(tg, CASE WHEN r.dataset_id IN (SELECT feature_id FROM features) THEN 'core.geo_features'
 WHEN r.dataset_id IN (SELECT dataset_id FROM facts) THEN 'core.statistics' END) target_table FROM registry r LEFT JOIN lt USING (dataset_id)
""")
def resolve_target(t: Tables):
    log = roles.runs(t).where("target = 'core.statistics'").select("dataset_id", "run_id", F.col("target").alias("target_table"), F.col("started_at").alias("created_at"))
    stores = {"core.geo_features": _geo_store(t), "core.statistics": roles.facts(t), "core.traffic_restrictions": roles.restrictions(t)}
    return br.resolve_target(roles.registry(t), log, stores)


@query("dataset_detail", ctes("registry", "runs", "facts", "categories") + """,
rr AS (SELECT dataset_id, string_agg(status, '|' ORDER BY started_at DESC, run_id DESC) recent_status FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY started_at DESC, run_id DESC) rn FROM runs) WHERE rn <= 10 GROUP BY 1),
rc AS (SELECT dataset_id, count(*) n FROM facts GROUP BY 1),
ti AS (SELECT dataset_id, string_agg(c.title, '|' ORDER BY c."position", c.title) ts FROM (SELECT dataset_id, unnest(categories) category_id FROM registry) JOIN categories c USING (category_id) GROUP BY 1)
SELECT r.dataset_id, r.title, coalesce(rc.n, 0) row_count, recent_status, ts category_titles FROM registry r LEFT JOIN rr USING (dataset_id) LEFT JOIN rc USING (dataset_id) LEFT JOIN ti USING (dataset_id)
""")
def dataset_detail(t: Tables):
    got = br.dataset_detail(roles.registry(t), roles.runs(t), roles.facts(t), roles.categories(t))
    return got.select("dataset_id", "title", "row_count", F.array_join("recent_status", "|").alias("recent_status"), F.array_join("category_titles", "|").alias("category_titles"))


@query("dataset_history", ctes("runs") + """
SELECT a.run_id, a.dataset_id, a.target target_table, a.rows_total_after, b.status FROM runs a LEFT JOIN runs b USING (run_id) WHERE a.target IS NOT NULL
""")
def dataset_history(t: Tables):
    r = roles.runs(t)
    changes = r.where("target is not null").select("run_id", "dataset_id", F.col("target").alias("target_table"), "rows_total_after")
    return br.change_history(changes, r).drop("started_at")


@query("dataset_status", ctes("registry", "runs") + """,
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY started_at DESC, run_id DESC) rn FROM runs) WHERE rn = 1)
SELECT r.dataset_id, title, status last_run_status, strftime(started_at, '%Y-%m-%d %H:%M:%S') last_run_at, rows_loaded last_run_rows FROM registry r LEFT JOIN n USING (dataset_id)
""")
def dataset_status(t: Tables):
    got = br.dataset_status(roles.registry(t).select("dataset_id", "title"), roles.runs(t))
    return got.withColumn("last_run_at", F.date_format("last_run_at", "yyyy-MM-dd HH:mm:ss"))


@query("active_restrictions", ctes("restrictions") + """
SELECT dataset_id, dedup_key, title FROM restrictions WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-15 12:00:00') AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-15 12:00:00')
""")
def active_restrictions(t: Tables):
    as_of = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return br.active_at(roles.restrictions(t), as_of).select("dataset_id", "dedup_key", "title")


@query("boundary_list", ctes("boundaries") + "SELECT code, name, parent_code FROM boundaries WHERE boundary_type = 'ortsteil'")
def boundary_list(t: Tables):
    return roles.boundaries(t).where("boundary_type = 'ortsteil'").select("code", "name", "parent_code").orderBy("code")


@query("feature_detail", ctes("features", "registry") + """
SELECT x.dataset_id, x.feature_id, x.name, r.title dataset_title, x.properties FROM features x LEFT JOIN registry r ON r.dataset_id = x.feature_id WHERE x.dataset_id = 'supplier' OR x.feature_type = 'building'
""")
def feature_detail(t: Tables):
    wanted = roles.features(t).where("dataset_id = 'supplier' or feature_type = 'building'")
    reg = roles.registry(t).select(F.col("dataset_id").alias("feature_id"), F.col("title").alias("dataset_title"))
    return br.feature_detail(wanted, reg, ["feature_id"]).select("dataset_id", "feature_id", "name", "dataset_title", "properties")
