"""Election queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import analytics as an, browse as br, elections as el
from civicspark.plans import roles
from civicspark.plans.registry import Tables, query
from civicspark.plans.roles import ctes
from civicspark.session import settled


def _pct(part: str, whole: str) -> str:
    """Half-up percentage with two digits in integer arithmetic."""
    return f"CAST((20000 * {part} + {whole}) // (2 * {whole}) AS DOUBLE) / 100"


@query("party_alias", ctes("votes", "party_registry", "party_aliases") + """
SELECT party raw_party, key party_key, coalesce(name, party) party_name, CAST(sum(n_cast) AS BIGINT) votes
FROM votes LEFT JOIN party_aliases ON alias_norm = lower(trim(party)) LEFT JOIN party_registry ON key = party_key GROUP BY 1, 2, 3
""")
def party_alias(t: Tables):
    totals = t.orders.groupBy(F.col("o_orderpriority").alias("raw_party")).agg(F.count(F.lit(1)).alias("votes"))
    return el.with_party(totals, roles.party_registry(t.spark)).select("raw_party", "party_key", "party_name", "votes")


_SHARES = ctes("exact_results", "share_statistics", "election_sources", "party_registry", "party_aliases") + """,
rs AS (SELECT election_type, year, level, spatial_code, min(gebiet_name) gebiet_name, party raw_party, CAST(sum(zweitstimmen) AS DOUBLE) * 100 / nullif(sum(gueltige_zweit), 0) share_pct,
  CAST(sum(zweitstimmen) AS BIGINT) votes, CAST(sum(waehler) AS DOUBLE) * 100 / nullif(sum(wahlberechtigte), 0) turnout_pct, 'results' source FROM exact_results GROUP BY 1, 2, 3, 4, 6),
tb AS (SELECT dataset_id, spatial_code, period_year, avg(metric_value) turnout_pct FROM share_statistics WHERE metric_name = 'Wahlbeteiligung' GROUP BY 1, 2, 3),
ss AS (SELECT es.election_type, s.period_year AS year, s.spatial_unit AS level, s.spatial_code, min(s.spatial_key) gebiet_name, substr(metric_name, 16) raw_party, avg(metric_value) share_pct,
  CAST(NULL AS BIGINT) votes, min(tb.turnout_pct) turnout_pct, 'statistik' source FROM share_statistics s JOIN election_sources es USING (dataset_id)
  LEFT JOIN tb ON tb.dataset_id = s.dataset_id AND tb.spatial_code = s.spatial_code AND tb.period_year = s.period_year
  WHERE metric_name LIKE 'Stimmenanteile %' AND NOT EXISTS (SELECT 1 FROM exact_results r WHERE r.election_type = es.election_type AND r.year = s.period_year AND r.level = s.spatial_unit)
  GROUP BY 1, 2, 3, 4, 6),
eps AS (SELECT u.*, p.key party_key, coalesce(p.name, u.raw_party) party_name, p.position party_position, p.color party_color FROM (SELECT * FROM rs UNION ALL SELECT * FROM ss) u
  LEFT JOIN party_aliases ON alias_norm = lower(trim(raw_party)) LEFT JOIN party_registry p ON p.key = party_key)
"""


def _shares(t: Tables):
    return el.party_shares(roles.exact_results(t), roles.share_statistics(t), roles.election_sources(t.spark), roles.party_registry(t.spark))


@query("election_party_shares", _SHARES + """
SELECT election_type, year, level, spatial_code, gebiet_name, raw_party, party_key, party_name, party_position, party_color, round(share_pct, 4) share_pct, votes, round(turnout_pct, 4) turnout_pct, source FROM eps
""")
def election_party_shares(t: Tables):
    return _shares(t).select("election_type", "year", "level", "spatial_code", "gebiet_name", "raw_party", "party_key", "party_name", "party_position",
                             "party_color", F.round("share_pct", 4).alias("share_pct"), "votes", F.round("turnout_pct", 4).alias("turnout_pct"), "source")


@query("spectrum_options", _SHARES + """
SELECT election_type, year, string_agg(DISTINCT level, '|') levels FROM eps WHERE EXISTS (SELECT 1 FROM (SELECT 'nation' boundary_type, 0 boundary_year) b WHERE b.boundary_type = eps.level AND (b.boundary_year = 0 OR b.boundary_year = eps.year)) GROUP BY 1, 2
""")
def spectrum_options(t: Tables):
    return el.spectrum_options(settled(_shares(t), "shares-mart"), roles.boundaries(t)).withColumn("levels", F.array_join("levels", "|"))


_SPECTRUM = _SHARES + """, sp AS (SELECT election_type, year, level, spatial_code, gebiet_name, round(round(sum(party_position * share_pct) FILTER (WHERE party_position IS NOT NULL)
   / nullif(sum(share_pct) FILTER (WHERE party_position IS NOT NULL), 0), 10), 4) score,
  round(round(coalesce(sum(share_pct) FILTER (WHERE party_position IS NOT NULL), 0), 10), 2) coverage_pct, round(max(turnout_pct), 4) turnout_pct,
  string_agg(party_name, '|' ORDER BY share_pct DESC, party_name) FILTER (WHERE party_position IS NOT NULL) || CASE WHEN sum(share_pct) FILTER (WHERE party_position IS NULL) > 0 THEN '|Sonstige' ELSE '' END parties FROM eps GROUP BY 1, 2, 3, 4, 5)
"""


@query("spectrum_score", _SPECTRUM + "SELECT election_type, year, level, spatial_code, gebiet_name boundary_name, score, coverage_pct, turnout_pct, parties FROM sp")
def spectrum_score(t: Tables):
    areas = el.spectrum_areas(_shares(t), roles.boundaries(t))
    return areas.withColumn("turnout_pct", F.round("turnout_pct", 4)).withColumn(
        "parties", F.array_join(F.transform("parties", lambda p: p["name"]), "|"))


@query("spectrum_ramp", _SPECTRUM + "SELECT election_type, year, spatial_code, round((greatest(-1, least(1, score)) + 1) / 2, 6) ramp FROM sp")
def spectrum_ramp(t: Tables):
    areas = el.spectrum_areas(_shares(t), roles.boundaries(t))
    return areas.select("election_type", "year", "spatial_code", F.round(an.diverging_position(F.col("score")), 6).alias("ramp"))


@query("election_list", ctes("exact_results") + """
SELECT election_id, election_type, year, 'nation' levels, count(DISTINCT party) parties FROM exact_results GROUP BY 1, 2, 3
""")
def election_list(t: Tables):
    return el.election_list(roles.exact_results(t)).withColumn("levels", F.array_join("levels", "|"))


@query("election_summary", ctes("exact_results", "party_registry", "party_aliases") + f""", c AS (SELECT election_id, party, CAST(sum(zweitstimmen) AS BIGINT) z, CAST(sum(gueltige_zweit) AS BIGINT) g,
 CAST(sum(wahlberechtigte) AS BIGINT) b, CAST(sum(waehler) AS BIGINT) w FROM exact_results GROUP BY 1, 2)
SELECT election_id, party, z zweitstimmen, {_pct('z', 'g')} anteil_pct, {_pct('w', 'b')} turnout_pct, color party_color, {_pct('z', 'g')} >= 1 in_chart
FROM c LEFT JOIN party_aliases ON alias_norm = lower(trim(party)) LEFT JOIN party_registry ON key = party_key
""")
def election_summary(t: Tables):
    got = el.election_summary(el.city_totals(roles.exact_results(t)), roles.party_registry(t.spark))
    return got.select("election_id", "party", "zweitstimmen", "anteil_pct", "turnout_pct", "party_color", "in_chart").orderBy(
        "election_id", F.desc_nulls_last("zweitstimmen"), "party")


@query("election_results", ctes("exact_results") + f"""
SELECT gebiet_code, party, zweitstimmen, {_pct('zweitstimmen', 'gueltige_zweit')} anteil_pct FROM exact_results WHERE election_id = 'wahl1999' AND level = 'nation'
ORDER BY gebiet_code, party LIMIT 50 OFFSET 20
""")
def election_results(t: Tables):
    rows = el.election_rows(roles.exact_results(t), "wahl1999", "nation")
    return br.page(rows.select("gebiet_code", "party", "zweitstimmen", "anteil_pct"), [F.asc("gebiet_code"), F.asc("party")], 50, 20)


@query("election_choropleth", ctes("exact_results") + f"""
SELECT election_id, gebiet_code, gebiet_name boundary_name, zweitstimmen, {_pct('zweitstimmen', 'gueltige_zweit')} anteil_pct FROM exact_results WHERE party = '2-HIGH'
""")
def election_choropleth(t: Tables):
    return el.election_choropleth(roles.exact_results(t), roles.boundaries(t), "2-HIGH").select(
        "election_id", "gebiet_code", "boundary_name", "zweitstimmen", "anteil_pct")


@query("match_shares")
def match_shares(t: Tables):
    city = el.city_totals(roles.election_results(t))
    share = F.col("zweitstimmen") * 100.0 / F.col("gueltige_zweit")
    columns = city.select("election_id", F.substring("party", 1, 1).cast("int").alias("idx"), share.alias("share"))
    # the official list leaves the last party out and rounds to two digits
    named = city.where("party <> '5-LOW'").select("election_id", F.substring("party", 3, 99).alias("name"), F.round(share, 2).alias("ref"))
    return el.match_columns(columns, named).withColumn("delta", F.round("delta", 6))


