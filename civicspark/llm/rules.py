"""Quality rules whose cutoffs carry a risk guarantee, in DataFrame operations only.

Documents rated good are the holdout. Per stratum (language) and rule, cutoffs are tried from lenient
to strict; a cutoff is certified if the exact binomial tail P(Bin(n, alpha_rule) <= k), with k of n good
documents beyond it, is at most delta / (strata * rules): then its false-rejection rate is at most
alpha_rule with that confidence. The sequence stops at the first cutoff that fails, which needs no
further correction; strata and rules are corrected by Bonferroni, and alpha is split over the rules, so
in every stratum at most alpha of good documents fall, with confidence 1 - delta overall. A stratum with
too few ratings has no certified cutoff and loses nothing but what the base rules reject.

Defined cases: a null text has no words and fails the base rules; a null stratum is a stratum; ratings
repeated for an id count once, the lowest of them; ratings without a document are ignored; an empty
table of ratings certifies nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.common import SPACES, body, documents, labels, squeezed, word_array
from civicspark.session import settled

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
ALPHA, DELTA = 0.06, 0.1
# Rule: numerator, denominator, cutoffs in thousandths from lenient to strict; a document falls beyond its cutoff.
RULES = (
    ("symbols", "n_symbols", "word_chars", (500, 300, 200, 100, 50, 30, 20)),
    ("dup_lines", "n_dup_lines", "n_lines", (600, 400, 300, 200, 100)),
    ("repeats", "n_repeat_words", "n_words", (190, 150, 100, 50, 20)),
    ("capitals", "n_upper", "word_chars", (800, 600, 400, 200, 100)),
)


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum and the counts of every rule, one row per row of ``docs``.

    Repeated windows are found inside the row: equal hashes of five words, and only where there are
    any, sorted with their places; a place adds the words that the window before it does not cover."""
    raw = body(text_col)
    d = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), raw.alias("t"))
    d = d.select("id", "stratum", "t", word_array(F.col("t")).alias("words"),
                 F.filter(F.split("t", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("lines"))
    solid = squeezed(F.col("t"))
    window = F.when(F.size("words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.select(
        "id", "stratum", F.size("words").cast("long").alias("n_words"), F.length(solid).cast("long").alias("word_chars"),
        _without(solid, SYMBOLS).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _without(solid, UPPER).cast("long").alias("n_upper"), window.alias("w"))
    placed = F.sort_array(F.transform("w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.withColumn("s", F.when(F.size(F.array_distinct("w")) < F.size("w"), placed).otherwise(none)).drop("w")
    twice = F.filter("s", lambda x, j: (F.get("s", j - 1)["h"] == x["h"]) | (F.get("s", j + 1)["h"] == x["h"]))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    d = d.withColumn("n_repeat_words", covered).drop("s")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def beyond(num: Column, den: Column, cutoff: Column) -> Column:
    """Whether num / den lies beyond the cutoff in thousandths."""
    return num * 1000 > den * cutoff


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n * p (else null: at least one half), from sums of logarithms."""
    step = math.log(p / (1 - p))
    first = n * math.log1p(-p)
    terms = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))),
        F.struct(first.alias("term"), first.alias("all")),
        lambda acc, i: F.when(i > k, acc).otherwise(_next_term(acc, acc["term"] + F.log((n - i + 1) / i) + step)),
        lambda acc: acc["all"])
    return F.when(k <= n * p, F.exp(terms))


def _next_term(acc: Column, term: Column) -> Column:
    top, low = F.greatest(acc["all"], term), F.least(acc["all"], term)
    return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("all"))


def certified_cutoffs(rated: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules=RULES) -> DataFrame:
    """``rated``: the features of the good documents that pass the base rules, with stratum. One row per
    stratum: the strictest certified cutoff of every rule, null where there is none."""
    counts = []
    for name, num, den, cutoffs in rules:
        for i, cut in enumerate(cutoffs):
            counts.append(F.count(F.when(beyond(F.col(num), F.col(den), F.lit(cut)), 1)).alias(f"{name}_{i}"))
    per = rated.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *counts)
    strata = F.count(F.lit(1)).over(Window.partitionBy())
    per = per.withColumn("level", F.lit(delta) / (strata * len(rules)))
    tests = [F.struct(F.lit(name).alias("rule"), F.lit(i).alias("i"), F.lit(cut).alias("cut"), F.col(f"{name}_{i}").alias("k"))
             for name, _, _, cutoffs in rules for i, cut in enumerate(cutoffs)]
    tried = per.select("stratum", "n", "level", F.inline(F.array(*tests)))
    passed = F.coalesce(binomial_tail(F.col("n"), F.col("k"), alpha / len(rules)) <= F.col("level"), F.lit(False))
    so_far = Window.partitionBy("stratum", "rule").orderBy("i")
    tried = tried.withColumn("ok", passed).withColumn("ok", F.min("ok").over(so_far))
    return tried.groupBy("stratum").agg(*[
        F.min(F.when(F.col("ok") & (F.col("rule") == name), F.col("cut"))).alias(f"cut_{name}") for name, *_ in rules])


def judge(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          good_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA, rules=RULES) -> DataFrame:
    """Features, base_failed and kept, one row per row of ``docs``."""
    counted = settled(features(docs, id_col, text_col, stratum_col), "rule-counts")
    good = ratings.groupBy(F.col(id_col).alias("r_id")).agg(F.min(good_col).alias("good")).where("good = 1").select("r_id")
    holdout = counted.where(~F.col("base_failed")).join(good, F.col("id") == F.col("r_id"), "left_semi")
    cuts = settled(certified_cutoffs(holdout, alpha, delta, rules).withColumnRenamed("stratum", "c_stratum"), "cutoffs")
    met = counted.join(cuts, F.col("stratum").eqNullSafe(F.col("c_stratum")), "left")
    fallen = F.col("base_failed")
    for name, num, den, _ in rules:
        fallen = fallen | F.coalesce(beyond(F.col(num), F.col(den), F.col(f"cut_{name}")), F.lit(False))
    return met.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", (~fallen).alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), labels(spark, sf_dir))


def _sql() -> str:
    alpha = repr(ALPHA / len(RULES))
    counts, tests, cuts, falls = [], [], [], []
    for name, num, den, cutoffs in RULES:
        for i, cut in enumerate(cutoffs):
            counts.append(f"count(*) FILTER ({num} * 1000 > {den} * {cut}) AS {name}_{i}")
            tests.append(f"{{'rule': '{name}', 'i': {i}, 'cut': {cut}, 'k': {name}_{i}}}")
        cuts.append(f"min(cut) FILTER (ok AND rule = '{name}') AS cut_{name}")
        falls.append(f"coalesce({num} * 1000 > {den} * cut_{name}, false)")
    tail = ("list_sum(list_transform(range(0, k + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1)"
            f" + x * ln({alpha}) + (n - x) * ln(1 - {alpha}))))")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g') AS solid FROM d),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
win2 AS (SELECT rid, unnest(list_transform(range(0, greatest(len(words) - 4, 0)),
         lambda i: {{'i': i, 'g': array_to_string(words[i + 1:i + 5], ' ')}}), recursive := true) FROM w),
twice AS (SELECT rid, g FROM win2 GROUP BY rid, g HAVING count(*) > 1),
places AS (SELECT win2.rid, win2.i FROM win2 JOIN twice USING (rid, g)),
spread AS (SELECT DISTINCT rid, i + unnest([0, 1, 2, 3, 4]) AS i FROM places),
rep AS (SELECT rid, count(*) AS n_repeat_words FROM spread GROUP BY rid),
f AS (
  SELECT doc_id, lang, len(words) AS n_words, length(solid) AS word_chars,
         length(solid) - length(regexp_replace(solid, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(solid) - length(regexp_replace(solid, '[A-Z]', '', 'g')) AS n_upper,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN l USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
per AS (SELECT lang, count(*) AS n, {', '.join(counts)} FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY lang),
lev AS (SELECT *, (SELECT count(*) FROM per) AS strata FROM per),
tried AS (SELECT lang, n, strata, unnest([{', '.join(tests)}], recursive := true) FROM lev),
tested AS (SELECT lang, rule, i, cut, k <= n * {alpha} AND {tail} <= {DELTA} / ({len(RULES)} * strata) AS ok FROM tried),
chain AS (SELECT lang, rule, cut, min(ok) OVER (PARTITION BY lang, rule ORDER BY i) AS ok FROM tested),
cuts AS (SELECT lang, {', '.join(cuts)} FROM chain GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {' OR '.join(falls)}) AS kept
FROM b LEFT JOIN cuts ON b.lang IS NOT DISTINCT FROM cuts.lang
"""


SQL = _sql()
