"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

1. Targets: a source's weight times a common rate, stopped at ``limit`` times its size; the rate is
   found in closed form from the sources in the order in which they reach their stop.
2. Blocks of ``block`` tokens are allotted to the sources by highest quotients
   target / (2k + 1), then, source by source, to its shards by their sizes in the same way. All
   quotients above a common divisor are counted at once; only the few seats between that count and the
   house size are ranked. A block is one token by default: a larger one takes no less work, and a source or shard
   below a block, or a stop that is no multiple of it, would lose words.
3. A shard's documents stand in seeded order and form an endless line of tokens, epoch after epoch. The
   quota of blocks is laid on that line from a seeded start, so a token is taken at most ``limit``
   times and every block has exactly ``block`` tokens.

A source has ceil(sqrt(documents) / 4) shards, so neither a shard nor the list of shards of a source
outgrows a task when one source holds most rows. Only the list of sources is ranked in one task.

Defined cases: null text has size 0 and is never taken; null source is a source, last in order; rows
that agree in id and text are laid out one after the other; an empty table gives an empty plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.llm.common import WORD, body, documents, word_count
from civicspark.session import settled


def capped_targets(sources: DataFrame, share: float, limit: float) -> DataFrame:
    """``sources``: source, weight, size. Adds target: share of all sizes by weight, at most limit times
    the size, the excess spread over the others by weight. Sources without size get 0."""
    everything = Window.partitionBy()
    line = Window.orderBy("turn", "weight", "source").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("size") * F.lit(limit)
    ranked = sources.withColumn("turn", cap / F.col("weight"))
    ranked = ranked.select(
        "*", (F.sum("size").over(everything) * share).alias("want"),
        F.coalesce(F.sum(cap).over(line), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(line), F.lit(0))).alias("open"))
    # The rate if all before this source are stopped. It holds for the first source that it does not stop;
    # behind that one it only falls.
    ranked = ranked.withColumn("rate", (F.col("want") - F.col("full")) / F.col("open"))
    ranked = ranked.withColumn("rate", F.max(F.when(F.col("turn") >= F.col("rate"), F.col("rate"))).over(everything))
    target = F.when(F.col("rate").isNull(), cap).otherwise(F.least(cap, F.col("rate") * F.col("weight")))
    return ranked.select("source", "weight", "size", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, most: str, tie: list[str]) -> DataFrame:
    """Adds ``quota``: the house of ``seats`` (same for all rows of a group) by highest quotients
    votes / (2k + 1), at most ``most`` for a party; equal quotients go by ``tie``.

    Quotients of at least V / (2 * seats) are taken without ranking, as many as a party has. The seats
    still open, or those given too much, are the best (worst) of the quotients next to that line. With n of them,
    the n-th best among the next quotients of the parties bounds what a party has to list."""
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    line = F.try_divide(F.sum(votes).over(w).cast("double"), F.col(seats).cast("double"))
    lots = parties.withColumn("_first", F.when(
        (F.col(seats) > 0) & (F.col(votes) > 0), F.least(F.floor(F.try_divide(F.col(votes), line) + 0.5), F.col(most))).otherwise(0).cast("long"))
    lots = lots.withColumn("_open", (F.col(seats) - F.sum("_first").over(w)).cast("long"))
    rising, falling = F.col("_open") > 0, F.col("_open") < 0
    can_rise = rising & (F.col(votes) > 0) & (F.col("_first") < F.col(most))
    lots = lots.withColumn("_next", F.when(can_rise, F.col(votes) / (2 * F.col("_first") + 1)).when(
        falling & (F.col("_first") > 0), F.col(votes) / (2 * F.col("_first") - 1)))
    place = F.row_number().over(w.orderBy(F.when(rising, -F.col("_next")).otherwise(F.col("_next")).asc_nulls_last(), *tie))
    lots = lots.withColumn("_place", place).withColumn("_edge", F.max(F.when(F.col("_place") == F.abs("_open"), F.col("_next"))).over(w))
    # seats with quotients on the losing side of the edge cannot be among the n; one more is listed against rounding
    reach = F.floor((F.try_divide(F.col(votes), F.col("_edge")) + 1) / 2)
    top = F.least(F.col("_first") + F.col("_open"), F.col(most).cast("long"), F.coalesce(reach + 1, F.col("_first") + F.col("_open")))
    low = F.greatest(F.col("_first") + F.col("_open") + 1, F.lit(1).cast("long"), F.coalesce(reach - 1, F.lit(1).cast("long")))
    up = F.when(can_rise & (top > F.col("_first")), F.sequence(F.col("_first") + 1, top))
    down = F.when(falling & (F.col("_first") > 0) & (low <= F.col("_first")), F.sequence(low, F.col("_first")))
    near = lots.select(*group, *tie, votes, "_open", F.explode(F.coalesce(up, down)).alias("_seat"))
    quotient = F.col(votes) / (2 * F.col("_seat") - 1)
    back = F.when(F.col("_open") > 0, F.lit(1)).otherwise(F.lit(-1))
    near = near.withColumn("_quotient", quotient)
    over = Window.partitionBy(*group) if group else Window.partitionBy()
    # seats are given from the best down and taken back from the worst up, among equal quotients too
    best = F.row_number().over(over.orderBy(F.desc("_quotient"), *tie, "_seat"))
    worst = F.row_number().over(over.orderBy("_quotient", *[F.desc(t) for t in tie], F.desc("_seat")))
    won = near.withColumn("_rank", F.when(F.col("_open") > 0, best).otherwise(worst))
    won = won.where(F.col("_rank") <= F.abs("_open")).groupBy(*{*group, *tie}).agg(F.sum(back).alias("_more"))
    keys = [*dict.fromkeys([*group, *tie])]
    won = won.select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)], "_more")
    same = [F.col(k).eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(keys)]
    joined = lots.join(won, [*same][0] if len(same) == 1 else _all(same), "left")
    return joined.select(*parties.columns, (F.col("_first") + F.coalesce("_more", F.lit(0))).cast("long").alias("quota"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _cycle_weight(weights: tuple[int, ...], place: Column) -> Column:
    at = F.pmod(place - 1, F.lit(len(weights)))
    out = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        out = F.when(at == i, F.lit(w)).otherwise(out)
    return out


def mixing_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: int = 2, block: int = 1, seed: int = 17,
) -> DataFrame:
    """One row per row of ``docs``: id, raw (hash of the text), source, size, source_size, target, taken,
    and what is taken: ``whole`` full copies plus the words [part_from, part_to) once more
    (``part_to`` may pass the end: the part then wraps to the start)."""
    raw = body(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(raw).alias("raw"), word_count(raw).alias("size"))
    rows = settled(rows, "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per_source = settled(per_source.withColumn("weight", _cycle_weight(weights, place)), "sources")
    targets = capped_targets(per_source.select("source", "weight", "size"), share, limit)
    house = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    targets = targets.select("source", "weight", F.col("size").alias("source_size"), "target", house.alias("house"),
                             F.floor(F.col("size") * limit / block).cast("long").alias("most"))
    quotas = apportion(targets, [], "target", "house", "most", ["source"]).select(
        F.col("source").alias("q_source"), "source_size", "target", F.col("quota").alias("source_quota"))
    shards = per_source.select(F.col("source").alias("s_source"), F.greatest(
        F.lit(1), F.ceil(F.sqrt("docs") / 4)).cast("long").alias("shards"))
    placed = rows.join(shards, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    order = F.xxhash64(F.lit(seed), F.col("id"), F.col("raw"))
    placed = placed.withColumn("rank", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "rank"), F.col("shards")))
    cells = placed.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    cells = cells.join(quotas, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    cells = cells.withColumn("cell_most", F.floor(F.col("cell_size") * limit / block).cast("long"))
    cells = apportion(cells, ["source"], "cell_size", "source_quota", "cell_most", ["shard"])
    cells = settled(cells.select(
        F.col("source").alias("c_source"), F.col("shard").alias("c_shard"), "cell_size", "source_size", "target",
        (F.col("quota") * block).alias("tokens"),
        F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest(F.col("cell_size"), F.lit(1))).alias("begin")), "quotas")
    line = Window.partitionBy("source", "shard").orderBy("rank", "id", "raw").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("at", F.coalesce(F.sum("size").over(line), F.lit(0)))
    laid = laid.join(cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("shard") == F.col("c_shard")))
    # Positions relative to the start of the laid blocks: the document is [off, off + size) in a ring of cell_size.
    ring = F.greatest(F.col("cell_size"), F.lit(1))
    off = F.pmod(F.col("at") - F.col("begin"), ring)
    rest = F.pmod(F.col("tokens"), ring)
    head = F.greatest(F.lit(0), F.least(rest, off + F.col("size")) - off)  # before the ring closes
    tail = F.greatest(F.lit(0), F.least(rest, off + F.col("size") - ring))  # words that lie behind its end
    whole = F.floor(F.col("tokens") / ring)
    laid = laid.select("*", head.alias("head"), tail.alias("tail"), whole.alias("rounds"), (ring - off).alias("seam"))
    # head covers words [0, head); tail covers words [seam, seam + tail).
    part = F.col("head") + F.col("tail")
    full = (part == F.col("size")) & (F.col("size") > 0)
    joined = (F.col("tail") > 0) & ~full
    return laid.select(
        "id", "raw", "source", "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("rounds") + full.cast("int")).otherwise(0).cast("int").alias("whole"),
        F.when(~full, F.col("head")).otherwise(0).cast("long").alias("head"),
        F.when(joined, F.col("seam")).otherwise(0).cast("long").alias("tail_from"),
        F.when(joined, F.col("tail")).otherwise(0).cast("long").alias("tail"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **how) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document comes as often as it is taken whole, and once
    more with the taken words where blocks cut it. Texts move once."""
    plan = mixing_plan(docs, id_col=id_col, text_col=text_col, **how).where("taken > 0")
    cut = F.struct("head", "tail_from", "tail")
    plan = plan.groupBy("id", "raw").agg(  # rows that agree in id and text share one text; blocks cut few of them
        F.sum("whole").alias("whole"), F.collect_list(F.when(F.col("head") + F.col("tail") > 0, cut)).alias("cuts"),
        F.count(F.lit(1)).alias("twins"))
    packed = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("d_id"), F.xxhash64(body(text_col)).alias("d_raw"))
    met = packed.join(plan.hint("shuffle_hash"), F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_raw") == F.col("raw")))
    once = met.where("twins = 1").unionByName(met.where("twins > 1").dropDuplicates(["d_id", "d_raw"]))
    copies = once.where("whole > 0").select(
        "doc", F.explode(F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int"))).alias("a"), F.lit(0).cast("long").alias("n"))
    parts = once.where(F.size("cuts") > 0).select("doc", F.explode("cuts").alias("c"))
    parts = parts.select("doc", F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("a"), F.col("c.head").alias("n")),
        F.struct(F.col("c.tail_from").alias("a"), F.col("c.tail").alias("n")))).alias("p")).where("p.n > 0")
    pieces = copies.unionByName(parts.select("doc", "p.a", "p.n"))
    text = F.col("doc").getField(text_col)
    tokens = F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0))
    taken = F.when(F.col("a") < 0, text).otherwise(
        F.array_join(F.slice(tokens, (F.col("a") + 1).cast("int"), F.col("n").cast("int")), ""))
    pieces = pieces.withColumn("piece", taken)
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col("piece").alias(c))
        elif c == length_col:
            columns.append(F.length("piece").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("doc").getField(c).alias(c))
    return pieces.select(*columns)


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    plan = mixing_plan(documents(spark, sf_dir))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
