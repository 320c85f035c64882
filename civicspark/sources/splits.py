"""Records of large files cut by many tasks: quoted CSV with line breaks, JSON lists and collections.

A file is read in splits. Where a split begins, a task cannot see whether it stands inside quotes, or how
deep inside brackets. So a first scan reduces every split to what it does to that state, a running
composition over the splits of a file tells the state at each start, and a second scan cuts
records with it. A record that a split leaves open is glued from its pieces afterwards.

What is broadcast is one row per split. A record has to fit into memory, a file or a split does not. The
state of a split is carried through its rows in the order of the file, so nothing is shuffled but open pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicspark.session import settled

_PIECE = "file long, start long, seq long, kind string, key string, text binary"
STEP = 1 << 20  # bytes looked at together


def _split_rows(spark: SparkSession, path: str | list[str], line_end: str | None = None) -> DataFrame:
    """Rows of text files in the order of their splits, with file and start of the split."""
    reader = spark.read.option("lineSep", line_end) if line_end else spark.read
    return reader.text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                    F.col("value").cast("binary").alias("value"))


def _runs(batch: pa.RecordBatch):
    """Slices of a batch that lie in one split."""
    file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
    cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        if hi > lo:
            yield (int(file[lo]), int(start[lo])), batch.slice(lo, hi - lo)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "start", "seq", "kind", "key", "text"])


def _glued(cut: DataFrame, between: bytes) -> DataFrame:
    """Complete records (file, start, seq, key, text): those cut whole, and those put together from an opening piece
    and what follows it up to the closing one."""
    order = Window.partitionBy("file").orderBy("start", "seq")
    parts = cut.where("kind in ('tail', 'middle', 'head')")
    owner = F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(order)
    parts = parts.withColumn("owner", owner).where("owner > 0").groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("start", "seq", "text"))).alias("p"), F.min_by("key", F.struct("start", "seq")).alias("key"))
    text = F.aggregate("p", F.lit(None).cast("binary"), lambda done, x: F.when(done.isNull(), x["text"]).otherwise(F.concat(done, F.lit(between), x["text"])))
    whole = parts.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["seq"].alias("seq"), "key", text.alias("text"))
    return cut.where("kind = 'record'").select("file", "start", "seq", "key", "text").unionByName(whole)


# --- quoted CSV ------------------------------------------------------------------------------------------------------

def ends_inside(line: bytes, separator: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open behind the line. A quote opens a cell only at its beginning, two stand for one."""
    at = 0
    while True:
        if inside or line[at:at + 1] == b'"':
            at += not inside
            while True:
                at = line.find(b'"', at)
                if at < 0:
                    return True
                if line[at + 1:at + 2] != b'"':
                    break
                at += 2
            inside = False
        at = line.find(separator, at)
        if at < 0:
            return False
        at += len(separator)


def _quoted(values: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.greater(pc.count_substring(values, '"'), 0).to_numpy(zero_copy_only=False))


def _line_effects(separator: bytes):
    """Per split: the state behind it if it starts outside (o) and inside (i) of quotes."""

    def rows(batches):
        key, o, i = None, False, True
        for batch in batches:
            out = []
            for split, run in _runs(batch):
                if split != key:
                    if key is not None:
                        out.append((*key, o, i))
                    key, o, i = split, False, True
                values = run.column("value")
                for at in _quoted(values):
                    line = values[at].as_py()
                    o, i = ends_inside(line, separator, o), ends_inside(line, separator, i)
            if out:
                yield _effects(out)
        if key is not None:
            yield _effects([(*key, o, i)])

    return rows


def _effects(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "start", "o", "i"])


def _cut_lines(separator: bytes):
    """Records of each split, given whether it starts inside quotes."""

    def rows(batches):
        key, inside, held, kind, seq = None, False, [], "tail", 0
        for batch in batches:
            out = []
            for split, run in _runs(batch):
                if split != key:
                    if held:
                        out.append((*key, seq, "middle" if kind == "head" else kind, None, b"\n".join(held)))
                    key, inside, held, seq = split, bool(run.column("inside")[0].as_py()), [], 0
                    kind = "head" if inside else "tail"
                values = run.column("value")
                quoted = _quoted(values)
                after = np.zeros(len(values), bool)  # the state behind each line
                last = 0
                for at in quoted:
                    after[last:at] = inside
                    inside = ends_inside(values[at].as_py(), separator, inside)
                    last = at
                after[last:] = inside
                closed = np.flatnonzero(~after)
                if not len(closed):
                    held += values.to_pylist()
                    continue
                first = 0
                if held:  # its first record began before this batch
                    text = b"\n".join([*held, *values.slice(0, closed[0] + 1).to_pylist()])
                    out.append((*key, seq, "head" if kind == "head" else "record", None, text))
                    first, seq, held, kind = closed[0] + 1, seq + 1, [], "tail"
                    closed = closed[1:]
                elif kind == "head":
                    out.append((*key, seq, "head", None, b"\n".join(values.slice(0, closed[0] + 1).to_pylist())))
                    first, seq, kind = closed[0] + 1, seq + 1, "tail"
                    closed = closed[1:]
                if len(closed):
                    ends = np.concatenate([[first], closed + 1]).astype(np.int32)
                    texts = pc.binary_join(pa.ListArray.from_arrays(ends, values), b"\n")
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, key[0])), pa.array(np.full(n, key[1])), pa.array(np.arange(seq, seq + n)),
                         pa.array(["record"] * n), pa.nulls(n, pa.string()), texts.cast(pa.binary())], names=["file", "start", "seq", "kind", "key", "text"])
                    seq, first = seq + n, int(closed[-1]) + 1
                held = values.slice(first).to_pylist()
            if out:
                yield _pieces(out)
        if held:
            yield _pieces([(*key, seq, "middle" if kind == "head" else kind, None, b"\n".join(held))])

    return rows


def csv_records(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """file, start, seq, text of every record, the header included. Line breaks inside quotes become line feeds, a
    quote that is never closed takes the rest of its file, empty lines are no records."""
    lines = _split_rows(spark, path)
    sep = separator.encode()
    effects = lines.mapInArrow(_line_effects(sep), "file long, start long, o boolean, i boolean")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # flips since the last split that leaves one state whatever comes in, on top of that state
    flips = F.sum(F.when(F.col("o") & ~F.col("i"), 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start"))
    fixed = F.col("o") == F.col("i")
    marked = settled(effects, "csv-splits").withColumn("flips", flips).withColumn("base", F.when(fixed, F.struct("o", "flips")))
    state = marked.withColumn("base", F.last("base", ignorenulls=True).over(before)).withColumn("f", F.max("flips").over(before))
    odd = (F.coalesce("f", F.lit(0)) - F.coalesce("base.flips", F.lit(0))) % 2 == 1
    inside = state.select(F.col("file").alias("s_file"), F.col("start").alias("s_start"), (F.coalesce("base.o", F.lit(False)) != odd).alias("inside"))
    inside = settled(inside.where("inside"), "csv-open-splits")  # one row per split at most
    told = lines.join(F.broadcast(inside), (F.col("file") == F.col("s_file")) & (F.col("start") == F.col("s_start")), "left").select(
        "file", "start", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    cut = settled(told.mapInArrow(_cut_lines(sep), _PIECE), "csv-records")
    return _glued(cut, b"\n").drop("key").where(F.octet_length("text") > 0)


# --- JSON lists and collections -------------------------------------------------------------------------------------------

_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.S)
_BEHIND = 4096  # bytes kept for a key that stands before a cut


def _outline(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte lies inside a string (its quotes do not matter), and the change of depth at it outside."""
    place = np.arange(len(data), dtype=np.int64)
    slash = data == 92
    quote = data == 34
    if slash.any():
        last = np.maximum.accumulate(np.where(slash, -1, place))  # the byte before a run of backslashes
        runs = np.zeros(len(data), np.int64)
        runs[1:] = (place - 1 - np.concatenate([[-1], last[:-1]]))[1:]
        quote &= runs % 2 == 0
    within = (np.cumsum(quote) + inside) % 2 == 1
    step = ((data == 123) | (data == 91)).astype(np.int32) - ((data == 125) | (data == 93))
    return within, step


def _buffers(run: pa.RecordBatch):
    """The bytes of a run of pieces, each with the bracket it was cut at, some pieces at a time."""
    values = run.column("value").to_pylist()
    held, size = [], 0
    for v in values:
        held.append(v)
        size += len(v) + 1
        if size >= STEP:
            yield b"}".join([*held, b""])
            held, size = [], 0
    if held:
        yield b"}".join([*held, b""])


def _json_effects(batches):
    """Per split: quotes (odd or even), change of depth if it starts outside and inside of a string, first byte."""
    key, total = None, None
    for batch in batches:
        out = []
        for split, run in _runs(batch):
            if split != key:
                if key is not None:
                    out.append((*key, *total))
                key, total = split, [0, 0, 0, ""]
            for text in _buffers(run):
                if not total[3]:
                    total[3] = text.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1")
                data = np.frombuffer(text, np.uint8)
                within, step = _outline(data, bool(total[0]))
                total[1] += int(step[~within].sum())
                total[2] += int(step[within].sum())
                total[0] = int(within[-1])
        if out:
            yield _json_summary(out)
    if key is not None:
        yield _json_summary([(*key, *total)])


def _json_summary(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=["file", "start", "odd", "d0", "d1", "first"])


class _Cutter:
    """Objects that begin at one level of depth, and the keys of the containers above them, in one split."""

    def __init__(self, split: tuple[int, int], inside: bool, depth: int, level: int):
        self.split, self.inside, self.depth, self.level = split, inside, depth, level
        self.open = depth > level  # in the midst of a record
        self.kind, self.parts, self.key = "head", [], None if level == 2 else ""
        self.seq, self.before = 0, b""

    def row(self, kind: str, key: str | None, text: bytes) -> tuple:
        self.seq += 1
        return (*self.split, self.seq - 1, kind, key, text.replace(b"\r", b" ").replace(b"\n", b" "))

    def feed(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        within, step = _outline(data, self.inside)
        step[within] = 0
        behind = np.cumsum(step) + self.depth
        opens, closes = step > 0, step < 0
        marks = []
        if self.level == 2:
            for at in np.flatnonzero(opens & (behind == 2)):
                found = _KEY.search((self.before + text[max(0, at - _BEHIND):at])[-_BEHIND:] if at < _BEHIND else text[at - _BEHIND:at])
                name = found.group(1).decode("utf-8", "replace") if found else ""
                marks.append((int(at), name if data[at] == 91 else "{" + name))
        begins = np.flatnonzero(opens & (data == 123) & (behind == self.level + 1)).tolist()
        ends = np.flatnonzero(closes & (data == 125) & (behind == self.level)).tolist()
        self.inside, self.depth = bool(within[-1]), int(behind[-1])
        at_mark = 0
        if self.open:
            if not ends:
                self.parts.append(text)
                begins, ends = [], []
            else:
                self.parts.append(text[:ends[0] + 1])
                yield self.row("head" if self.kind == "head" else "record", self.key, b"".join(self.parts))
                self.open, self.parts, ends = False, [], ends[1:]
        for n, a in enumerate(begins):
            while at_mark < len(marks) and marks[at_mark][0] < a:
                self.key = marks[at_mark][1]
                yield self.row("key", self.key, text[marks[at_mark][0]:marks[at_mark][0] + 1024].split(b"}")[0])
                at_mark += 1
            if n < len(ends):
                yield self.row("record", self.key, text[a:ends[n] + 1])
            else:
                self.open, self.kind, self.parts = True, "tail", [text[a:]]
        for at, name in marks[at_mark:]:
            self.key = name
            yield self.row("key", name, text[at:at + 1024].split(b"}")[0])
        self.before = text[-_BEHIND:]

    def end(self):
        if self.open and self.parts:
            yield self.row("middle" if self.kind == "head" else "tail", self.key, b"".join(self.parts))


def _cut_json(batches):
    cutter = None
    for batch in batches:
        out = []
        for split, run in _runs(batch):
            if cutter is None or split != cutter.split:
                if cutter is not None:
                    out += cutter.end()
                first = run.slice(0, 1).to_pylist()[0]
                cutter = _Cutter(split, bool(first["inside"]), first["depth"], first["level"])
            for text in _buffers(run):
                out += cutter.feed(text)
        if out:
            yield _pieces(out)
    if cutter is not None:
        yield _pieces(list(cutter.end()))


def json_records(spark: SparkSession, path: str | list[str], keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(records, members). ``records``: file, start, seq, key, text of the objects of a list, or of the list named by one of
    ``keys`` in an object; objects without such a list are records themselves, with key ''. ``members``: file, name
    and the beginning of the value of every list or object that is a member of a whole document; the name of an object
    starts with a brace. Lists are expected to hold objects; other elements are left out."""
    pieces = _split_rows(spark, path, "}")
    effects = settled(pieces.mapInArrow(_json_effects, "file long, start long, odd int, d0 long, d1 long, first string"), "json-splits")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    state = effects.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).withColumn(
        "depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))).over(before), F.lit(0))).withColumn(
        "first", F.first("first").over(order))
    states = settled(state.select(F.col("file").alias("s_file"), F.col("start").alias("s_start"), "inside", "depth", "first"), "json-states")

    def cut(level: Column, some: DataFrame) -> DataFrame:
        met = pieces.join(F.broadcast(some), (F.col("file") == F.col("s_file")) & (F.col("start") == F.col("s_start")))
        return settled(met.select("file", "start", "value", "inside", F.col("depth").cast("int").alias("depth"), level.cast("int").alias("level"))
                       .mapInArrow(_cut_json, _PIECE), "json-records")

    found = cut(F.when(F.col("first") == "[", 1).otherwise(2), states)
    members = found.where("kind = 'key'")
    # a split may begin behind the key of its list
    last = members.groupBy("file", "start").agg(F.max_by("key", "seq").alias("last"))
    last = states.select(F.col("s_file").alias("file"), F.col("s_start").alias("start")).join(last, ["file", "start"], "left").withColumn(
        "so_far", F.last("last", ignorenulls=True).over(before))
    last = settled(last.where("so_far is not null").select(F.col("file").alias("l_file"), F.col("start").alias("l_start"), "so_far"), "json-keys")
    keyed = found.join(F.broadcast(last), (F.col("file") == F.col("l_file")) & (F.col("start") == F.col("l_start")), "left")
    keyed = keyed.select("file", "start", "seq", "kind", F.coalesce("key", "so_far").alias("key"), "text")
    records = _glued(keyed, b"").where(F.col("key").isin("", *keys))
    listed = members.where(F.col("key").isin(*keys)).select(F.col("file").alias("m_file")).distinct()
    plain = settled(states.where("first = '{'").join(listed, F.col("s_file") == F.col("m_file"), "left_anti"), "json-plain")
    if not plain.isEmpty():
        records = records.unionByName(_glued(cut(F.lit(0), plain), b"").withColumn("key", F.lit("")))
    return records.withColumn("text", F.col("text").cast("string")), members.select("file", F.col("key").alias("name"), F.col("text").cast("string").alias("value"))
