"""Delimited text: separator and encoding detection, everything read as text."""

from __future__ import annotations

import csv
from collections import Counter
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from civicspark.sources import splits

SEPARATORS = (";", ",", "\t", "|")  # fixed values, in order of preference


def sniff_separator(header: str, default: str = ",") -> str:
    """Separator that occurs most often in the header line."""
    best = max(SEPARATORS, key=header.count)
    return best if header.count(best) else default


def file_kinds(spark: SparkSession, path: str) -> list[tuple[str, str, str, bool]]:
    """(file, encoding, header line, open) of every file with lines: UTF-8 if each line is, else Latin-1; open if
    some line has an odd number of quotes, so a cell may go on in the next line.

    One aggregate over the lines, whose result is one row per file."""
    at = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")
    raw = F.col("value").cast("binary")
    odd = F.octet_length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    found = lines.groupBy("file").agg(F.every(F.is_valid_utf8("value")).alias("utf8"), F.min_by(raw, "at").alias("head"),
                                      F.some(odd).alias("open"))
    kinds = []
    for row in found.orderBy("file").collect():
        encoding = "UTF-8" if row["utf8"] else "ISO-8859-1"
        kinds.append((unquote(row["file"]), encoding, bytes(row["head"]).decode(encoding, "replace"), row["open"]))
    return kinds


def read_delimited(spark: SparkSession, path: str, separator: str | None = None, encoding: str | None = None,
                   multi_line: bool = True, order: str | None = None) -> DataFrame:
    """Delimited files with a header as trimmed text columns; empty cells are NULL, NUL characters vanish.

    Every file is UTF-8 (a leading mark is fine) or else Latin-1 and has its own separator; files that agree
    in both and in the header are read together, columns are matched by name. ``multi_line`` allows line
    breaks inside quotes: files that may have them are cut into records by :mod:`splits`, so a large file is
    read by many tasks either way. ``order`` names a column that rises along a file."""
    if separator is not None and encoding is not None and not multi_line:
        return _read(spark, path, separator, encoding, order)
    groups: dict[tuple[str, str, str, bool], list[str]] = {}
    for file, own, header, open_ in file_kinds(spark, path):
        groups.setdefault((separator or sniff_separator(header), encoding or own, header, multi_line and open_), []).append(file)
    if not groups:
        return _read(spark, path, separator or ",", encoding or "UTF-8", order)
    parts = [(_read_records if open_ else _read)(spark, files, sep, enc, order) for (sep, enc, _, open_), files in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read(spark: SparkSession, path: str | list[str], separator: str, encoding: str, order: str | None) -> DataFrame:
    """Files whose records are lines."""
    raw = (
        spark.read.option("header", True).option("inferSchema", False).option("sep", separator)
        .option("encoding", encoding).option("quote", '"').option("escape", '"')
        .option("mode", "PERMISSIVE").csv(path))
    names = [c.replace("\ufeff", "").strip().strip('"') for c in raw.columns]
    return _cells(raw.toDF(*names), names, F.monotonically_increasing_id(), order)


def _read_records(spark: SparkSession, path: str | list[str], separator: str, encoding: str, order: str | None) -> DataFrame:
    """Files whose records may span lines; the first record of a file is its header."""
    records = splits.csv_records(spark, path, separator)
    text = F.translate(F.decode("text", encoding), "\ufeff", "") if encoding == "UTF-8" else F.decode("text", encoding)
    records = records.select("file", "start", "seq", text.alias("text"))
    first = F.struct("start", "seq")
    heads = records.where("start = 0 and seq < 2").groupBy("file").agg(F.min(first).alias("h"), F.min_by("text", first).alias("t"))
    head = heads.orderBy("file").first()  # the files of a group agree in it
    names = [c.strip() for c in next(csv.reader([head["t"]], delimiter=separator, doublequote=True))]
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    rows = records.join(F.broadcast(heads.select(F.col("file").alias("h_file"), "h")), F.col("file") == F.col("h_file")).where(first != F.col("h"))
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = rows.select(F.from_csv("text", fields, options).alias("r"), (F.col("start") + F.col("seq")).alias("at"))
    return _cells(rows.select("r.*", "at").toDF(*_distinct(names), "_at"), _distinct(names), F.col("_at"), order)


def _distinct(names: list[str]) -> list[str]:
    """Repeated and empty names with their place, as the CSV source has it."""
    often = Counter(n.lower() for n in names)
    return [f"_c{i}" if not n else f"{n}{i}" if often[n.lower()] > 1 else n for i, n in enumerate(names)]


def _cells(rows: DataFrame, names: list[str], at: Column, order: str | None) -> DataFrame:
    cells = [F.trim(F.translate(F.col(f"`{c}`"), "\u0000", "")).alias(c) for c in names]
    return rows.select(*cells, *([at.alias(order)] if order else []))


def write_delimited(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", separator).option("quote", '"').option("escape", '"').csv(path)
