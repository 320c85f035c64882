"""Helpers shared by the corpus operators: column expressions, text buffers, scratch tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of all word rules, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def body(text: str | Column) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without any white space."""
    return F.translate(text, SPACES, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_array(text: Column) -> Column:
    core = F.btrim(text, F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_RUN))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")


def labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/labels.parquet")


# --- numpy views of Arrow text columns -----------------------------------------------------------

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODES = _RNG.integers(1, 2**64, 256, dtype=U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with offsets; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int, most: int | None = None):
    """Runs of rows of at most ``limit`` bytes together; a longer text makes a run of its own. ``most``
    bounds the rows of a run, for work that takes memory by the row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), rows, start + (most or rows))
        yield start, end
        start = end


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
# ASCII letters and digits and every byte of a longer code point
_IS_ALNUM = np.zeros(256, bool)
_IS_ALNUM[48:58] = _IS_ALNUM[65:91] = _IS_ALNUM[97:123] = _IS_ALNUM[128:] = True


def hashed_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash (A-Z lower-cased) and row number of every word, in order. A word is a longest run of
    bytes for which ``inside`` holds, by default all but white space; rows never share a word."""
    member = ~_IS_SPACE[data] if inside is None else inside[data]
    if not member.any():
        return np.zeros(0, U64), np.zeros(0, np.int64)
    first = member.copy()
    first[1:] &= ~member[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = member[cuts]
    place = np.flatnonzero(member)
    begins = first[place]
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(place)))
    nth = np.arange(len(place)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(int(lengths.max()) - 1, _BASE, U64))))
    codes = _BYTE_CODES[_LOWER[data[place]]] * powers[nth]
    hashes = mixed(np.add.reduceat(codes, starts) + lengths.astype(U64) * _BYTE_CODES[0])
    return hashes, np.searchsorted(offsets, place[starts], "right") - 1
