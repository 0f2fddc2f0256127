"""What the operators share: shared folders, lineage cuts, and word and byte hashes over Arrow text columns."""

from __future__ import annotations

import ctypes
import functools
import re
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canongraph.functions.shared import cut, shared_dir, stored  # noqa: F401 - operators take them from here

#: Odd multiplier of the polynomial hashes (mod 2**64); any odd number with mixed bits will do.
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are hashed at once; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 19
#: Bytes that travel between Spark and a Python worker at once, about.
BATCH_BYTES = 1 << 22


def bound_batches(spark: SparkSession) -> None:
    """Has rows go to Python workers in batches of BATCH_BYTES, if the session allows larger ones.

    Spark counts rows by default (and 64 MB): with texts of megabytes that is more than a worker should hold.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", (spark.conf.get(key, None) or "0").lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tidy(run):
    """``run``, a function over a task's batches, with what the task has freed given back to the system at its end.

    Python workers live on from task to task beside the executor's JVM, and keep what one task needed at its peak otherwise.
    """

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
            if trim is not None:
                trim(0)

    return whole


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, of: int):
    """crc32 of an id's decimal text, modulo ``of``: the fold of a row."""
    return F.crc32(F.col(column).cast("string")) % of


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string or binary column, and where each row starts and ends in them (nulls: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, most: int = BLOCK_BYTES):
    """Row ranges of about ``most`` bytes each; a row is never cut."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Powers:
    """Powers of an odd base and of its inverse, kept for the longest text so far."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 1024)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit hash spread evenly (a finaliser of the kind splitmix64 uses)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): the hash of data[i:j] is (sums[j] - sums[i]) * down[i]."""
    up, down = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums, down


#: Space, tab, line feed, vertical tab, form feed and carriage return part words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Everything in ASCII that is neither letter nor digit parts words, for readers that overlook punctuation.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def words_of(data: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE):
    """Of lower-cased (A-Z) words: their hash, row, start and end byte; ``at`` as from raw_bytes, from 0."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    data = _LOWER[data]
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at[:-1]] = edge[-1] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums, down = prefix_hash(data)
    row = np.searchsorted(at, start, "right") - 1
    return mix((sums[end] - sums[start]) * down[start]), row, start, end


def shingles_of(word: np.ndarray, row: np.ndarray, k: int):
    """Hash and row of each run of ``k`` words within a row; a row of fewer words counts as one run.

    The third result is the index of the run's first word.
    """
    if not len(word):
        return word, row, row
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    counts = np.diff(np.r_[starts, len(row)])
    place = np.arange(len(row)) - np.repeat(starts, counts)
    left = np.repeat(counts, counts) - place
    full = np.flatnonzero(left >= k)
    # a rolling polynomial over the words' hashes
    h = np.zeros(len(full), np.uint64)
    for i in range(k):
        h = h * np.uint64(BASE) + word[full + i]
    short = starts[counts < k]
    if len(short):
        hs = np.zeros(len(short), np.uint64)
        n = counts[counts < k]
        for i in range(k - 1):
            more = n > i
            hs[more] = hs[more] * np.uint64(BASE) + word[short[more] + i]
        hs = hs ^ (n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        h, at = np.r_[h, hs], np.r_[full, short]
        order = np.argsort(at, kind="stable")
        h, full = h[order], at[order]
    return mix(h), row[full], full


_LETTER: np.ndarray | None = None


def letter_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts with each run of other characters as one 0, and the row of each.

    Every row begins and ends with a 0, so n-grams over the result show where words begin and end.
    """
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    low = [f"\n{(x or '').lower()}\n" for x in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(low)), [len(x) for x in low])
    codes = np.where(_LETTER[codes], codes, 0)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (row[1:] != row[:-1])
    return codes[keep], row[keep]


#: Bytes that small() broadcasts at most, as a hashed table takes them in memory; what a row takes besides its values.
BROADCAST, ROW = 64 << 20, 40


def _bytes(value: Column, kind: T.DataType) -> Column | int:
    """What a value takes in a row."""
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), 16)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value.alias("v")))), F.lit(0)) + 32
    return 8


def small(df: DataFrame, most: int = 2_000_000, size: int = BROADCAST) -> DataFrame:
    """``df``, broadcast if it has at most ``most`` rows and takes at most ``size`` bytes, and left to a shuffle otherwise."""
    width = sum((_bytes(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields), F.lit(ROW))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= most and total <= size else df
