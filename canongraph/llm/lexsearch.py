"""Ranked lexical search: document shards of CSR postings with precomputed integer impacts, scored term at a time.

A term is a run of characters other than ASCII punctuation, space and control characters, with A-Z lower-cased. With N the
documents that hold a term, L all their terms, n one document's terms, df the documents of a term and tf its occurrences in a
document, a posting's impact is ``1000000000 * tf div (1000 * tf + 12 * m)``, m = ``75 + 25 * n * N div L``; a term weighs
``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` and a document scores the sum of weight times impact over an item's terms,
repeats included. All is 64-bit integer arithmetic but for the weights, which are doubles.

Plan: one pass counts terms (N and L, two numbers). A second builds the index, a table of shards: each task puts the documents
it reads into shards of bounded size, sorted by term (CSR), with the impacts of all postings. Nothing is shuffled. Items are
searched in slices of bounded size: a first pass over the shards' dictionaries alone sums the df of the slice's terms, a second
adds weighted postings into one dense accumulator per shard and item and keeps the k best of each task; those meet by item.

Null, empty and wordless texts hold no term: they match nothing and count nowhere. Rows that repeat an id are documents of their
own. Among equal scores the smaller doc_id comes first, null ids last. Items without terms, or whose terms occur nowhere, give
no rows; rows that repeat an item_id (or have none) are items of their own. Empty tables give no rows, further columns are
ignored. Terms are told apart by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canongraph.llm.common import PUNCTUATION, blocks, bound_batches, cut, raw_bytes, stored, tidy, words_of

#: Postings of a shard, about; a document is never cut.
SHARD = 1_000_000
#: Terms of the items that are searched at once, about, and items at most.
SLICE_TERMS, SLICE_ITEMS = 200_000, 4096


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """N and L of a table of documents."""

    def run(batches):
        n = most = 0
        for batch in batches:
            data, at = raw_bytes(batch.column(0))
            inside = ~PUNCTUATION[data]
            starts = inside.copy()
            edge = np.zeros(len(data) + 1, bool)
            edge[at] = True
            starts[1:] &= ~inside[:-1] | edge[1:-1]
            before = np.r_[0, np.cumsum(starts)][at]
            n, most = n + int((np.diff(before) > 0).sum()), most + int(before[-1])
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([most])], names=["n", "l"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return got[0] or 0, got[1] or 0


def impacts(tf: np.ndarray, terms: np.ndarray, n: int, most: int) -> np.ndarray:
    """Impacts of postings: their tf, and the number of terms of each one's document."""
    sizes, at = np.unique(terms, return_inverse=True)
    m = np.array([75 + 25 * int(x) * n // most for x in sizes], np.int64)[at]
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


SCHEMA = "n int, ids binary, late binary, terms binary, ends binary, docs binary, impacts binary"


def _shard(held) -> pa.RecordBatch:
    """One row: documents, and postings in the order of their terms."""
    ids, late, term, doc, impact = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(term, kind="stable")
    term = term[order]
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    values = [[len(ids)], [ids.tobytes()], [late.tobytes()], [term[first].tobytes()], [np.r_[first[1:], len(term)].astype(np.int64).tobytes()], [doc[order].astype(np.int32).tobytes()], [impact[order].astype(np.int32).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(values)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> tuple[DataFrame, int, int]:
    """The index of a table of documents, written to the shared folder: its shards, and N and L."""
    spark = docs.sparkSession
    bound_batches(spark)
    n, most = totals(docs, text_col)

    def run(batches):
        held, size, count = [], 0, 0
        for batch in batches:
            ids, (data, at) = batch.column(0), raw_bytes(batch.column(1))
            for a, b in blocks(at):
                term, row, _, _ = words_of(data[at[a] : at[b]], at[a : b + 1] - at[a], PUNCTUATION)
                if not len(term):
                    continue
                order = np.lexsort((term, row))
                term, row = term[order], row[order]
                first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])])
                tf = np.diff(np.r_[first, len(term)])
                used, doc = np.unique(row[first], return_inverse=True)
                sizes = np.bincount(row, minlength=b - a)
                own = ids.take(pa.array(used + a))
                held.append((own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), own.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), term[first], doc + count, impacts(tf, sizes[row[first]], n, most)))
                size, count = size + len(first), count + len(used)
                if size >= shard:
                    yield _shard(held)
                    held, size, count = [], 0, 0
        if held:
            yield _shard(held)

    made = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), SCHEMA)
    return stored(made, "lexical-index"), n, most


def tops(score: np.ndarray, ids: np.ndarray, late: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores above 0; those equal to the last one taken by id."""
    found = np.flatnonzero(score > 0)
    if len(found) > k:
        least = score[found[np.argpartition(-score[found], k - 1)[k - 1]]]
        found = found[score[found] >= least]  # the k best and all that tie with the last of them
    return found[np.lexsort((ids[found], late[found], -score[found]))[:k]]


def _slices(items: DataFrame):
    """Items as lists of (row, item, terms with their number) of bounded size, in the order of their rows."""
    held, size = [], 0
    for x in items.select("row", "item", "text").orderBy("row").toLocalIterator():
        data, at = raw_bytes(pa.array([x.text], pa.string()))
        term, many = np.unique(words_of(data, at, PUNCTUATION)[0], return_counts=True)
        if len(term):
            held.append((x.row, x.item, term, many))
            size += len(term)
        if size >= SLICE_TERMS or len(held) >= SLICE_ITEMS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _frequencies(shards: DataFrame, terms: np.ndarray) -> np.ndarray:
    """df of the given sorted terms over all shards; only their dictionaries are read."""

    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own, ends = np.frombuffer(own, np.uint64), np.frombuffer(ends, np.int64)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                total += np.where(own[at] == terms, np.diff(np.r_[0, ends])[at], 0)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["at", "df"])

    out = np.zeros(len(terms), np.int64)
    for at, df in shards.select("terms", "ends").mapInArrow(tidy(run), "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect():
        out[at] = df
    return out


def _search(shards: DataFrame, n: int, part: list, k: int) -> DataFrame:
    """(row, doc_id, score): the k best documents that each task finds for the items of a slice."""
    terms = np.unique(np.concatenate([x[2] for x in part]))
    df = _frequencies(shards, terms)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) if x else 0 for x in df], np.int64)
    wanted = [(row, np.searchsorted(terms, own), many) for row, _, own, many in part]

    def run(batches):
        kept: dict[int, tuple] = {}
        for batch in batches:
            for x in batch.to_pylist():
                own, ends = np.frombuffer(x["terms"], np.uint64), np.frombuffer(x["ends"], np.int64)
                docs, impact = np.frombuffer(x["docs"], np.int32), np.frombuffer(x["impacts"], np.int32).astype(np.int64)
                ids, late = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["late"], np.uint8)
                at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                there = own[at] == terms
                for i, (_, mine, many) in enumerate(wanted):
                    score = np.zeros(len(ids), np.int64)
                    for t, often in zip(mine, many):
                        if there[t] and weight[t]:
                            a, b = (ends[at[t] - 1] if at[t] else 0), ends[at[t]]
                            score[docs[a:b]] += weight[t] * often * impact[a:b]  # a document once in a term's postings
                    best = tops(score, ids, late, k)
                    if not len(best):
                        continue
                    got = (score[best], ids[best], late[best])
                    if i in kept:
                        got = tuple(np.concatenate(y) for y in zip(kept[i], got))
                        best = tops(*got, k)
                        got = tuple(y[best] for y in got)
                    kept[i] = got
        rows = np.array([wanted[i][0] for i, x in kept.items() for _ in x[0]], np.int64)
        score, ids, late = (np.concatenate([x[j] for x in kept.values()]) if kept else np.zeros(0, np.int64) for j in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids, mask=late.astype(bool)), pa.array(score)], names=["row", "doc_id", "score"])

    return shards.mapInArrow(tidy(run), "row long, doc_id long, score long")


def search(index: tuple[DataFrame, int, int], items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, best first."""
    shards, n, _ = index
    spark: SparkSession = items.sparkSession
    # rows of the items are numbered once, so a slice names them whatever their ids
    own = cut(items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")))
    parts = [stored(_search(shards, n, part, k), "lexical-found") for part in _slices(own)]
    found = spark.createDataFrame([], "row long, doc_id long, score long")
    for x in parts:
        found = x if x is parts[0] else found.unionByName(x)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(own.select("row", "item"), "row").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
