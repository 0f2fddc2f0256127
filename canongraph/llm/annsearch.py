"""Approximate nearest neighbours by largest inner product: randomly rotated one-bit codes, error bounds, exact reranking.

A vector is coded by the signs of its randomly rotated residual against the centre of its cell, ``bits`` of them (packed), and
two correction scalars: the residual's length and its inner product with its own code. From these the inner product with a
query follows with an error whose spread is known; ``width`` times that spread is added before a vector is left out. Vectors
that may still be among a query's k nearest are scored in double precision on the original components, summed in their order.

Plan: rows are coded in one pass and dealt into blocks of a cell. Query blocks first meet the first blocks of the cells
nearest to them, which gives each query a score that its k-th neighbour reaches. Then tiles of a query block and a data block
are listed on Spark, without those whose cells lie too far away for all of the block's queries (a strict bound), and scanned
by code. A tile returns at most k rows a query. Where vectors do not cluster, all tiles are scanned: the work is that of the
queries against all codes, in tasks of bounded size. Every row is coded and scanned; only the cells' centres come from a
sample, ``SAMPLE`` rows at most, taken by a hash of the row.

Vectors that are null, empty, zero or hold null or non-finite components take no part. Vectors meet those of their own length
only. Rows that repeat an id are separate vectors, so such a row may find its twin; a null id never makes a query of
``queries``, and comes after all ids among equal scores. Scores that overflow double precision count as infinite. An empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canongraph.llm.common import bound_batches, cut, shuffle_partitions, small, stored, tidy

#: Rows from which the centres of cells are found, at most.
SAMPLE = 4096
#: Cells for each length of vectors.
CELLS = 32
#: Lengths of vectors that get cells of their own; rarer ones have one cell each.
LENGTHS = 8
#: Vectors of a data block, and of a query block.
BLOCK, QUERIES = 2048, 256
#: Bits of a code at least; longer vectors get as many as they have components.
LEAST_BITS = 512
#: Spreads of the estimate's error that are allowed for.
WIDTH = 3.0
#: Cells whose first blocks give a query its first score to beat.
PROBES = 4
#: Candidates that are scored at once.
GATHER = 1 << 18
#: Blocks that the first of the rounds scans, about; each further one scans three times as many as all before it.
ROUND = 8


def code_bits(length: int) -> int:
    return max(LEAST_BITS, -(-length // 64) * 64)


@lru_cache(maxsize=4)
def rotation(length: int) -> np.ndarray:
    """(bits, length) with orthonormal columns: the same random rotation in every task."""
    drawn = np.random.default_rng(20 + length).standard_normal((code_bits(length), length))
    return np.linalg.qr(drawn)[0]


def centres(sample: np.ndarray, cells: int = CELLS, rounds: int = 8) -> np.ndarray:
    """Centres of the cells of a sample by rounds of k-means, from rows drawn at random."""
    x = sample.astype(np.float64)
    c = np.unique(x[np.random.default_rng(12).permutation(len(x))[:cells]], axis=0)
    for _ in range(rounds):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        for i in np.unique(near):
            c[i] = x[near == i].mean(0)
    return c


def encode(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes of the residuals x - c, the residuals' lengths, and the cosine of each with its own code."""
    with np.errstate(all="ignore"):
        r = x - c
        norm = np.sqrt((r * r).sum(1))
        o = np.where((norm > 0)[:, None], r / norm[:, None], 0.0) @ rotation(x.shape[1]).T
        bits = o >= 0
        cosine = np.where(norm > 0, np.abs(o).sum(1) / np.sqrt(o.shape[1]), 1.0)
    return np.packbits(bits, axis=1), norm, cosine


def estimate(q: np.ndarray, codes: np.ndarray, norm: np.ndarray, cosine: np.ndarray, c: np.ndarray, width: float = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of queries (rows) with coded vectors (columns), and how far they may be off."""
    n = rotation(q.shape[1]).shape[0]
    with np.errstate(all="ignore"):
        size = np.sqrt((q * q).sum(1))
        turned = (np.where((size > 0)[:, None], q / size[:, None], 0.0) @ rotation(q.shape[1]).T).astype(np.float32)
        signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
        dots = (turned @ signs.T).astype(np.float64) / np.sqrt(n)
        reach = size[:, None] * norm[None, :]
        est = (q @ c)[:, None] + reach * (dots / cosine[None, :])
        err = reach * (width * np.sqrt(np.maximum(1 - cosine**2, 0)) / (cosine * np.sqrt(max(n - 1, 1))) + 1e-5)[None, :] + 1e-9 * np.abs(q @ c)[:, None]
    return np.nan_to_num(est, nan=0.0), np.where(np.isfinite(err) & np.isfinite(est), err, np.inf)


def exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows in double precision, components added in their order."""
    out = np.zeros(len(qi))
    u, v = np.ascontiguousarray(q.T), np.ascontiguousarray(x.astype(np.float64).T)
    with np.errstate(all="ignore"):
        for a in range(0, len(qi), GATHER):
            i, j = qi[a : a + GATHER], xi[a : a + GATHER]
            for component, other in zip(u, v):
                out[a : a + GATHER] += component[i] * other[j]
    return out


def best(qi: np.ndarray, score: np.ndarray, late: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best candidates of each query: by score, rows without an id after those with one, then by id."""
    order = np.lexsort((ident, late, -score, qi))
    q = qi[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k]


def scan(q, tau, own, codes, norm, cosine, c, raw, rows, late, ident, k, width=WIDTH):
    """A tile: (query, vector, score) of at most k vectors for each query, no score below the query's ``tau``."""
    est, err = estimate(q, codes, norm, cosine, c, width)
    mine = own[:, None] == rows[None, :]
    low = np.where(mine, -np.inf, est - err)
    least = np.maximum(tau, np.partition(low, -k, axis=1)[:, -k]) if low.shape[1] >= k else tau
    qi, xi = np.nonzero((est + err >= least[:, None]) & ~mine)
    score = exact(q, raw, qi, xi)
    keep = ~(score < tau[qi])
    qi, xi, score = qi[keep], xi[keep], score[keep]
    at = best(qi, np.where(np.isnan(score), np.inf, score), late[xi], ident[xi], k)
    return qi[at], xi[at], score[at]


# -- the same on Spark --------------------------------------------------------------------------------------------------


def _fit(valid: DataFrame) -> dict[int, np.ndarray]:
    """Centres for the lengths that a bounded sample holds."""
    got = valid.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
    vectors = [np.asarray(x, np.float64) for x in got.column("v").to_pylist()]
    by: dict[int, list[np.ndarray]] = {}
    for v in vectors:
        by.setdefault(len(v), []).append(v)
    most = sorted(by, key=lambda d: (-len(by[d]), d))[:LENGTHS]
    with np.errstate(all="ignore"):
        found = {d: centres(np.array(by[d])) for d in most}
    return {d: c for d, c in found.items() if np.isfinite(c).all()}


def _coded(valid: DataFrame, fitted: dict[int, np.ndarray], wide: bool) -> DataFrame:
    """Rows with their cell, code, scalars and original components (binary)."""
    kind = np.float64 if wide else np.float32

    def run(batches):
        for batch in batches:
            row, ident, query = (batch.column(i) for i in range(3))
            v = batch.column(3)
            at = np.asarray(v.offsets)
            flat, length = np.asarray(v.flatten()), np.diff(at)
            at = at - at[0]
            for d in np.unique(length):
                i = np.flatnonzero(length == d)
                x = flat[at[i][:, None] + np.arange(d)]
                wide_x = x.astype(np.float64)
                c = fitted.get(int(d), np.zeros((1, d)))
                with np.errstate(all="ignore"):
                    cell = ((c**2).sum(1)[None, :] - 2 * wide_x @ c.T).argmin(1) if len(c) > 1 else np.zeros(len(x), int)
                codes, norm, cosine = encode(wide_x, c[cell])
                take = pa.array(i)
                blob = lambda a: pa.array([z.tobytes() for z in a], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d), pa.int32()), pa.array(cell, pa.int32()), row.take(take), ident.take(take), query.take(take), blob(x.astype(kind)), blob(codes), pa.array(norm), pa.array(cosine)], names=["dim", "cell", "row", "id", "query", "raw", "code", "norm", "cosine"])

    return valid.select("row", "id", "query", "v").mapInArrow(tidy(run), "dim int, cell int, row long, id long, query boolean, raw binary, code binary, norm double, cosine double")


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows of one (dim, cell, slot) put together, at most ``most`` a block; every column as one binary value."""

    def run(batches):
        part, number, held, key = TaskContext.get().partitionId(), 0, [], None

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("id")
            join = lambda name: b"".join(t.column(name).to_pylist())
            num = lambda name: t.column(name).to_numpy().tobytes()
            values = [[key[0]], [key[1]], [part << 36 | number], [t.num_rows], [num("row")], [ids.fill_null(0).to_numpy().tobytes()], [ids.is_null().to_numpy().astype(np.uint8).tobytes()], [join("raw")], [join("code")], [num("norm")], [num("cosine")]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array(a, b) for a, b in zip(values, kinds)], names=["dim", "cell", "block", "n", "rows", "ids", "late", "raw", "codes", "norms", "cosines"])

        size = 0
        for batch in batches:
            keys = list(zip(batch.column("dim").to_pylist(), batch.column("cell").to_pylist(), batch.column("slot").to_pylist()))
            a = 0
            while a < len(keys):
                if key is not None and (keys[a] != key or size >= most):
                    yield out()
                    number, held, size = number + 1, [], 0
                key, b = keys[a], a
                while b < len(keys) and keys[b] == key and size + b - a < most:
                    b += 1
                held.append(batch.slice(a, b - a))
                size += b - a
                a = b
        if held:
            yield out()

    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "dim", "cell", "slot").sortWithinPartitions("dim", "cell", "slot")
    return dealt.mapInArrow(tidy(run), "dim int, cell int, block long, n int, rows binary, ids binary, late binary, raw binary, codes binary, norms binary, cosines binary")


def _tiles(tiles: DataFrame, queries: DataFrame, blocks: DataFrame, fitted: dict[int, np.ndarray], wide: bool, k: int, width: float) -> DataFrame:
    """(qrow, query_id, vec_id, score) of tiles (qblock, block); queries have tau, an array of (place, value)."""
    kind = np.float64 if wide else np.float32

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                d = t["dim"]
                q = np.frombuffer(t["q_raw"], kind).reshape(-1, d).astype(np.float64)
                tau = np.full(len(q), -np.inf)
                for x in t["tau"] or []:
                    tau[x["place"]] = x["value"]
                raw = np.frombuffer(t["raw"], kind).reshape(-1, d)
                own, rows, ident = (np.frombuffer(t[x], np.int64) for x in ("q_rows", "rows", "ids"))
                late, names = np.frombuffer(t["late"], np.uint8), np.frombuffer(t["q_ids"], np.int64)
                c = fitted.get(d, np.zeros((1, d)))[t["cell"]]
                codes = np.frombuffer(t["codes"], np.uint8).reshape(len(raw), -1)
                qi, xi, score = scan(q, tau, own, codes, np.frombuffer(t["norms"]), np.frombuffer(t["cosines"]), c, raw, rows, late, ident, k, width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(qi), t["qblock"])), pa.array(qi, pa.int32()), pa.array(own[qi]), pa.array(names[qi]), pa.array(ident[xi], mask=late[xi] > 0), pa.array(score)], names=["qblock", "place", "qrow", "query_id", "vec_id", "score"])

    wanted = tiles.join(queries, "qblock").join(blocks.drop("dim", "n"), "block")
    return wanted.mapInArrow(tidy(run), "qblock long, place int, qrow long, query_id long, vec_id long, score double")


def _needed(queries: DataFrame, cells: DataFrame, fitted: dict[int, np.ndarray], wide: bool, probes: int | None) -> DataFrame:
    """(qblock, dim, cell): cells that a query block must meet by the bound, or the ``probes`` cells nearest to it."""
    kind = np.float64 if wide else np.float32

    def run(batches):
        for batch in batches:
            for t in batch.to_pylist():
                d, there = t["dim"], {x["cell"]: x["radius"] for x in t["there"]}
                q = np.frombuffer(t["q_raw"], kind).reshape(-1, d).astype(np.float64)
                number = np.array(sorted(there))
                with np.errstate(all="ignore"):
                    dots = q @ fitted.get(d, np.zeros((1, d)))[number].T
                    if probes is None:
                        tau = np.full(len(q), -np.inf)
                        for x in t["tau"] or []:
                            tau[x["place"]] = x["value"]
                        reach = np.sqrt((q * q).sum(1))[:, None] * np.array([there[i] for i in number])[None, :]
                        chosen = number[~((dots + reach * (1 + 1e-9) + 1e-12) < tau[:, None]).all(0)]
                    else:
                        chosen = number[np.argsort(-dots.mean(0), kind="stable")[:probes]]
                yield pa.RecordBatch.from_arrays([pa.array([t["qblock"]] * len(chosen), pa.int64()), pa.array([d] * len(chosen), pa.int32()), pa.array(chosen, pa.int32())], names=["qblock", "dim", "cell"])

    there = cells.groupBy("dim").agg(F.collect_list(F.struct("cell", "radius")).alias("there"))  # CELLS at most
    return queries.join(there, "dim").select("qblock", "dim", "q_raw", "tau", "there").mapInArrow(tidy(run), "qblock long, dim int, cell int")


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", width: float = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` is true of, its k nearest other rows."""
    spark = vectors.sparkSession
    bound_batches(spark)
    wide = not isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
    v = F.col("v") if not wide else F.col("v").cast("array<double>")
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("query"), F.col(vec_col).alias("v")).withColumn("v", v)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = picked.filter(fine).withColumn("row", F.monotonically_increasing_id())
    fitted = _fit(valid)
    rows = stored(_coded(valid, fitted, wide), "ann-rows")
    cells = cut(rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.sum(F.col("query").cast("long")).alias("q"), F.max(F.coalesce(F.nanvl("norm", F.lit(float("inf"))), F.lit(0.0))).alias("radius")))
    slot = lambda n, most: F.pmod(F.xxhash64("row"), F.ceil(F.col(n) / most)).cast("long").alias("slot")
    sized = rows.join(small(cells.select("dim", "cell", "n", "q")), ["dim", "cell"])
    blocks = stored(_blocks(sized.select("dim", "cell", slot("n", BLOCK * 0.9), "row", "id", "raw", "code", "norm", "cosine"), BLOCK), "ann-blocks")
    asked = _blocks(sized.filter("query and id is not null").select("dim", "cell", slot("q", QUERIES * 0.9), "row", "id", "raw", "code", "norm", "cosine"), QUERIES)
    asked = stored(asked.select("dim", F.col("block").alias("qblock"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("raw").alias("q_raw")), "ann-queries")
    # a first score to beat, from the first blocks of near cells
    none = asked.withColumn("tau", F.lit(None).cast("array<struct<place: int, value: double>>"))
    first = cut(blocks.groupBy("dim", "cell").agg(F.min("block").alias("block")))
    tried = _needed(none, cells, fitted, wide, PROBES).join(first, ["dim", "cell"]).select("qblock", "block")
    ready = _with_tau(asked, _tiles(tried, none, blocks, fitted, wide, k, width), k)
    # then all blocks in rounds, so a query meets most of them with a score to beat that few rows reach
    rounds = 1
    while ROUND * 4**rounds <= blocks.select("block").count():
        rounds += 1
    drawn = F.pmod(F.xxhash64("block"), F.lit(1 << 30))
    number = F.lit(rounds - 1)
    for i in range(1, rounds):
        number = F.when(drawn < (1 << 30) >> 2 * i, rounds - 1 - i).otherwise(number)
    # blocks of a large cell are met by slots, so no task lists them all
    spread = shuffle_partitions(spark)
    listed = blocks.select("dim", "cell", "block", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int").alias("slot"), number.alias("round"))
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    kept = None
    for i in range(rounds):
        wanted = _needed(ready, cells, fitted, wide, None).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        tiles = wanted.join(listed.filter(F.col("round") == i), ["dim", "cell", "slot"]).select("qblock", "block")
        got = _tiles(tiles, ready, blocks, fitted, wide, k, width)
        kept = (got if kept is None else kept.unionByName(got)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if i + 1 < rounds:
            kept = stored(kept.drop("rank"), "ann-kept")
            ready = _with_tau(asked, kept, k)
    return kept.select("query_id", "rank", "vec_id", "score")


def _with_tau(asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Query blocks with the score of the k-th vector found so far, for queries that have as many."""
    kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))
    beat = found.filter("not isnan(score)").groupBy("qblock", "place").agg(kth.alias("value")).filter("value is not null")
    tau = beat.groupBy("qblock").agg(F.collect_list(F.struct("place", "value")).alias("tau"))
    return stored(asked.join(tau, "qblock", "left"), "ann-beat")
