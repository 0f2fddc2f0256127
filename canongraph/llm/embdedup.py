"""Operator 1. Near-duplicate embeddings: exact cosine links by int8 tiles.

Method: each vector, scaled to length 1, is quantised to int8 with a scale of its own; the length of what quantisation
loses is its error bound. Vectors form blocks, and each pair of blocks is a tile whose int8 products are taken at once; only
int8 rows, scales and bounds travel to tiles. With errors e and f of two vectors, their cosine is within (1 + e) f + e of the
scaled product: pairs below or above the threshold by more are decided, and only the others are computed again from the full
vectors in double precision (as pairs, or the whole tile where it has very many).

Equal vectors are one node with a weight. Blocks follow the nearest of some pivots, whose number grows with the input. As
angles obey the triangle inequality, two cells whose pivots are further apart than their radii and the threshold's angle
make no tile, and two cells that lie within the threshold's angle altogether are linked whole, without products. A tile
returns link counts and a spanning forest of its links, never its pairs. What the bounds on angles leave is quadratic where vectors
do not cluster, in tasks of bounded size; tiles are listed on Spark.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths
never link. Rows that repeat a vec_id count as one vector (the largest); equal vectors link. A null vec_id links with
nothing and has no component. Ties name the smallest vec_id. An empty table gives an empty result; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.llm.common import bound_batches, cut, stored, tidy
from canongraph.llm.components import components, forest

#: Vectors in a block, about; rows of a tile that are multiplied at once.
BLOCK, STRIP = 4096, 512
#: Bytes of pivots that every task knows, at most; they are as many as there are blocks up to there.
PIVOT_BYTES = 1 << 26
#: Pairs that a tile may leave undecided before it is computed again as a whole.
UNDECIDED = 8192
#: Slack for rounding in bounds that are computed in floating point.
EPS = 1e-6
#: Kinds of rows that tiles give: link weights of a node, links, undecided pairs, undecided tiles.
WEIGHT, LINK, PAIR, TILE = range(4)


def quantise(x: np.ndarray):
    """(int8 rows, scales, error bounds) of rows of length 1."""
    scale = np.abs(x).max(1, keepdims=True) / 127
    q = np.rint(x / scale)
    return q.astype(np.int8), scale[:, 0], np.linalg.norm(x - q * scale, axis=1) + EPS


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(x, y, least: float):
    """x, y: (int8 rows, scales, errors) of two blocks; y None: pairs within x, each once.

    Returns (rows of x, rows of y) of the pairs that link for certain, and of those that the bounds leave open.
    """
    same = y is None
    (qx, sx, ex), (qy, sy, ey) = x, x if same else y
    fy = qy.T.astype(np.float32)
    exact = qx.shape[1] * 127 * 127 < 1 << 24  # float32 products of int8 rows are whole numbers, without rounding
    slack = EPS if exact else 1e-3
    sure, open_ = [], []
    for a in range(0, len(qx), STRIP):
        b = min(len(qx), a + STRIP)
        product = qx[a:b].astype(np.float32) @ fy
        product *= sx[a:b, None].astype(np.float32)
        product *= sy[None, :].astype(np.float32)
        bound = (1 + ex[a:b, None].astype(np.float32)) * ey[None, :].astype(np.float32) + ex[a:b, None].astype(np.float32) + np.float32(slack)
        i, j = np.nonzero(product >= least - bound)
        above = product[i, j] >= least + bound[i, j]
        i += a
        keep = i < j if same else np.ones(len(i), bool)
        sure.append((i[keep & above], j[keep & above]))
        open_.append((i[keep & ~above], j[keep & ~above]))
    return tuple(tuple(np.concatenate(c) for c in zip(*some)) for some in (sure, open_))


def full_links(x: np.ndarray, y: np.ndarray | None, least: float):
    """(rows of x, rows of y) of the pairs of rows of length 1 that link, in double precision."""
    out = []
    for a in range(0, len(x), STRIP):
        i, j = np.nonzero(x[a : a + STRIP] @ (x if y is None else y).T >= least - 1e-9)
        i += a
        if y is None:
            i, j = i[i < j], j[i < j]
        ok = np.einsum("ij,ij->i", x[i], (x if y is None else y)[j]) >= least  # summed as single pairs are
        out.append((i[ok], j[ok]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _rows(ids, weights, other_ids, other_weights, i, j) -> list[tuple]:
    """(kind, a, b) arrays of links (i, j): weights of each node's links, and a forest of them."""
    a, b = ids[i], other_ids[j]
    who, at = np.unique(np.r_[a, b], return_inverse=True)
    n = np.bincount(at, np.r_[other_weights[j], weights[i]], len(who)).astype(np.int64) if len(who) else np.zeros(0, np.int64)
    node, root = forest(a, b) if len(a) else (a, b)
    return [(np.full(len(who), WEIGHT), who, n), (np.full(len(node), LINK), node, root)]


def _frame(parts) -> pd.DataFrame:
    kind, a, b = (np.concatenate(c) for c in zip(*parts))
    return pd.DataFrame({"kind": kind.astype(np.int32), "a": a, "b": b})


_FOUND = "kind int, a long, b long"


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector."""
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = dict(vectors.dtypes)[vector_col]
    value = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    every = vectors.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.max(value).alias("v"))
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    every = every.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & finite, F.lit(False)))
    # equal vectors are told by 128 bits
    every = stored(every.withColumn("h", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit("second"), "v")), "vectors")
    nodes = stored(every.filter("ok").groupBy("h", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("m"), F.first("v").alias("v")), "nodes")

    total, width = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    wanted = max(1, min(-(-total // BLOCK), PIVOT_BYTES // (8 * (width or 1))))
    picked: dict[int, list] = {}
    for r in nodes.orderBy(F.xxhash64("node", F.lit("pivot"))).select("v").limit(wanted).collect():
        picked.setdefault(len(r.v), []).append(r.v)
    pivots = {n: unit(p) for n, p in picked.items()}
    shared = spark.sparkContext.broadcast(pivots)
    far = float(np.arccos(least))

    # cell: vector length, nearest pivot, and whether the vector is within half the threshold's angle of it
    def assign(frames):
        for f in frames:
            cell, angle = np.zeros(len(f), np.int64), np.zeros(len(f))
            sizes = f["v"].map(len).to_numpy()
            packed = [None] * len(f)
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                x, p = unit(f["v"].iloc[own]), shared.value.get(int(n))
                if p is None:
                    cell[own], angle[own] = (n << 20) + 1, np.pi
                else:
                    cos = x @ p.T
                    angle[own] = np.arccos(np.clip(cos.max(1), -1, 1)) + EPS
                    cell[own] = (n << 20) + (cos.argmax(1) << 1) + (angle[own] > far / 2 - EPS)
                q, scale, error = quantise(x)
                for k, *row in zip(own.tolist(), q, scale, error):
                    packed[k] = (row[0].tobytes(), row[1], row[2])
            q, scale, error = zip(*packed) if packed else ((), (), ())
            yield pd.DataFrame({"node": f["node"], "m": f["m"], "cell": cell, "angle": angle, "q": q, "scale": scale, "error": error})

    placed = stored(nodes.select("node", "m", "v").mapInPandas(tidy(assign), "node long, m long, cell long, angle double, q binary, scale double, error double"), "placed")
    cells = cut(placed.groupBy("cell").agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.max("angle").alias("radius"), F.min("node").alias("first")).withColumn("parts", F.ceil(F.col("n") / BLOCK)))
    known = {r.cell: r.radius for r in cells.select("cell", "radius").collect()}  # two for each pivot and vector length
    radii = spark.sparkContext.broadcast((np.array(sorted(known), np.int64), np.array([known[c] for c in sorted(known)])))

    def meet(frames):
        """(a, b, whole): pairs of cells that may have links; ``whole``: all of their pairs link."""
        all_, radius = radii.value
        for f in frames:
            for c, r in zip(f["cell"], f["radius"]):
                n = c >> 20
                some = np.flatnonzero((all_ >> 20 == n) & (all_ >= c))
                p = shared.value.get(int(n))
                apart = np.zeros(len(some))
                if p is not None:
                    apart = np.arccos(np.clip(p[(all_[some] & (1 << 20) - 1) >> 1] @ p[(c & (1 << 20) - 1) >> 1], -1, 1))
                    apart[all_[some] >> 1 == c >> 1] = 0
                near = apart <= r + radius[some] + far + EPS
                whole = apart + r + radius[some] <= far - EPS
                yield pd.DataFrame({"a": c, "b": all_[some[near]], "whole": whole[near]})

    met = cut(cells.repartition("cell").select("cell", "radius").mapInPandas(tidy(meet), "a long, b long, whole boolean"))
    # cells that link whole: every vector gets the other cell's weight, and one link joins what is joined
    side = cells.select(F.col("cell").alias("b"), F.col("m").alias("mb"), F.col("first").alias("fb"))
    whole = met.filter("whole").join(side, "b").join(cells.select(F.col("cell").alias("a"), F.col("m").alias("ma"), F.col("first").alias("fa")), "a")
    gain = whole.select(F.col("a").alias("cell"), F.col("mb").alias("gain"), (F.col("a") == F.col("b")).alias("own")).unionByName(whole.filter("a <> b").select(F.col("b").alias("cell"), F.col("ma").alias("gain"), F.lit(False).alias("own")))
    gain = gain.groupBy("cell").agg(F.sum("gain").alias("gain"), F.max("own").alias("own"))
    gains = placed.join(F.broadcast(gain), "cell").select(F.col("node").alias("a"), (F.col("gain") - F.when(F.col("own"), F.col("m")).otherwise(0)).alias("b"))  # a row for each cell
    inner = whole.filter("a = b").select(F.col("a").alias("cell"), F.col("fa").alias("b"))
    joins = whole.filter("a <> b").select(F.col("fa").alias("a"), F.col("fb").alias("b")).unionByName(placed.join(F.broadcast(inner), "cell").select(F.col("node").alias("a"), "b"))

    block = F.shiftleft(F.col("cell"), 20) + F.pmod(F.xxhash64("node"), F.col("parts"))
    numbered = placed.join(F.broadcast(cells.select("cell", "parts")), "cell").withColumn("block", block)

    def pack(keys, f):
        q = np.stack([np.frombuffer(x, np.int8) for x in f["q"]])
        columns = {"node": f["node"].to_numpy(np.int64), "m": f["m"].to_numpy(np.int64), "scale": f["scale"].to_numpy(float), "error": f["error"].to_numpy(float), "q": q}
        return pd.DataFrame({"block": [keys[0]], "width": [q.shape[1]], **{k: [x.tobytes()] for k, x in columns.items()}})

    blocks = stored(numbered.groupBy("block").applyInPandas(pack, "block long, width int, node binary, m binary, scale binary, error binary, q binary"), "blocks")
    # tiles: pairs of blocks of two cells, or of one cell each pair once
    number = {c: cells.select(F.col("cell").alias(c), F.col("parts").alias(f"parts_{c}")) for c in "ab"}
    tiles = met.filter("not whole").join(number["a"], "a").join(number["b"], "b")
    tiles = tiles.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts_a") - 1)))
    tiles = tiles.withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(F.lit(0).cast("long")), F.col("parts_b") - 1)))
    tiles = tiles.select((F.shiftleft("a", 20) + F.col("i")).alias("a"), (F.shiftleft("b", 20) + F.col("j")).alias("b"))

    def sides(which: DataFrame) -> DataFrame:
        return which.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("block"), "a", "b")

    def tile(keys, f):
        own = []
        for b in keys if keys[0] != keys[1] else keys[:1]:
            r = f[f["block"] == b].iloc[0]
            ids, m, scale, error = (np.frombuffer(r[c], t) for c, t in (("node", np.int64), ("m", np.int64), ("scale", float), ("error", float)))
            own.append((ids, m, (np.frombuffer(r["q"], np.int8).reshape(-1, r["width"]), scale, error)))
        x, y = own[0], own[-1]
        sure, open_ = tile_links(x[2], None if len(own) == 1 else y[2], least)
        if len(open_[0]) > UNDECIDED:
            return pd.DataFrame({"kind": np.array([TILE], np.int32), "a": [keys[0]], "b": [keys[1]]})
        return _frame([*_rows(x[0], x[1], y[0], y[1], *sure), (np.full(len(open_[0]), PAIR), x[0][open_[0]], y[0][open_[1]])])

    found = stored(sides(tiles).join(blocks, "block").groupBy("a", "b").applyInPandas(tile, _FOUND), "found")

    # undecided pairs, from the full vectors
    full = nodes.select("node", "m", "v")
    pairs = found.filter(F.col("kind") == PAIR).select("a", "b").join(full.select(F.col("node").alias("a"), F.col("m").alias("ma"), F.col("v").alias("va")), "a").join(full.select(F.col("node").alias("b"), F.col("m").alias("mb"), F.col("v").alias("vb")), "b")

    def decide(frames):
        for f in frames:
            if len(f):
                ok = np.zeros(len(f), bool)
                sizes = f["va"].map(len).to_numpy()
                for n in np.unique(sizes):
                    own = np.flatnonzero(sizes == n)
                    ok[own] = np.einsum("ij,ij->i", unit(f["va"].iloc[own]), unit(f["vb"].iloc[own])) >= least
                f = f[ok]
            at = np.arange(len(f))
            yield _frame(_rows(f["a"].to_numpy(np.int64), f["ma"].to_numpy(np.int64), f["b"].to_numpy(np.int64), f["mb"].to_numpy(np.int64), at, at))

    # undecided tiles, from the full vectors of their blocks
    again = cut(found.filter(F.col("kind") == TILE).select("a", "b"))
    asked = again.select(F.explode(F.array("a", "b")).alias("block")).distinct()

    def pack_full(keys, f):
        x = unit(f["v"])
        return pd.DataFrame({"block": [keys[0]], "width": [x.shape[1]], "node": [f["node"].to_numpy(np.int64).tobytes()], "m": [f["m"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()]})

    def whole_tile(keys, f):
        own = []
        for b in keys if keys[0] != keys[1] else keys[:1]:
            r = f[f["block"] == b].iloc[0]
            own.append((np.frombuffer(r["node"], np.int64), np.frombuffer(r["m"], np.int64), np.frombuffer(r["x"], float).reshape(-1, r["width"])))
        x, y = own[0], own[-1]
        return _frame(_rows(x[0], x[1], y[0], y[1], *full_links(x[2], None if len(own) == 1 else y[2], least)))

    decided = pairs.mapInPandas(tidy(decide), _FOUND)
    if again.limit(1).count():
        members = numbered.select("block", "node", "m").join(asked, "block", "left_semi").join(full.select("node", "v"), "node")
        full_blocks = members.groupBy("block").applyInPandas(pack_full, "block long, width int, node binary, m binary, x binary")
        decided = decided.unionByName(sides(again).join(full_blocks, "block").groupBy("a", "b").applyInPandas(whole_tile, _FOUND))
    found = found.unionByName(stored(decided, "decided"))
    weights = found.filter(F.col("kind") == WEIGHT).select("a", "b").unionByName(gains).groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    label = cut(components(found.filter(F.col("kind") == LINK).select("a", "b").unionByName(joins)))
    named = nodes.select("h", "h2", "node", "m").join(weights, "node", "left").join(label, "node", "left")
    named = named.select(F.col("h").alias("nh"), F.col("h2").alias("nh2"), (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("component_id", "node").alias("component"))
    out = every.select("vec_id", "ok", "h", "h2").join(named, F.col("ok") & (F.col("h") == F.col("nh")) & (F.col("h2") == F.col("nh2")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
