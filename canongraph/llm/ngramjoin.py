"""Operator 3. N-gram Jaccard join: groups of documents by shared word shingles.

Method: vertical partitioning. All shingles have one global order, which is cut into fragments.

1. The first fragment (``FIRST`` of the hash order) of every set is dealt out by ranges. A shingle that no other set holds is
   lost to every overlap, so a set that counts more of those than its size times one less the threshold links with nothing and goes; equal
   sets are one node from here on.
2. The sets that are left are dealt out whole. Ranges count in how many sets each shingle is, and give the shared ones
   back to their sets: now each set knows its shingles in the global order (rare ones first, then by hash). Two sets that
   link share a shingle among the first n - ceil(n * threshold) + 1 of either, so these make the buckets.
3. Candidates of a bucket pass exact bounds on their overlap (sizes, the place of the bucket's shingle in both sets,
   parity bitmaps) and are verified fragment by fragment: sets are cut at the same bounds of the order, the parts of a pair are
   intersected separately, and the partial overlaps are summed per pair.

Every bucket first compares its nodes with a leader, a few times; then only nodes of a bucket that are still in different
components are compared with each other. So a group of near copies costs a number of comparisons in proportion to its size,
and no link between components is lost.

Sets: distinct 5-word shingles of words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer words make one shingle. Very
long texts are read whole. Null, empty and wordless texts have empty sets and are linked with nothing; a null doc_id takes part like any other and
cannot name a component. Repeated rows, equal texts and equal doc_ids with other texts are rows of their own, linked as their sets are; ties name
the smallest doc_id. An empty table gives an empty result. Further columns are ignored, whatever their names. Shingles
are 64-bit hashes. Tasks hold one range of shingles at a time, whose number grows with the input; shingles of more sets
than a range should hold (a bounded number of them) are counted before and never gathered.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canongraph.llm.common import blocks, bound_batches, cut, mix, raw_bytes, shingles_of, shuffle_partitions, small, stored, tidy, words_of
from canongraph.llm.components import components

#: Fragments that verification cuts the order into; share of the order that makes the first one.
FRAGMENTS, FIRST = 4, 3 / 8
#: Shingles of a range that a task holds, about; shingles that a task gathers before it sends them.
PER_RANGE, FLUSH = 1 << 18, 1 << 19
#: Rounds in which a bucket's nodes are compared with one leader, before all that are still apart are compared; one bucket in
#: so many takes part.
LEADERS, SOME = 3, 4
#: Buckets up to which a row for each is broadcast, so that a bucket of very many nodes need not meet in one task.
BUCKETS = 200_000
#: Shingles known to every task at most (those of most sets: the count that makes one rises with the input), and the least such count.
FREQUENT, OFTEN = 1 << 20, 1000


def sets_of(column: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of each row of a text column."""
    data, at = raw_bytes(column)
    for a, b in blocks(at):
        word, row, _, _ = words_of(data[at[a] : at[b]], at[a : b + 1] - at[a])
        h, row, _ = shingles_of(word, row, k)
        edges = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            yield a + i, np.unique(h[edges[i] : edges[i + 1]])


def set_key(u: np.ndarray) -> int:
    """A 64-bit name of a set."""
    x = mix(u + np.uint64(0x51ED270B))
    return int(mix(np.array([x.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mix(x)) ^ np.uint64(len(u))], np.uint64)).view(np.int64)[0]) if len(u) else 0


def _columns(rows, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(types), types.values())], names=list(types))


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of runs of equal values."""
    start = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(sorted_)])


def _by_range(h: np.ndarray, bits: int, *more: np.ndarray):
    """Splits arrays sorted by hash into (range, bytes, ...) rows."""
    r = (h >> np.uint64(64 - bits)).astype(np.int64)
    start, n = _runs(r)
    return [(int(r[a]), *(x[a : a + k].tobytes() for x in more)) for a, k in zip(start.tolist(), n.tolist())]


def _dealt(batches, types):
    """Of rows (range, kind, arrays, ...) sorted by kind and range: ("row", batch) of kind 0, then (range, arrays)."""
    now, held = None, []

    def out():
        return now, [np.concatenate([np.frombuffer(x, t) for x in c]) for c, t in zip(zip(*held), types)]

    for batch in batches:
        n = int(np.searchsorted(batch.column(1).to_numpy(), 1))
        if n:
            yield "row", batch.slice(0, n)
        rest = batch.slice(n)
        for row in zip(*(rest.column(i).to_pylist() for i in (0, *range(2, 2 + len(types))))):
            if row[0] != now:
                if held:
                    yield out()
                now, held = row[0], []
            held.append(row[1:])
    if held:
        yield out()


def free(n, num: int, den: int):
    """How many shingles of a set of n a linked set may lack."""
    return n + -num * n // den


def first_fragment(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows of kind 0 (doc_id, n, node, h), each document's set size and node, and of kind 1 (range, nodes, counts): how many
    shingles of the first fragment only this node holds, for ranges of nodes."""
    bound = np.uint64(int(FIRST * 2**64))

    def deal(batches):
        held, size, seen, count = [], 0, set(), 0
        types = {"range": pa.int64(), "kind": pa.int32(), "low": pa.binary(), "nodes": pa.binary(), "doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "h": pa.int64()}

        def out():
            h, node = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(h, kind="stable")
            h, node = h[order], node[order]
            start, n = _runs(h)
            # one entry for each shingle; 0 where it is shared
            h, node = h[start], np.where(n > 1, 0, node[start])
            low = (h >> np.uint64(32 - bits)).astype(np.uint32)
            return _columns([(r, 1, x, y, None, None, None, None) for r, x, y in _by_range(h, bits, low, node)], types)

        for batch in batches:
            ids, text_hashes, rows = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for i, u in sets_of(batch.column(1), k):
                key = set_key(u)
                count += 1
                where = (key ^ count * 0x9E3779B97F4A7C15) >> 7 & (1 << bits) - 1  # anywhere
                rows.append((where, 0, None, None, ids[i], len(u), key, text_hashes[i]))
                if not len(u) or key in seen:
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(key)
                u = u[: np.searchsorted(u, bound)]
                held.append((u, np.full(len(u), key, np.int64)))
                size += len(u)
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
            yield _columns(rows, types)
        if size:
            yield out()

    def gather(batches):
        types = {"kind": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "node": pa.int64(), "h": pa.int64(), "range": pa.int64(), "nodes": pa.binary(), "counts": pa.binary()}
        held, size = [], 0

        def out():
            node, n = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
            return _columns([(1, None, None, None, None, g, x, y) for g, x, y in _by_range(node, bits, node, n.astype(np.int64))], types)

        for where, found in _dealt(batches, (np.uint32, np.int64)):
            if where == "row":
                none = [pa.nulls(found.num_rows, t) for t in (pa.int64(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(found.column(i) for i in (1, 4, 5, 6, 7)), *none], names=list(types))
                continue
            low, node = found
            order = np.argsort(low, kind="stable")
            low, node = low[order], node[order]
            start, _ = _runs(low)
            least = np.minimum.reduceat(node, start)
            own = least[(least == np.maximum.reduceat(node, start)) & (least != 0)]
            held.append(own)
            size += len(own)
            if size > FLUSH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    types = "range long, kind int, low binary, nodes binary, doc_id long, n long, node long, h long"
    dealt = docs.mapInArrow(tidy(deal), types).repartition(shuffle_partitions(docs.sparkSession), "range").sortWithinPartitions("kind", "range")
    return dealt.mapInArrow(tidy(gather), "kind int, doc_id long, n long, node long, h long, range long, nodes binary, counts binary")


def alone(found: DataFrame) -> DataFrame:
    """(node, alone): sums of a first fragment's counts, a range of nodes at a time."""

    def add(batches):
        for _, (node, n) in _dealt(batches, (np.int64, np.int64)):
            node, at = np.unique(node, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.bincount(at, n, len(node)).astype(np.int64))], names=["node", "alone"])

    rows = found.filter("kind = 1").select("range", "kind", "nodes", "counts")
    return rows.repartition(shuffle_partitions(found.sparkSession), "range").sortWithinPartitions("kind", "range").mapInArrow(tidy(add), "node long, alone long")


def whole_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, n, b0 to b3, parts): each distinct set, its parity bitmap, and its hashes by fragment."""
    step = (1 << 64) // FRAGMENTS
    cuts = np.array([i * step for i in range(1, FRAGMENTS)], np.uint64)
    types = {"node": pa.int64(), "n": pa.int64(), **{f"b{i}": pa.int64() for i in range(4)}, "parts": pa.list_(pa.binary())}

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for _, u in sets_of(batch.column(1), k):
                if len(u):
                    odd = np.packbits(np.bincount((u & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1)
                    rows.append((set_key(u), len(u), *odd.view(np.int64).tolist(), [x.tobytes() for x in np.split(u, np.searchsorted(u, cuts))]))
                    size += len(u)
                if size > FLUSH:
                    yield _columns(rows, types)
                    rows, size = [], 0
            yield _columns(rows, types)

    def once(batches):
        last = None
        for batch in batches:
            node = batch.column(0).to_numpy()
            new = np.r_[len(node) > 0 and node[0] != last, node[1:] != node[:-1]] if len(node) else np.zeros(0, bool)
            if len(node):
                last = node[-1]
            yield batch.filter(pa.array(new))

    schema = "node long, n long, b0 long, b1 long, b2 long, b3 long, parts array<binary>"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema).repartition(shuffle_partitions(docs.sparkSession), "node").sortWithinPartitions("node").mapInArrow(tidy(once), schema)


def _hashes(parts) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint64)


def frequent_shingles(sets: DataFrame, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in ``least`` sets or more, sorted, and in how many: at most the sum of all sizes over ``least``."""

    def deal(batches):
        held, size = [], 0

        def out():
            h = np.sort(np.concatenate(held))
            start, n = _runs(h)
            return _columns([(r, 1, x, y) for r, x, y in _by_range(h[start], bits, h[start], n.astype(np.uint32))], {"range": pa.int64(), "kind": pa.int32(), "h": pa.binary(), "n": pa.binary()})

        for batch in batches:
            for parts in batch.column(0).to_pylist():
                held.append(_hashes(parts))
                size += len(held[-1])
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def count(batches):
        for _, (h, n) in _dealt(batches, (np.uint64, np.uint32)):
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order].astype(np.int64)
            start, _ = _runs(h)
            total = np.add.reduceat(n, start)
            hot = total >= least
            if hot.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[start[hot]].view(np.int64)), pa.array(total[hot])], names=["h", "n"])

    dealt = sets.select("parts").mapInArrow(tidy(deal), "range long, kind int, h binary, n binary").repartition(shuffle_partitions(sets.sparkSession), "range").sortWithinPartitions("range")
    found = dealt.mapInArrow(tidy(count), "h long, n long").toPandas()  # FREQUENT rows at most
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def buckets(sets: DataFrame, bits: int, num: int, den: int) -> DataFrame:
    """(bucket, node, n, place, w): the first shingles of each set that other sets hold too.

    ``place`` is the shingle's number in the set's order, ``w`` how many such rows the node has.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    shared = sets.sparkSession.sparkContext.broadcast(frequent_shingles(sets, bits, max(OFTEN, -(-total // FREQUENT))))
    groups = max(8, int(np.ceil(np.log2(max(1, total / PER_RANGE)))))  # ranges of nodes, in bits
    types = {"range": pa.int64(), "kind": pa.int32(), "x": pa.binary(), "y": pa.binary(), "z": pa.binary()}
    HEAD, ENTRY = 0, 1  # within a range of nodes: their sizes; their shared shingles with frequencies

    def by_node(node, *more):
        """Rows for ranges of nodes."""
        key = node.view(np.uint64)
        order = np.argsort(key, kind="stable")
        return _by_range(key[order], groups, *(x[order] for x in (node, *more)))

    def deal(batches):
        known, count = shared.value
        held, hot, heads, size = [], [], [], 0

        def out():
            head = np.array(heads, np.int64)
            rows = [(g, 0, x, y, None) for g, x, y in by_node(head[:, 0].copy(), head)]
            if hot:
                rows += [(g, 0, x, y, z) for g, x, y, z in by_node(*(np.concatenate(c) for c in zip(*hot)))]
            h, node = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(h, kind="stable")
            h, node = h[order], node[order]
            rows += [(r, 1, x, y, None) for r, x, y in _by_range(h, bits, h, node)]
            for c in (held, hot, heads):
                c.clear()
            return _columns(rows, types)

        for batch in batches:
            for node, n, parts in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "parts"))):
                u = _hashes(parts)
                heads.append((node, n))
                if len(known):
                    k = np.minimum(np.searchsorted(known, u), len(known) - 1)
                    often = known[k] == u
                    hot.append((np.full(int(often.sum()), node, np.int64), u[often], count[k[often]]))
                    u = u[~often]
                held.append((u, np.full(len(u), node, np.int64)))
                size += len(u) + 8
                if size > FLUSH:
                    yield out()
                    size = 0
        if heads:
            yield out()

    def gather(batches):
        held, size = [], 0

        def out():
            return _columns([(g, ENTRY, x, y, z) for g, x, y, z in by_node(*(np.concatenate(c) for c in zip(*held)))], types)

        for where, found in _dealt(batches, (np.uint64, np.int64)):
            if where == "row":
                kind = np.where(found.column(4).is_null().to_numpy(zero_copy_only=False), HEAD, ENTRY).astype(np.int32)
                yield pa.RecordBatch.from_arrays([found.column(0), pa.array(kind), *(found.column(i) for i in (2, 3, 4))], names=list(types))
                continue
            h, node = found
            order = np.argsort(h, kind="stable")
            h, node = h[order], node[order]
            _, n = _runs(h)
            df = np.repeat(n, n).astype(np.int64)
            many = df > 1
            held.append((node[many], h[many], df[many]))
            size += int(many.sum())
            if size > FLUSH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def first_shingles(head, entries):
        """Of a range of nodes: the rows of their first shingles."""
        head = head[np.argsort(head[:, 0], kind="stable")]
        node, h, df = entries
        order = np.lexsort((h, df, node))
        node, h = node[order], h[order]
        at = np.searchsorted(head[:, 0], node)
        start = np.searchsorted(node, head[:, 0])
        lone = head[:, 1] - (np.searchsorted(node, head[:, 0], "right") - start)
        place = lone[at] + np.arange(len(node)) - start[at]
        first = place <= free(head[:, 1], num, den)[at]
        at, place = at[first], place[first]
        w = np.bincount(at, minlength=len(head))[at]
        columns = [h[first].view(np.int64), *head[at].T, place, w]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in columns], names=["bucket", "node", "n", "place", "w"])

    def prefix(batches):
        """Rows sorted by range and kind."""
        now, head, entries = None, [], []
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def out():
            return first_shingles(np.concatenate(head), [np.concatenate(c) for c in zip(none, *entries)])

        for batch in batches:
            for g, kind, x, y, z in zip(*(c.to_pylist() for c in batch.columns)):
                if g != now:
                    if head:
                        yield out()
                    now, head, entries = g, [], []
                if kind == HEAD:
                    head.append(np.frombuffer(y, np.int64).reshape(-1, 2))
                else:
                    entries.append((np.frombuffer(x, np.int64), np.frombuffer(y, np.uint64), np.frombuffer(z, np.int64)))
        if head:
            yield out()

    n = shuffle_partitions(sets.sparkSession)
    rows = "range long, kind int, x binary, y binary, z binary"
    dealt = sets.mapInArrow(tidy(deal), rows).repartition(n, "range").sortWithinPartitions("kind", "range")
    back = dealt.mapInArrow(tidy(gather), rows).repartition(n, "range").sortWithinPartitions("range", "kind")
    return back.mapInArrow(tidy(prefix), "bucket long, node long, n long, place long, w long")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is num / den or more; overlaps are summed over fragments."""
    fragments = sets.select("node", "n", F.posexplode("parts").alias("fragment", "part"))

    def overlap(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            n = [len(np.intersect1d(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), assume_unique=True)) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(n, pa.int64())], names=["a", "b", "both", "n"])

    left = fragments.select(F.col("node").alias("a"), "fragment", F.col("n").alias("na"), F.col("part").alias("pa"))
    right = fragments.select(F.col("node").alias("b"), "fragment", F.col("n").alias("nb"), F.col("part").alias("pb"))
    joined = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "pa", "pb", (F.col("na") + F.col("nb")).alias("both"))
    sums = joined.mapInArrow(tidy(overlap), "a long, b long, both long, n long").groupBy("a", "b").agg(F.first("both").alias("both"), F.sum("n").alias("n"))
    return sums.filter(F.col("n") * den >= num * (F.col("both") - F.col("n"))).select("a", "b")


def links_of(sets: DataFrame, bits: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between the nodes of ``sets`` that connect all that a link connects.

    Rounds of leaders look at one bucket in SOME (at all, for nodes in few buckets): they only save work. What they leave apart
    is compared in all buckets.
    """
    rows = stored(buckets(sets, bits, num, den), "buckets")
    bitmaps = sets.select("node", *(f"b{i}" for i in range(4)))

    def sized(n, m):
        return F.least(n, m) * den >= num * F.greatest(n, m)

    def needed(n, m):
        """The overlap that sets of such sizes need."""
        return F.ceil(num * (n + m) / (num + den) - 1e-9)

    def near(x: str, y: str):
        """Whether the parity bitmaps leave the overlap that is needed: they differ in no more places than the sets do."""
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        differ = reduce(Column.__add__, (F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}"))) for i in range(4)))
        return differ <= n + m - 2 * needed(n, m)

    def with_bitmap(pairs: DataFrame, side: str) -> DataFrame:
        return pairs.join(small(bitmaps, BUCKETS).withColumnRenamed("node", f"{side}_node"), F.col(f"{side}.node") == F.col(f"{side}_node")).withColumn(side, F.struct(f"{side}.*", *(f"b{i}" for i in range(4)))).drop(f"{side}_node", *(f"b{i}" for i in range(4)))

    def distinct_pairs(met: DataFrame) -> DataFrame:
        return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()

    def labelled(some: DataFrame, label: DataFrame) -> DataFrame:
        """``some`` with the component ``c`` of each node."""
        return some.join(small(label, BUCKETS), "node", "left").withColumn("c", F.coalesce("component_id", "node")).drop("component_id")

    def spanning(some: DataFrame) -> DataFrame:
        """The rows of buckets that span several components."""
        span = cut(some.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("bucket"))
        return some.join(small(span, BUCKETS), "bucket", "left_semi")

    tested = links = None
    open_ = stored(spanning(rows.filter(f"w < {4 * SOME} or pmod(bucket, {SOME}) = 0").select("bucket", "node", "n", "w", F.col("node").alias("c"), F.lit(False).alias("led"))), "open")
    for turn in range(LEADERS):
        # an original shares most first shingles: it leads its copies
        side = F.struct("node", "n", "c")
        lead = cut(open_.filter("not led").groupBy("bucket").agg(F.max_by(side, F.struct("w", "node")).alias("y")))
        met = open_.select("bucket", side.alias("x")).join(small(lead, BUCKETS), "bucket").filter((F.col("x.c") != F.col("y.c")) & sized(F.col("x.n"), F.col("y.n")))
        met = with_bitmap(with_bitmap(met.select("x", "y").distinct(), "x"), "y").filter(near("x", "y"))
        pairs = distinct_pairs(met)
        pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        new = stored(verify(pairs, sets, num, den), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        label = cut(components(links))
        # only buckets that still span several components, and have a node that no leader is linked with, go on
        led = lead.select("bucket", F.col("y.node").alias("node")).join(small(label, BUCKETS), "node", "left").select("bucket", F.coalesce("component_id", "node").alias("lead_c"))
        placed = labelled(open_.drop("c"), label).join(small(cut(led), BUCKETS), "bucket", "left")
        placed = stored(placed.withColumn("led", F.col("led") | F.coalesce(F.col("c") == F.col("lead_c"), F.lit(False))).drop("lead_c"), "placed")
        open_ = stored(spanning(placed), "open")
        if not open_.limit(1).count():
            break

    # x is the larger set (or as large). It is enough to meet at the first common shingle: all of the overlap lies from there on
    # in both sets, which leaves few sizes to meet; sizes are joined by classes
    every = labelled(rows, label) if links is not None else rows.withColumn("c", F.col("node"))
    open_ = stored(spanning(every.select("bucket", "node", "n", "place", "c")), "open")
    open_ = open_.join(small(bitmaps, BUCKETS), "node")
    n, class_of = F.col("n"), lambda size: F.floor(F.log(size) / float(np.log(1.04))).cast("int")
    least_, most = F.ceil(num * n / den - 1e-9), F.least(n, F.floor((n - F.col("place")) * (num + den) / num + 1e-9) - n)
    x = open_.filter(most >= least_).withColumn("size", F.explode(F.sequence(class_of(least_), class_of(most)))).alias("x")
    y = open_.filter((n - F.col("place")) * (num + den) >= 2 * num * n).withColumn("size", class_of(n)).alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    first = (n - F.col("x.place") >= needed(n, m)) & (m - F.col("y.place") >= needed(n, m))
    larger = (n > m) | (n == m) & (F.col("x.node") < F.col("y.node"))
    apart = (F.col("x.c") != F.col("y.c")) & sized(n, m) & near("x", "y")
    pairs = distinct_pairs(x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.size") == F.col("y.size")) & larger & first & apart))
    pairs = stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    new = verify(pairs, sets, num, den)
    return stored(new, "links") if links is None else links.unionByName(stored(new, "links"))


def _classes(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, text, h), h a hash of the text.

    Returns each row's (doc_id, n_shingles, node, h), and (node, least, first, c) of nodes with shingles: the smallest doc_id, the
    first row as (none, doc_id, h), and the component.
    """
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = max(12, int(np.ceil(np.log2(max(1, words / PER_RANGE)))))
    found = stored(first_fragment(docs, k, bits), "fragment")
    described = found.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "node", "h")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    nodes = cut(described.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), first.alias("first")))
    left = nodes.join(alone(found), "node", "left").filter(F.coalesce("alone", F.lit(0)) <= F.col("n") - F.ceil(num * F.col("n") / den - 1e-9))
    ids = cut(left.select(F.col("least").alias("id")).distinct())
    sets = stored(whole_sets(docs.join(small(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi"), k), "sets")
    label = cut(components(links_of(sets, bits, num, den)))
    return described, nodes.join(label, "node", "left").select("node", "least", "first", F.coalesce("component_id", "node").alias("c"))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document; similarity threshold num / den."""
    described, named = _classes(_documents(docs, id_col, text_col), k, num, den)
    # a component is named by its smallest doc_id
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = cut(named.join(names, "c").select("node", "component_id"))
    out = described.join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def first_documents(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each component: the one with the smallest doc_id stays (a null
    one comes last), of equal ones that with the smallest hash of its text. Rows without words all stay."""
    described, named = _classes(_documents(docs, id_col, text_col), k, num, den)
    kept = stored(named.groupBy("c").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__kept"), F.col("first.h").alias("__text")), "kept")
    has_words = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__kept")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__text"))
    out = docs.filter(has_words).join(small(kept), same, "left_semi")
    if described.filter("n_shingles > 0").groupBy("doc_id", "h").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, text_col])  # rows that repeat an id and its text
    return out.unionByName(docs.filter(~has_words))
