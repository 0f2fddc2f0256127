"""Operator 2. Exact substring deduplication over all texts.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or another.

Method: sparse suffix sorting. Sorting the suffixes of all bytes would move many times the input, so suffixes are sorted
where they can matter. (1) Every window of ``length`` bytes picks the gram inside it with the least hash as its anchor;
equal windows pick equal anchors at equal places. Consecutive windows of one anchor make a span, and spans are dealt out
by their anchor. A span that occurs twice has all its windows repeated; an anchor that occurs once has none. (2) What
is left are windows of anchors that recur in different surroundings, mostly at the ends of repeated passages. Each is
the start of a suffix: sampled splitters range-partition these suffixes by their leading bytes, and buckets sort them
locally by multikey quicksort, eight bytes at a time (sixteen bytes of text, then a fingerprint of all ``length`` bytes), and
compare neighbours. A run of equal leading bytes may be cut by a splitter: such cuts go by the fingerprint too, so that equal
suffixes are never on two sides of a bound.

Repeats inside a task are settled there and only one copy travels, so a passage that fills a third of all rows costs each
bucket one entry a task. Spans are equal if the hash of the anchor (32 bits and the range's) and that of the span (64 bits)
are; suffixes if sixteen bytes and a 64-bit fingerprint are. Rows are told apart by a 64-bit hash of id and text, and
hashes that two different rows share are drawn again.

Null texts count as empty; texts shorter than ``length`` lose nothing; very long texts are cut into segments that overlap.
Repeated rows, also those of one doc_id, are elsewhere to each other, so all of their windows go. An empty table gives an empty
result. Of columns asked for with ``keep``, those called like a column of the result give way to it; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canongraph.llm.common import BASE, blocks, bound_batches, cut, mix, prefix_hash, raw_bytes, shuffle_partitions, stored, tidy

#: Windows looked at together (positions must fit PLACE bits).
SEGMENT, PLACE = 1 << 19, 22
#: Spans or windows a task gathers before it settles its own repeats and sends the rest.
FLUSH = 300_000
#: Bytes of text a range of anchors stands for, about; suffixes in a bucket, about.
PER_RANGE, PER_BUCKET = 1 << 20, 1 << 18
#: Rows of requests or spans up to which they are broadcast (a few dozen bytes each); more go by a shuffle join.
BROADCAST_ROWS = 1_000_000


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    n = len(v) - w + 1
    x = np.full(-(-len(v) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    x[: len(v)] = v
    x = x.reshape(-1, w)
    before = np.minimum.accumulate(x, axis=1).ravel()
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def spans(data: np.ndarray, at: np.ndarray, length: int):
    """(row, first window, number of windows, anchor hash, span hash) for the texts data[at[i]:at[i+1]]."""
    gram = length // 2
    wide = length - gram + 1
    low = np.uint64((1 << PLACE) - 1)
    for base in range(0, max(0, len(data) - length + 1), SEGMENT):
        d = data[base : base + SEGMENT + length - 1]
        sums, down = prefix_hash(d)
        h = mix((sums[gram:] - sums[:-gram]) * down[: len(d) - gram + 1])
        least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), wide)
        p = np.arange(len(least))
        row = np.searchsorted(at, p + base, "right") - 1
        inside = p + base + length <= at[row + 1]
        p, row, anchor = p[inside], row[inside], (least[inside] & low).astype(np.int64)
        if not len(p):
            continue
        first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1) | (row[1:] != row[:-1])])
        n = np.diff(np.r_[first, len(p)])
        p0, a = p[first], anchor[first]
        end = p0 + n - 1 + length
        whole = mix((sums[end] - sums[p0]) * down[p0] + (a - p0).astype(np.uint64) * np.uint64(BASE) + (n.astype(np.uint64) << np.uint64(40)))
        yield row[first], p0 + base - at[row[first]], n, h[a], whole


def _runs(*keys: np.ndarray):
    """Start and length of runs of equal keys."""
    differs = np.zeros(len(keys[0]), bool)
    differs[:1] = True
    for k in keys:
        differs[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(differs)
    return start, np.diff(np.r_[start, len(keys[0])])


def merged(start: np.ndarray, end: np.ndarray, group: np.ndarray | None = None):
    """Maximal runs of intervals within each group, sorted: (start, end, group)."""
    group = np.zeros(len(start), np.int64) if group is None else group
    order = np.lexsort((start, group))
    start, end, group = start[order], end[order], group[order]
    if not len(start):
        return start, end, group
    new = np.r_[True, group[1:] != group[:-1]]
    rank = np.cumsum(new) - 1
    big = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * big)  # ends so far, per group
    new[1:] |= start[1:] + rank[1:] * big > reach[:-1]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    return start[first], reach[last] - rank[last] * big, group[first]


_DEALT = "range long, kind int, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary"
_FOUND = "kind int, rid long, start long, stop long"


def _dealt(rows) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), *[pa.binary()] * 5]
    names = ["range", "kind", "c0", "c1", "c2", "c3", "c4"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)


def _found(kind: int, rid, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rid), kind, np.int32)), pa.array(rid.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(stop.astype(np.int64))], names=["kind", "rid", "start", "stop"])


def _intervals(rid, start, stop, ranges: int):
    """Rows (kind 0) that carry settled intervals to wherever ``ranges`` puts them."""
    start, stop, rid = merged(start, stop, rid)
    where = mix(rid.view(np.uint64)) % np.uint64(ranges)
    order = np.argsort(where, kind="stable")
    where, rid, start, stop = where[order], rid[order], start[order], stop[order]
    first, n = _runs(where)
    return [(int(where[a]), 0, rid[a : a + k].tobytes(), start[a : a + k].tobytes(), stop[a : a + k].tobytes(), b"", b"") for a, k in zip(first, n)]


def _pass(batch_rows):
    """(kind 0 columns) of a dealt row."""
    return _found(0, *(np.frombuffer(batch_rows[i], np.int64) for i in (2, 3, 4)))


def _per_range(batches):
    """Yields ("settled", batch) and ((range), columns) of rows sorted by range."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[1] == 0:
                yield None, _pass(row)
                continue
            if row[0] != now:
                if held:
                    yield now, held
                now, held = row[0], []
            held.append(row[2:])
    if held:
        yield now, held


def _columns(held, types):
    return [np.concatenate([np.frombuffer(x, t) for x in c]) for c, t in zip(zip(*held), types)]


def find_spans(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """docs: (rid, text). Rows (kind, rid, start, stop): kind 0 repeated bytes; kind 1 windows start..stop-1 to compare."""

    def deal(batches):
        held, size = [], 0

        def out():
            rid, p0, n, key, whole = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((whole, key))
            rid, p0, n, key, whole = rid[order], p0[order], n[order], key[order], whole[order]
            first, count = _runs(key, whole)
            twice = np.repeat(count > 1, count)
            rows = _intervals(rid[twice], p0[twice], p0[twice] + n[twice] - 1 + length, 1 << bits)
            flag = (count > 1).astype(np.uint8)
            rid, p0, n, key, whole = rid[first], p0[first], n[first], key[first], whole[first]
            where = key >> np.uint64(64 - bits)
            low = (key >> np.uint64(32 - bits)).astype(np.uint32)
            a, k = _runs(where)
            flags = (n.astype(np.uint16) << 1) | flag
            rows += [(int(where[x]), 1, low[x : x + y].tobytes(), whole[x : x + y].tobytes(), rid[x : x + y].tobytes(), p0[x : x + y].astype(np.uint32).tobytes(), flags[x : x + y].tobytes()) for x, y in zip(a, k)]
            return _dealt(rows)

        for batch in batches:
            rids = batch.column(0).to_numpy()
            data, at = raw_bytes(batch.column(1))
            for a, b in blocks(at):
                for row, p0, n, key, whole in spans(data[at[a] : at[b]], at[a : b + 1] - at[a], length):
                    held.append((rids[a + row], p0, n, key, whole))
                    size += len(row)
            if size > FLUSH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def gather(batches):
        for where, held in _per_range(batches):
            if where is None:
                yield held
                continue
            low, whole, rid, p0, flags = _columns(held, (np.uint32, np.uint64, np.int64, np.uint32, np.uint16))
            order = np.lexsort((whole, low))
            low, whole, rid, p0, flags = low[order], whole[order], rid[order], p0[order].astype(np.int64), flags[order]
            n, flag = (flags >> 1).astype(np.int64), flags & 1
            s, sn = _runs(low, whole)
            many = (sn > 1) | (np.add.reduceat(flag.astype(np.int64), s) > 0)
            full = np.repeat(many, sn)
            k, kn = _runs(low)
            kinds = np.diff(np.r_[np.searchsorted(s, k), len(s)])  # different spans of an anchor
            mixed = np.repeat(kinds > 1, kn)
            rep = np.zeros(len(low), bool)
            rep[s[many]] = True
            start, stop, own = merged(p0[full], p0[full] + n[full] - 1 + length, rid[full])
            yield _found(0, own, start, stop)
            ask = mixed & (~full | rep)
            yield _found(1, rid[ask], p0[ask], p0[ask] + n[ask])

    dealt = docs.mapInArrow(tidy(deal), _DEALT).repartition(shuffle_partitions(docs.sparkSession), "range").sortWithinPartitions("range")
    return dealt.mapInArrow(tidy(gather), _FOUND)


def compare_suffixes(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """asked: (rid, start, stop) windows. Rows (kind 0, rid, start, stop) of the windows that occur twice among them."""
    spark = docs.sparkSession
    n = asked.agg(F.sum(F.col("stop") - F.col("start")).alias("n")).first().n or 0
    lists = asked.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("asked"))
    lists = F.broadcast(lists) if asked.count() <= BROADCAST_ROWS else lists
    texts = docs.join(lists, "rid").select("rid", "text", F.col("asked.start").alias("start"), F.col("asked.stop").alias("stop"))
    n_buckets = max(shuffle_partitions(spark), -(-n // PER_BUCKET))

    def suffixes(batch):
        """(row, place, first eight bytes, next eight, fingerprint of ``length`` bytes) of a batch's windows."""
        data, at = raw_bytes(batch.column(1))
        starts, stops = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            d = data[at[i] : at[i + 1]]
            a, b = starts[i].values.to_numpy(), stops[i].values.to_numpy()
            k = b - a
            every = np.repeat(a, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            sums, down = prefix_hash(d)
            for first in range(0, len(every), FLUSH):
                p = every[first : first + FLUSH]
                print_ = mix((sums[p + length] - sums[p]) * down[p])
                yield i, p, *leading(d, p, length), print_

    def sampled(batches):
        for batch in batches:
            for _, _, lead, _, print_ in suffixes(batch):
                yield pa.RecordBatch.from_arrays([pa.array(x[::64].view(np.int64)) for x in (lead, print_)], names=["lead", "print"])

    # a sample for the splitters: balance depends on it, results do not
    part = texts.filter(F.pmod(F.xxhash64("rid"), F.lit(16)) == 0).mapInArrow(tidy(sampled), "lead long, print long").limit(50_000).toPandas()
    split, split_print = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("lead", "print"))
    order = np.lexsort((split_print, split))
    order = order[np.unique(np.linspace(0, len(order) - 1, n_buckets + 1).astype(int)[1:-1])] if len(order) else order
    split, split_print = split[order], split_print[order]

    def deal(batches):
        held, size = [], 0

        def out():
            rid, p, lead, more, print_ = (np.concatenate(c) for c in zip(*held))
            # splitters are sorted in: a suffix belongs behind those that do not exceed it
            is_split = np.r_[np.zeros(len(lead), np.int8), np.ones(len(split), np.int8)]
            order = np.lexsort((-is_split, np.r_[print_, split_print], np.r_[lead, split]))
            where = np.cumsum(is_split[order])[is_split[order] == 0]
            order = order[is_split[order] == 0]
            rid, p, lead, more, print_ = rid[order], p[order], lead[order], more[order], print_[order]
            # equal ones are neighbours but for an accident of the fingerprint, which the bucket settles
            first, count = _runs(lead, print_, more)
            twice = np.repeat(count > 1, count)
            rows = _intervals(rid[twice], p[twice], p[twice] + length, n_buckets)
            flag = (count > 1).astype(np.uint8)
            rid, p, lead, more, print_, where = rid[first], p[first], lead[first], more[first], print_[first], where[first]
            a, k = _runs(where)
            for x, y in zip(a, k):
                own = slice(x, x + y)
                words = lead[own].tobytes() + more[own].tobytes()
                rows.append((int(where[x]), 1, words, print_[own].tobytes(), rid[own].tobytes(), p[own].astype(np.uint32).tobytes(), flag[own].tobytes()))
            return _dealt(rows)

        for batch in batches:
            rids = batch.column(0).to_numpy()
            for i, p, *words in suffixes(batch):
                held.append((np.full(len(p), rids[i], np.int64), p, *words))
                size += len(p)
                if size > FLUSH:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def gather(batches):
        for where, held in _per_range(batches):
            if where is None:
                yield held
                continue
            lead = np.concatenate([np.frombuffer(x[0], np.uint64)[: len(x[0]) // 16] for x in held])
            more = np.concatenate([np.frombuffer(x[0], np.uint64)[len(x[0]) // 16 :] for x in held])
            print_, rid, p, flag = _columns([x[1:] for x in held], (np.uint64, np.int64, np.uint32, np.uint8))
            order = multikey_quicksort(lead, more, print_)
            lead, more, print_, rid, p, flag = lead[order], more[order], print_[order], rid[order], p[order].astype(np.int64), flag[order]
            first, count = _runs(lead, more, print_)
            many = np.repeat((count > 1) | (np.add.reduceat(flag.astype(np.int64), first) > 0), count)
            start, stop, own = merged(p[many], p[many] + length, rid[many])
            yield _found(0, own, start, stop)

    dealt = texts.mapInArrow(tidy(deal), _DEALT).repartition(n_buckets, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(tidy(gather), _FOUND)


def leading(d: np.ndarray, p: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes 0 to 7 and 8 to 15 of the windows at p as numbers in byte order; 0 where a window is too short for a word."""
    out = []
    for k in (0, 8):
        if length < k + 8:
            out.append(np.zeros(len(p), np.uint64))
        else:
            out.append(np.lib.stride_tricks.sliding_window_view(d, 8)[p + k].copy().view(">u8").ravel().astype(np.uint64))
    return out[0], out[1]


def multikey_quicksort(*words: np.ndarray, few: int = 2048) -> np.ndarray:
    """The order of strings whose successive words are given, by ternary partitioning on one word at a time.

    Strings that are below, equal to and above a pivot in a word part; equal ones go on to the next word. Runs of up
    to ``few`` strings are sorted at once.
    """
    order = np.arange(len(words[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        own = order[a:b]
        if b - a <= few:
            order[a:b] = own[np.lexsort([w[own] for w in words[:depth:-1]] + [words[depth][own]])]
            continue
        w = words[depth][own]
        pivot = np.sort(w[:: max(1, len(w) // 31)])[min(15, (len(w) - 1) // 2)]
        low, high = w < pivot, w > pivot
        same = ~(low | high)
        order[a:b] = np.concatenate([own[low], own[same], own[high]])
        x, y = a + int(low.sum()), b - int(high.sum())
        if x > a:
            todo.append((a, x, depth))
        if y < b:
            todo.append((y, b, depth))
        if depth + 1 < len(words) and y - x > 1:
            todo.append((x, y, depth + 1))
    return order


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs: (rid, text). (rid, spans array<struct<start, stop>>): maximal runs of repeated bytes of texts that have any."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = max(10, int(np.ceil(np.log2(max(1, total / PER_RANGE)))))
    found = stored(find_spans(docs, length, bits), "spans")
    asked = found.filter("kind = 1").select("rid", "start", "stop")
    more = compare_suffixes(docs, asked, length)
    both = found.filter("kind = 0").unionByName(more)

    def join(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            inner = lists.flatten()
            start, stop = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            s, e, g = merged(start, stop, np.repeat(np.arange(len(sizes)), sizes))
            offsets = np.searchsorted(g, np.arange(len(sizes) + 1)).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(s), pa.array(e)], names=["start", "stop"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["rid", "spans"])

    return stored(both.groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("x")).mapInArrow(tidy(join), "rid long, spans array<struct<start: long, stop: long>>"), "merged")


def _row_ids(source: DataFrame, id_col: str) -> DataFrame:
    """Adds ``__rid``, a 64-bit name of id and text that different rows never share."""
    out = source
    for turn in range(8):
        rid = F.xxhash64(F.lit(turn), F.col(id_col), "__text")
        out = out.withColumn("__rid", rid if turn == 0 else F.when(F.col("__again"), rid).otherwise(F.col("__rid"))).drop("__again")
        other = F.xxhash64(F.lit("other"), F.col(id_col), "__text")
        shared = out.select("__rid", other.alias("o")).groupBy("__rid").agg(F.min("o").alias("low"), F.max("o").alias("high")).filter("low <> high").select("__rid")
        shared = cut(shared)  # one in 2^65 pairs of rows: a handful even for 10^11 rows
        if not shared.limit(1).count():
            return out
        out = out.join(F.broadcast(shared.withColumn("__again", F.lit(True))), "__rid", "left").withColumn("__again", F.coalesce("__again", F.lit(False)))
    raise RuntimeError("hashes of rows keep colliding")


def deduplicate(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(doc_id, spans, kept binary, n_bytes) of each row: removed runs and the remaining bytes; ``keep`` names columns to carry instead of the id.

    ``as_text``: ``kept`` is a string, without the bytes that a cut has left of a letter.
    """
    bound_batches(docs.sparkSession)
    cols = [c for c in keep or [id_col] if c not in ("spans", "kept", "n_bytes")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = _row_ids(docs.select(*cols, F.col(id_col).alias("__id"), text.alias("__text")), "__id").drop("__id")
    spans_ = repeated_spans(source.select(F.col("__rid").alias("rid"), F.col("__text").alias("text")), length)
    n = spans_.agg(F.sum(F.size("spans")).alias("n")).first().n or 0
    spans_ = spans_.select(F.col("rid").alias("__rid"), F.col("spans").alias("__spans"))
    joined = source.join(F.broadcast(spans_) if n <= BROADCAST_ROWS else spans_, "__rid", "left").select(*cols, "__text", "__spans")
    schema = docs.select(*cols).schema.add("spans", T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))).add("kept", "string" if as_text else "binary").add("n_bytes", "long")

    def run(batches):
        for batch in batches:
            data, at = raw_bytes(batch.column(len(cols)))
            kept = []
            for i, x in enumerate(batch.column(len(cols) + 1).to_pylist()):
                d = data[at[i] : at[i + 1]]
                if x:
                    edges = [0, *(e for s in x for e in (s["start"], s["stop"])), len(d)]
                    d = np.concatenate([d[a:b] for a, b in zip(edges[::2], edges[1::2])])
                kept.append(d.tobytes().decode("utf-8", "ignore") if as_text else d.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], batch.column(len(cols) + 1), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(np.diff(at))], names=[*cols, "spans", "kept", "n_bytes"])

    return joined.mapInArrow(tidy(run), schema)


def digests(docs: DataFrame, length: int = 200, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    out = deduplicate(docs, length, **how).withColumnRenamed(how.get("id_col", "doc_id"), "doc_id")
    n = F.coalesce(F.size("spans"), F.lit(0))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.when(F.col("spans").isNull(), 0).otherwise(n).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
