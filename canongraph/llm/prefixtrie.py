"""The prefix trie of rebuilt conversations: MSD radix partitioning over dictionary-encoded turns, multikey quicksort in buckets.

Each distinct turn (role, text) gets a number from a dictionary; a conversation is then a row of numbers. Conversations that are
equal throughout are counted together first. The others are split by their next turn, bucket by bucket: a bucket of more than
``local`` turns is a node (or a chain of nodes, if all of it goes on alike) whose rows are dealt out again by the turn that
follows, on Spark; a smaller one goes to one task, where a multikey quicksort on the next turns finishes it and its recursion
emits the nodes. What a bucket finds below it is added to each of the large nodes above it in one aggregation.

A node is named by its depth and the smallest conversation in it. Conversations are ordered by turn (null first; equal turns by
the SHA-256 of role and text), null roles and texts are empty. Rows without a conv_id take no part. Rows that repeat a turn
count as turns of their own. Without any conversation there are no nodes, not even a root. Further columns are ignored. A text
may be of any length: only its number and its words travel. A conversation of a million turns is a row of 12 MB.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.llm.common import bound_batches, cut, shuffle_partitions, small, stored, tidy

#: Turns of a bucket that one task finishes, at most; a single conversation may have more.
LOCAL = 100_000
#: Characters of ids that travel to a hasher as one row.
CHUNK = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): rebuilt conversations as the numbers of their turns, and the words of each turn's text.

    The first h turns come from conversation conv_id - conv_id % 20, the rest from the conversation itself, h = crc32(conv_id) % 4.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    turns = turns.withColumn("print", F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    known = turns.groupBy("print").agg(F.any_value("text").alias("text"))
    known = stored(known.select("print", F.monotonically_increasing_id().alias("id"), F.regexp_count("text", F.lit(WORD)).alias("words")), "turn-dictionary")
    coded = turns.select("conv_id", "turn", "print").join(known, "print")
    own = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "print", "id", "words"))).alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.words").alias("words"))
    own = stored(own, "conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    base = own.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("ids", 1, 3).alias("base_ids"), F.slice("words", 1, 3).alias("base_words"))
    both = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(base, "base", "left")
    rest = lambda c: F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
    first = lambda c, kind: F.slice(F.coalesce(F.col(f"base_{c}"), F.array().cast(f"array<{kind}>")), F.lit(1), F.col("h"))
    return both.select("conv_id", F.concat(first("ids", "long"), rest("ids")).alias("ids"), F.concat(first("words", "int"), rest("words")).alias("words"))


def ends(members: DataFrame) -> DataFrame:
    """members: (print, conv_id). (print, ends): SHA-256 of each group's ids in numerical order, comma-joined.

    Groups that lie within a partition of a range sort are hashed there. Of a group that reaches over its bounds, pieces of
    text go to one hasher each, a bounded number of ids at a time.
    """

    def pieces(batches):
        part, number, now, held, size, opening = TaskContext.get().partitionId(), 0, None, [], 0, True
        for batch in batches:
            rows: list[tuple] = []
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is not None and (key != now or size >= CHUNK):
                    done = key != now and not opening
                    joined = ",".join(held)
                    rows.append((now, part, number, None, hashlib.sha256(joined.encode()).hexdigest()) if done else (now, part, number, joined, None))
                    opening = key == now  # what follows a piece is a piece, and so is a partition's first group
                    number, held, size = number + 1, [], 0
                now = key
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield _rows(rows)
        if held:
            yield _rows([(now, part, number, ",".join(held), None)])

    def hasher(batches):
        now, h, out = None, None, []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if h is not None:
                        out.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
        if h is not None:
            out.append((now, h.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], names=["print", "ends"])

    n = shuffle_partitions(members.sparkSession)
    dealt = members.select("print", "conv_id").repartitionByRange(n, "print", "conv_id").sortWithinPartitions("print", "conv_id")
    got = stored(dealt.mapInArrow(tidy(pieces), "print string, part int, number int, piece string, ends string"), "trie-ends")
    whole = got.filter("piece is not null").select("print", "part", "number", "piece").repartition("print").sortWithinPartitions("print", "part", "number")
    return got.filter("ends is not null").select("print", "ends").unionByName(whole.select("print", "piece").mapInArrow(tidy(hasher), "print string, ends string"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["print", "part", "number", "piece", "ends"])


def grow(seqs: list[np.ndarray], words: list[np.ndarray], n: np.ndarray, low: np.ndarray, ends_: list[str], depth: int, above: int) -> list[list]:
    """Nodes of a bucket: sequences that are distinct and alike in their first ``depth`` turns, which they all have.

    Returns columns: depth, conv_id, parent, n_convs, n_children, n_leaves, saved, ends; parents come before their children, and
    the first row is the bucket's own node, whose parent is ``above``.
    """
    size = np.array([len(x) for x in seqs])
    out: list[list] = [[] for _ in range(8)]
    parent: list[int] = []

    def emit(d: int, rows: np.ndarray, up: int, done: str) -> int:
        one = int(rows[0])
        count = int(n[rows].sum())
        for column, x in zip(out, (d, int(low[rows].min()), out[1][up] if up >= 0 else above, count, 0, 0, (count - 1) * int(words[one][d - 1]) if d else 0, done)):
            column.append(x)
        parent.append(up)
        if up >= 0:
            out[4][up] += 1
        return len(parent) - 1

    stack = [(np.arange(len(seqs)), depth, -1, True)]
    while stack:
        rows, d, up, equal = stack.pop()
        if equal:  # alike in their first d turns: a node, and the rest is sorted by the next turn
            if len(rows) == 1:  # one sequence is a chain
                one = int(rows[0])
                for at in range(d, int(size[one]) + 1):
                    up = emit(at, rows, up, ends_[one] if at == size[one] else NOTHING)
                continue
            last = rows[size[rows] == d]
            up = emit(d, rows, up, ends_[int(last[0])] if len(last) else NOTHING)
            rows = rows[size[rows] > d]
            if not len(rows):
                continue
        turn = np.array([seqs[i][d] for i in rows])
        pivot = turn[len(turn) // 2]
        for part, same in ((turn > pivot, False), (turn == pivot, True), (turn < pivot, False)):
            if part.any():
                stack.append((rows[part], d + 1 if same else d, up, same))
    for i in range(len(parent) - 1, -1, -1):
        if not out[4][i]:
            out[5][i] = 1
        if parent[i] >= 0:
            out[5][parent[i]] += out[5][i]
            out[6][parent[i]] += out[6][i]
    return out


NODE = "depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean, above array<struct<depth: int, conv_id: long>>"


def _finish(buckets: DataFrame) -> DataFrame:
    """Nodes of the small buckets; rows of a bucket share ``bucket``, its depth and the large nodes above it."""

    def run(batches):
        key, held = None, []

        def out():
            first = held[0]
            above = first["above"]
            cols = grow([np.array(x["ids"], np.int64) for x in held], [np.array(x["words"], np.int64) for x in held], np.array([x["n"] for x in held]), np.array([x["low"] for x in held]), [x["ends"] for x in held], first["depth"], above[-1]["conv_id"])
            many = len(cols[0])
            return cols + [[True] + [False] * (many - 1), [above] + [None] * (many - 1)]

        kinds = [pa.int32(), *[pa.int64()] * 6, pa.string(), pa.bool_(), pa.list_(pa.struct([("depth", pa.int32()), ("conv_id", pa.int64())]))]

        def batch_of(ready):
            return pa.RecordBatch.from_arrays([pa.array([x for cols in ready for x in cols[i]], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in NODE.split(", ")[:9]] + ["above"])

        ready, size = [], 0
        for batch in batches:
            for x in batch.to_pylist():
                if held and x["bucket"] != key:
                    ready.append(out())
                    size += len(ready[-1][0])
                    held = []
                    if size >= 50_000:
                        yield batch_of(ready)
                        ready, size = [], 0
                key = x["bucket"]
                held.append(x)
        if held:
            ready.append(out())
        if ready:
            yield batch_of(ready)

    dealt = buckets.repartition(shuffle_partitions(buckets.sparkSession), "depth", "bucket").sortWithinPartitions("depth", "bucket")
    return dealt.select("bucket", "depth", "ids", "words", "n", "low", "ends", "above").mapInArrow(tidy(run), NODE)


def trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    bound_batches(spark)
    # equal conversations are one row from here on
    all_ = stored(rebuilt(conversations).withColumn("print", F.sha2(F.array_join("ids", ","), 256)), "rebuilt")
    same = all_.groupBy("print").agg(F.any_value("ids").alias("ids"), F.any_value("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("low"))
    rows = stored(same.join(ends(all_), "print").drop("print"), "trie-rows")
    place = "struct<depth: int, conv_id: long>"
    left = rows.withColumn("depth", F.lit(0)).withColumn("above", F.array().cast(f"array<{place}>"))
    large, finished = [], []
    while True:
        left = left.withColumn("bucket", F.slice("ids", F.lit(1), F.col("depth")))
        stats = left.groupBy("depth", "bucket").agg(F.sum(F.size("ids") - F.col("depth")).alias("turns"), F.count("*").alias("rows"), F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), F.min("ids").alias("least"), F.max("ids").alias("most"), F.any_value("words").alias("words"), F.any_value("above").alias("above"))
        split = stats.filter((F.col("depth") == 0) | ((F.col("turns") > local) & (F.col("rows") > 1)))
        # all of a bucket goes on alike as far as its least and its greatest row do
        alike = F.coalesce(F.array_position(F.zip_with("least", "most", lambda a, b: F.coalesce(a != b, F.lit(True))), F.lit(True)), F.lit(0))
        until = F.when(alike > 0, alike - 1).otherwise(F.size("least")).cast("int")
        split = stored(split.withColumn("until", until).withColumn("words", F.slice("words", F.lit(1), F.col("until"))).drop("least", "most", "turns", "rows"), "trie-large")
        if not split.limit(1).count():
            finished.append(left)
            break
        large.append(split)
        found = small(split.select("depth", "bucket", F.col("until"), "conv_id"), 100_000)
        met = left.join(found, ["depth", "bucket"], "left")
        if len(large) > 1:  # the first round has the root alone, which is large by itself
            finished.append(met.filter("until is null").drop("until", "conv_id"))
        here = F.struct(F.col("until").alias("depth"), F.col("conv_id")).cast(place)
        inner = met.filter("until is not null").withColumn("above", F.concat("above", F.array(here))).withColumn("stop", F.size("ids") == F.col("until"))
        ended = inner.filter("stop").select(F.col("until").alias("depth"), "conv_id", F.col("ends"))
        large[-1] = (split, stored(ended, "trie-ended"))
        left = stored(inner.filter("not stop").select("ids", "words", "n", "low", "ends", (F.col("until") + 1).alias("depth"), "above"), "trie-left")
    below = [stored(_finish(x.select("bucket", "depth", "ids", "words", "n", "low", "ends", "above")), "trie-nodes") for x in finished]
    nodes = below[0]
    for x in below[1:]:
        nodes = nodes.unionByName(x)
    if not large:
        return _shown(nodes)
    tops = large[0][0]
    ended = large[0][1]
    for x, y in large[1:]:
        tops, ended = tops.unionByName(x), ended.unionByName(y)
    # what each bucket adds to the large nodes above it; the last of them is its parent
    own = F.aggregate(F.slice("words", F.greatest("depth", F.lit(1)), F.col("until") - F.greatest("depth", F.lit(1)) + 1), F.lit(0).cast("long"), lambda a, b: a + b)
    given = nodes.filter("top").select("above", "n_leaves", "saved_tokens").unionByName(tops.select("above", F.lit(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * own).alias("saved_tokens")))
    added = given.select("n_leaves", "saved_tokens", F.size("above").alias("many"), F.posexplode("above").alias("at", "up")).groupBy(F.col("up.depth").alias("until"), F.col("up.conv_id").alias("conv_id")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.sum((F.col("at") == F.col("many") - 1).cast("long")).alias("children"))
    whole = tops.join(added, ["until", "conv_id"], "left").join(ended.select(F.col("depth").alias("until"), "conv_id", "ends"), ["until", "conv_id"], "left")
    chain = whole.withColumn("at", F.explode(F.sequence("depth", "until")))
    bottom = F.col("at") == F.col("until")
    upper = F.when(F.col("at") > F.col("depth"), F.col("conv_id")).when(F.size("above") > 0, F.try_element_at("above", F.lit(-1))["conv_id"])
    since = F.greatest("at", F.lit(1))
    rest = F.aggregate(F.slice("words", since, F.col("until") - since + 1), F.lit(0).cast("long"), lambda a, b: a + b)
    children = F.when(bottom, F.coalesce("children", F.lit(0))).otherwise(1)
    upper_nodes = chain.select(F.col("at").alias("depth"), "conv_id", upper.alias("parent_conv_id"), "n_convs", children.cast("long").alias("n_children"), F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * rest).cast("long").alias("saved_tokens"), F.when(bottom & F.col("ends").isNotNull(), F.col("ends")).otherwise(NOTHING).alias("ends_sha256"))
    return _shown(nodes.select(*upper_nodes.columns).unionByName(upper_nodes))


def _shown(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
