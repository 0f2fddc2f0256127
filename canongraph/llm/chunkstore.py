"""Operator 9. Token-id output: a content-addressed store of chunked id streams with recipes and Merkle manifests.

Method: a rolling hash over the last ``WINDOW`` ids cuts each document's id stream where the hash's low bits are zero,
so equal passages give equal chunks. A chunk's address is the SHA-256 of its bytes; each distinct chunk is stored once.
A document's recipe lists its chunks' addresses and their Merkle root. The manifest is a Merkle tree over the documents'
roots in order: each node is the Merkle root of up to ``FANOUT`` nodes of the level below, up to one node for the store.
Readers hash every chunk, recompute every document's root from the chunks found and every node of the manifest from those.

Layout below one folder, all Parquet (the file format of the store):

``objects/kind=chunk``  address binary, n int, ids binary (little-endian; two bytes an id where all fit, else four)
``recipes``             doc_id, start, n_tokens, position, addresses array<binary>, root binary, in ascending doc_id order
``manifest``            level, number, n_docs, n_tokens, root binary

Nulls and empty texts are documents of the end id alone. A null doc_id comes first; repeated rows and doc_ids keep a recipe
each, and ties go by number of ids and root, so equal input gives an equal store. An empty table makes an empty store.
Further columns are ignored, whatever their names. One document, not more, must fit a task.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canongraph.llm.common import BASE, bound_batches, cut, mix, shuffle_partitions, small, tidy
from canongraph.llm.tokens import encoder

#: Ids under the rolling hash (a power of two); least, usual and most ids of a chunk.
WINDOW, LEAST, USUAL, MOST = 16, 64, 512, 4096
#: Documents, or nodes of the level below, under a node of the manifest.
FANOUT = 1024


def chunk_edges(ids: np.ndarray, edges: np.ndarray) -> list[list[int]]:
    """For each stream ids[edges[i]:edges[i+1]], where its chunks end (from its start). Depends on a stream's ids alone.

    A chunk has LEAST ids at least, but for the last one, and MOST at most.
    """
    cuts = np.zeros(0, np.int64)
    if len(ids) >= WINDOW:
        # the polynomial hash of WINDOW ids, from those of half as many
        h, wide = mix(ids.astype(np.uint64) + np.uint64(BASE)), 1
        while wide < WINDOW:
            ahead = h[wide:]
            h = h[:-wide] * np.uint64(pow(BASE, wide, 1 << 64))
            h += ahead
            wide *= 2
        cuts = np.flatnonzero(h < np.uint64((1 << 64) // USUAL))
        row = np.searchsorted(edges, cuts, "right") - 1
        cuts = cuts[cuts + WINDOW <= edges[row + 1]] + WINDOW  # the window lies in one stream
    bounds = np.searchsorted(cuts, edges, "right").tolist()
    every, edges, out = cuts.tolist(), edges.tolist(), []
    for first, stop, x, y in zip(edges, edges[1:], bounds, bounds[1:]):
        own, last = [], first
        for c in [*every[x:y], stop]:
            while c - last > MOST:
                last += MOST
                own.append(last - first)
            if c - last >= LEAST or c == stop and c > last:
                last = c
                own.append(last - first)
        out.append(own)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is. Leaves and inner nodes are told apart by a first byte."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """crc32 of bytes from (number of bytes, crc32) of their parts."""
    total = 0
    for n, crc in parts:
        zeros = bytes(n)
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc
    return total


_ROW = pa.schema([("kind", pa.string()), ("address", pa.binary()), ("n", pa.int32()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("addresses", pa.list_(pa.binary()))])


def _written(ids: np.ndarray):
    """A function that gives ids[a:b] as they are stored."""
    wide = ids.astype("<u4")
    if not len(ids) or ids.max() < 1 << 16:
        raw = memoryview(ids.astype("<u2").tobytes())
        return lambda a, b: bytes(raw[2 * a : 2 * b])
    return lambda a, b: wide[a:b].astype("<u2" if wide[a:b].max(initial=0) < 1 << 16 else "<u4").tobytes()


def _read(raw: bytes, n: int) -> bytes:
    """A stored chunk of ``n`` ids as little-endian uint32 bytes."""
    return np.frombuffer(raw, "<u2").astype("<u4").tobytes() if len(raw) == 2 * n else raw


def _split(tokenizer: str, end_id: int):
    def run(batches):
        enc, seen, task, number = encoder(tokenizer), set(), TaskContext.get().partitionId(), 0
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for (a, _), ids, edges in enc.encode_column(batch.column(1), end_id):
                chunks, recipes, written = [], [], _written(ids)
                for doc, first, stop, ends in zip(docs[a:], edges.tolist(), edges[1:].tolist(), chunk_edges(ids, edges)):
                    addresses, last = [], first
                    for e in ends:
                        part = written(last, first + e)
                        address = hashlib.sha256(part).digest()
                        addresses.append(address)
                        if address not in seen:  # a task sends each of its chunks once; others may send it too
                            if len(seen) > 100_000:
                                seen.clear()
                            seen.add(address)
                            chunks.append(("chunk", address, first + e - last, part, None, None, None))
                        last = first + e
                    # dealt out by place, so that rows that repeat an id or have none do not meet in one task
                    number += 1
                    recipes.append(("recipe", hashlib.sha256(b"recipe %d %d" % (task, number)).digest(), None, None, doc, stop - first, addresses))
                yield _rows(chunks + recipes)
        enc.forget()

    return run


def _rows(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(_ROW)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROW.types)], schema=_ROW)


def _once(rows: DataFrame) -> DataFrame:
    """Drops chunks that repeat: a task holds all rows of an address, and one sort serves this and the folders by kind."""
    place = F.row_number().over(Window.partitionBy("kind", "address").orderBy("n"))
    return rows.repartition(shuffle_partitions(rows.sparkSession), "address").withColumn("place", place).filter("place = 1").drop("place")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each text, appends ``end_id`` and writes the store to ``path``, a folder that all executors share."""
    spark = docs.sparkSession
    bound_batches(spark)
    types = "kind string, address binary, n int, ids binary, doc_id long, n_tokens long, addresses array<binary>"
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(_split(tokenizer, end_id)), types)
    n = shuffle_partitions(spark)
    # SHA-256 does not compress: lz4 costs less than zstd here
    _once(rows).write.option("compression", "lz4").partitionBy("kind").parquet(f"{path}/objects")

    recipes = _objects(spark, path, "recipe").select("doc_id", "n_tokens", "addresses")

    def roots(batches):
        for b in batches:
            r = [merkle(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.binary())], names=[*b.schema.names, "root"])

    ranged = recipes.mapInArrow(tidy(roots), "doc_id long, n_tokens long, addresses array<binary>, root binary").repartitionByRange(n, "doc_id", "n_tokens", "root").sortWithinPartitions("doc_id", "n_tokens", "root").withColumn("part", F.spark_partition_id())
    ranged.write.option("compression", "lz4").parquet(f"{path}/ranges")
    ranged = spark.read.schema(ranged.schema).parquet(f"{path}/ranges")
    # starts and positions: sums of whole ranges (a row each), then running sums within a range
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    sums = sums.select("part", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_before") for c in ("tokens", "docs")])
    inner = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "root")
    placed = ranged.join(F.broadcast(sums), "part")  # a row for each shuffle partition
    start = F.col("tokens_before") + F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = placed.withColumn("start", start).withColumn("position", F.col("docs_before") + F.row_number().over(inner) - 1)
    placed.select("doc_id", "start", "n_tokens", "position", "addresses", "root").sortWithinPartitions("position").write.option("compression", "lz4").parquet(f"{path}/recipes")
    manifest(_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    types = "address binary, n int, ids binary, doc_id long, n_tokens long, addresses array<binary>, kind string"
    return spark.read.schema(types).parquet(f"{path}/objects").filter(F.col("kind") == kind)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, start long, n_tokens long, position long, addresses array<binary>, root binary").parquet(f"{path}/recipes")


_NODES = "level int, number long, n_docs long, n_tokens long, root binary"


def manifest(roots: DataFrame) -> DataFrame:
    """The Merkle tree over documents (position, n_tokens, root): a row for each node, of FANOUT children at most."""

    def up(nodes: DataFrame, level: int) -> DataFrame:
        child = F.struct("number", "n_docs", "n_tokens", "root")
        own = nodes.groupBy(F.floor(F.col("number") / FANOUT).alias("parent")).agg(F.sort_array(F.collect_list(child)).alias("children"))

        def run(batches):
            for b in batches:
                rows = [(level, p, sum(x["n_docs"] for x in c), sum(x["n_tokens"] for x in c), merkle([x["root"] or b"" for x in c])) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["level", "number", "n_docs", "n_tokens", "root"])

        return cut(own.mapInArrow(tidy(run), _NODES))

    now = up(roots.select(F.col("position").alias("number"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", "root"), 0)
    out, level = now, 0
    while now.count() > 1:
        level += 1
        now = up(now, level)
        out = out.unionByName(now)
    return out


def _stored_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_NODES).parquet(f"{path}/manifest")


def good_blocks(told: DataFrame, again: DataFrame) -> DataFrame:
    """(number) of the lowest nodes of a manifest that match, as do all nodes above them."""
    same = cut(told.select("level", "number", "n_docs", "n_tokens", "root").intersect(again.select("level", "number", "n_docs", "n_tokens", "root")).select("level", "number"))
    good = same.filter("level = 0").select("number")
    for level in range(1, (told.agg(F.max("level")).first()[0] or 0) + 1):
        above = same.filter(F.col("level") == level).select(F.col("number").alias("parent"))
        good = good.join(above, F.floor(F.col("number") / FANOUT ** level) == F.col("parent"), "left_semi")
    return good


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) of each document, from the stored files.

    Every stored chunk is read, hashed and summed once; a document's crc32 is put together from its chunks', so chunks
    are not copied out to each document that holds them. ``verified``: all chunks match their addresses and are there,
    lengths and Merkle root match the recipe, and so do all nodes of the manifest above the document.
    """

    def sums(batches):
        for b in batches:
            a, n, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            ok = [hashlib.sha256(x).digest() == y and len(x) in (2 * k, 4 * k) for x, y, k in zip(ids, a, n)]
            whole = [_read(x, k) for x, k in zip(ids, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in whole], pa.int32()), pa.array([zlib.crc32(x) for x in whole], pa.int64()), pa.array(ok)], names=["address", "n", "crc", "ok"])

    chunks = _objects(spark, path, "chunk").select("address", "n", "ids").mapInArrow(tidy(sums), "address binary, n int, crc long, ok boolean")
    read = cut(_per_document(_recipes(spark, path), chunks, ["crc", "ok"], _digest, "doc_id long, start long, n_tokens long, position long, ids_crc32 long, good boolean, root binary"))
    blocks = good_blocks(_stored_manifest(spark, path), manifest(read)).select(F.col("number").alias("block"), F.lit(True).alias("sound"))
    out = read.withColumn("block", F.floor(F.col("position") / FANOUT)).join(small(blocks), "block", "left")
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", (F.col("good") & F.coalesce("sound", F.lit(False))).alias("verified"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) with each document's ids put together from its chunks (little-endian uint32)."""
    chunks = _objects(spark, path, "chunk").select("address", "n", "ids")
    return _per_document(_recipes(spark, path), chunks, ["ids"], _whole, "doc_id long, start long, n_tokens long, ids binary")


def _per_document(recipes: DataFrame, chunks: DataFrame, values: list[str], make, schema: str) -> DataFrame:
    asked = recipes.select("doc_id", "start", "n_tokens", "position", "root", F.posexplode("addresses").alias("at", "address"))
    joined = asked.join(chunks, "address", "left").groupBy("position", "start", "doc_id", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("at", "address", "n", *values))).alias("parts"))
    return joined.mapInArrow(tidy(make), schema)


def _digest(batches):
    for b in batches:
        position, start, doc, n, root, parts = (c.to_pylist() for c in b.columns)
        crc, good, roots = [], [], []
        for tokens, r, p in zip(n, root, parts):
            there = all(x["n"] is not None for x in p)
            crc.append(crc_joined([(4 * x["n"], x["crc"]) for x in p]) if there else None)
            roots.append(merkle([x["address"] for x in p]))
            good.append(there and all(x["ok"] for x in p) and sum(x["n"] for x in p) == tokens and roots[-1] == r)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(position, pa.int64()), pa.array(crc, pa.int64()), pa.array(good), pa.array(roots, pa.binary())], names=["doc_id", "start", "n_tokens", "position", "ids_crc32", "good", "root"])


def _whole(batches):
    for b in batches:
        _, start, doc, n, _, parts = (c.to_pylist() for c in b.columns)
        ids = [b"".join(_read(x["ids"], x["n"]) for x in p) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def verify(spark: SparkSession, path: str) -> bool:
    """True if every document verifies and the manifest holds nothing else."""
    bad = read_digests(spark, path).filter("not verified").limit(1).count()
    told, again = _stored_manifest(spark, path), manifest(_recipes(spark, path))
    return not bad and not told.exceptAll(again).limit(1).count() and not again.exceptAll(told).limit(1).count()
