"""Digests over canonical text: the stable names of graphs.

SHA-2 cannot be put together from partial digests. Many small graphs are aggregated in Catalyst (``listagg`` and
``sha2``), without a shuffle if a graph's lines lie in one partition. The text of graphs that is longer than ``stream_from`` bytes is sorted by range, so one giant graph is sorted by
all tasks; its sorted text then goes to one task a graph in chunks, which streams them through the hashers.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canongraph.functions.shared import cut, few, stored
from canongraph.operators.canonical import ORDER

#: Name here, name in hashlib, bits for Spark's sha2 (None: hashlib only).
ALGORITHMS = {"sha224": ("sha224", 224), "sha256": ("sha256", 256), "sha384": ("sha384", 384), "sha512": ("sha512", 512), "sha512_224": ("sha512_224", None), "sha512_256": ("sha512_256", None)}
#: Bytes of text from which a graph is hashed as a stream.
STREAM_FROM = 64 << 20
#: Bytes of sorted text that travel to a hasher as one row.
CHUNK = 1 << 20


def of_text(text: Column, algorithms: list[str]) -> Column:
    """(algorithm, digest) structs of a text. The two kinds that Spark lacks are hashed in Python, as bytes."""

    def one(a):
        name, bits = ALGORITHMS[a]
        if bits:
            return F.sha2(text, bits)
        return F.pandas_udf(lambda s: s.map(lambda t: t if t is None else hashlib.new(name, t).hexdigest()), "string")(text.cast("binary"))

    return F.array(*[F.struct(F.lit(a).alias("algorithm"), one(a).alias("digest")) for a in algorithms])


def texts(lines: DataFrame) -> DataFrame:
    """(graph_id, text): whole canonical texts, each of which must fit one value."""
    return lines.select("graph_id", "line", *[F.col(c) for c in ORDER]).groupBy("graph_id").agg(F.expr(f"listagg(line, '') within group (order by {', '.join(ORDER)})").alias("text"))


def digest_small(lines: DataFrame, algorithms: list[str]) -> DataFrame:
    """(graph_id, algorithm, digest): a graph's text must fit one value."""
    return texts(lines).select("graph_id", F.explode(of_text(F.col("text"), algorithms)).alias("x")).select("graph_id", "x.algorithm", "x.digest")


def digest_stream(lines: DataFrame, algorithms: list[str]) -> DataFrame:
    """The same by range-sorted text in chunks: one graph's chunks in one task, one chunk in memory, all algorithms in one pass."""
    kind = lines.schema["graph_id"].dataType.simpleString()

    def chunks(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, held, size = [], [], 0
            for i, (graph, line) in enumerate(zip(ids, text)):
                held.append(line)
                size += len(line)
                if size >= CHUNK or i + 1 == len(ids) or ids[i + 1] != graph:
                    rows.append((graph, part, number, b"".join(held)))
                    number, held, size = number + 1, [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.binary()))], names=["graph_id", "part", "number", "chunk"])

    def hasher(batches):
        now, hashes, started, out = None, [], False, []
        for batch in batches:
            for graph, chunk in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not started or graph != now:
                    out += [(now, a, h.hexdigest()) for a, h in zip(algorithms, hashes)]
                    now, started = graph, True
                    hashes = [hashlib.new(ALGORITHMS[a][0]) for a in algorithms]
                data = chunk.as_buffer()
                for h in hashes:
                    h.update(data)
            if out:
                yield _batch(out, batch.schema.field(0).type)
                out = []
        if started:
            yield _batch([(now, a, h.hexdigest()) for a, h in zip(algorithms, hashes)], batch.schema.field(0).type)

    # partitions of a range sort are in order, so (part, number) places a chunk
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.select("graph_id", *ORDER, F.col("line").cast("binary").alias("line")).repartitionByRange(n, "graph_id", *ORDER).sortWithinPartitions("graph_id", *ORDER)
    sorted_ = ordered.select("graph_id", "line").mapInArrow(chunks, f"graph_id {kind}, part int, number long, chunk binary")
    placed = sorted_.repartition("graph_id").sortWithinPartitions("graph_id", "part", "number")
    return placed.select("graph_id", "chunk").mapInArrow(hasher, f"graph_id {kind}, algorithm string, digest string")


def _batch(rows, kind):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.string(), pa.string()))], names=["graph_id", "algorithm", "digest"])


def digests(lines: DataFrame, algorithms: list[str] | None = None, stream_from: int = STREAM_FROM, large: DataFrame | None = None) -> DataFrame:
    """(graph_id, algorithm, digest) of each graph, by its size.

    ``large``: the graphs (graph_id) of ``stream_from`` bytes of text or more, if the caller knows them: then the lines are read
    once, and those that lie together by graph_id are not shuffled. Otherwise the lines are
    computed once, kept as compressed Parquet in the shared folder, and measured.
    """
    algorithms = algorithms or ["sha256"]
    if large is None:
        lines = stored(lines, "lines")
        large = lines.groupBy("graph_id").agg(F.sum(F.octet_length("line")).alias("n")).filter(F.col("n") >= stream_from).select("graph_id")
    large = cut(large)
    if not large.limit(1).count():
        return digest_small(lines, algorithms)
    large = few(large)
    return digest_stream(lines.join(large, "graph_id", "left_semi"), algorithms).unionByName(digest_small(lines.join(large, "graph_id", "left_anti"), algorithms))
