"""Canonical text in its order: places of lines over a whole graph, and files of it.

The lines of all graphs are sorted by range, so a giant graph is sorted by all tasks. A line's place is its place in its range
on top of what the ranges before hold of its graph: a row for each graph and range, never a window over a graph.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canongraph.functions.shared import cut, few, stored
from canongraph.operators.canonical import ORDER

#: Bytes by which lines of a file find the piece of the index they lie in.
STEP = 4096


def _ranged(lines: DataFrame, parts: int | None) -> DataFrame:
    """Lines sorted over all partitions, with the partition and a number that rises along it."""
    n = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(n, "graph_id", *ORDER).sortWithinPartitions("graph_id", *ORDER)
    return dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())


def _held(ranged: DataFrame) -> DataFrame:
    """(graph_id, part, first, n, n_bytes, before, bytes_before): what each range holds of each graph, and those before it."""
    sums = ranged.groupBy("graph_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("n_bytes"))
    before = Window.partitionBy("graph_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    return sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("bytes_before", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))


def placed(lines: DataFrame, parts: int | None = None, large: DataFrame | None = None) -> DataFrame:
    """Adds ``place``, from 1 in each graph, to the lines of any number of graphs of any size.

    ``large`` (graph_id): the graphs that are too long for one task, if the caller knows them. The others are numbered graph by
    graph then, and lines that lie together by graph_id are not shuffled.
    """
    if large is not None:
        large = cut(large)
        numbered = lambda x: x.withColumn("place", F.row_number().over(Window.partitionBy("graph_id").orderBy(*ORDER)).cast("long"))
        if not large.limit(1).count():
            return numbered(lines)
        large = few(large)
        return numbered(lines.join(large, "graph_id", "left_anti")).unionByName(placed(lines.join(large, "graph_id", "left_semi"), parts))
    ranged = stored(_ranged(lines, parts), "ranged")
    held = stored(_held(ranged), "ranges").select("graph_id", "part", "first", "before")
    return ranged.join(held, ["graph_id", "part"]).withColumn("place", F.col("before") + F.col("at") - F.col("first") + 1).drop("part", "at", "first", "before")


def write_text(lines: DataFrame, path: str, parts: int | None = None) -> None:
    """Writes canonical text to ``path``: ``text/`` holds files whose names are in the order of the text, ``index/`` says where graphs are.

    index: (graph_id, part, start, n_bytes, n_lines, bytes_before) - a graph's text is its pieces in the order of ``part``, each
    ``n_bytes`` from ``start`` on in that part's file. Files come from Spark's committer, so tasks may be tried again.
    """
    ranged = _ranged(lines, parts).persist(StorageLevel.DISK_ONLY)
    try:
        # the writer ends lines itself
        ranged.select(F.expr("substring(line, 1, length(line) - 1)").alias("line")).write.option("lineSep", "\n").text(f"{path}/text")
        inside = Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # the graphs of one range
        index = _held(ranged).withColumn("start", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0)))
        index.select("graph_id", "part", "start", "n_bytes", F.col("n").alias("n_lines"), "bytes_before").write.parquet(f"{path}/index")
    finally:
        ranged.unpersist()


def read_graph(spark: SparkSession, path: str, graphs: DataFrame | None = None) -> DataFrame:
    """(graph_id, place, line) of graphs (graph_id; all by default) that write_text() wrote; ``place`` is the byte in the graph's text.

    Files are read by ranges of bytes, and a line finds its graph by the piece of the index that it starts in.
    """
    from canongraph.sources.gfa import read_offsets

    number = F.regexp_extract(F.element_at(F.split("graph_id", "/"), -1), r"^part-(\d+)", 1).cast("int")
    lines = read_offsets(spark, f"{path}/text").select(number.alias("part"), "offset", F.concat("value", F.lit("\n")).alias("line"))
    index = spark.read.parquet(f"{path}/index")
    if graphs is not None:
        index = index.join(few(graphs.select("graph_id").distinct()), "graph_id", "left_semi")
    # pieces and lines meet by the steps of STEP bytes that a piece reaches into, then by the exact bounds
    steps = index.filter("n_bytes > 0").withColumn("step", F.explode(F.sequence(F.expr(f"start div {STEP}"), F.expr(f"(start + n_bytes - 1) div {STEP}"))))
    met = lines.withColumn("step", F.expr(f"offset div {STEP}")).join(steps, ["part", "step"]).filter("offset >= start and offset < start + n_bytes")
    return met.select("graph_id", (F.col("bytes_before") + F.col("offset") - F.col("start")).alias("place"), "line")
