"""Graphs from adjacency tables: (graph_id, id, sequence, succ_fwd, succ_rev), successors as arrays of (dst, dst_rev).

Each edge is expected from both of its ends, so canonical ones are kept and their twins dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.functions.keys import is_canonical


def tables(adjacency: DataFrame, string_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """segments and canonical edges; with ``string_ids`` nodes are ordered and compared as decimal strings."""
    key = (lambda c: c.cast("string")) if string_ids else (lambda c: c)
    segments = adjacency.select("graph_id", key(F.col("id")).alias("name"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    side = lambda c, rev: F.transform(F.coalesce(c, F.array()), lambda x: F.struct(F.lit(rev).alias("src_rev"), key(x["dst"]).alias("dst"), x["dst_rev"].alias("dst_rev")))
    both = adjacency.select("graph_id", key(F.col("id")).alias("src"), F.explode(F.concat(side("succ_fwd", 0), side("succ_rev", 1))).alias("x")).select("graph_id", "src", "x.*")
    return segments, both.filter(is_canonical(*(F.col(c) for c in ("src", "src_rev", "dst", "dst_rev")))).distinct()


def from_links(segments: DataFrame, links: DataFrame) -> DataFrame:
    """The adjacency table of a graph: every link from both ends."""
    from canongraph.functions.keys import flip

    twin = F.struct(F.col("dst").alias("src"), flip(F.col("dst_rev")).alias("src_rev"), F.col("src").alias("dst"), flip(F.col("src_rev")).alias("dst_rev"))
    ends = links.select("graph_id", F.explode(F.array(F.struct("src", "src_rev", "dst", "dst_rev"), twin)).alias("x")).select("graph_id", "x.*").distinct()
    # nodes and ends meet in one aggregation; a node given twice stays two rows
    rest = [c for c in segments.columns if c not in ("graph_id", "name")]
    nodes = segments.select("graph_id", F.col("name").alias("id"), F.struct(*rest).alias("node"))
    of = lambda rev: F.sort_array(F.collect_list(F.when(F.col("src_rev") == rev, F.struct("dst", "dst_rev"))))
    met = nodes.unionByName(ends.filter("graph_id is not null and src is not null").withColumnRenamed("src", "id"), allowMissingColumns=True).groupBy("graph_id", "id").agg(F.collect_list("node").alias("nodes"), of(0).alias("succ_fwd"), of(1).alias("succ_rev"))
    return met.select("graph_id", "id", F.explode("nodes").alias("node"), "succ_fwd", "succ_rev").select("graph_id", "id", "node.*", "succ_fwd", "succ_rev")
