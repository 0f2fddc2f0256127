"""Canonical edges, integrity checks, statistics and canonical text of graphs.

Tables: ``segments`` (graph_id, name, sequence) and ``links`` (graph_id, src, src_rev, dst, dst_rev), as
README.md describes them. The key columns may be numbers, strings or binary: only equality and order are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.functions.keys import flip, is_canonical, sign

EDGE = ["graph_id", "src", "src_rev", "dst", "dst_rev"]


def canonical_edges(links: DataFrame) -> DataFrame:
    """Distinct edges in canonical orientation: an edge and its reverse twin are one. One shuffle, after partial distinct."""
    ok = is_canonical(*(F.col(c) for c in EDGE[1:]))
    turned = links.select(
        "graph_id",
        F.when(ok, F.col("src")).otherwise(F.col("dst")).alias("src"),
        F.when(ok, F.col("src_rev")).otherwise(flip(F.col("dst_rev"))).alias("src_rev"),
        F.when(ok, F.col("dst")).otherwise(F.col("src")).alias("dst"),
        F.when(ok, F.col("dst_rev")).otherwise(flip(F.col("src_rev"))).alias("dst_rev"),
    )
    return turned.distinct()


def flipped_links(links: DataFrame) -> DataFrame:
    """Links that are not canonical as they stand."""
    return links.filter(~is_canonical(*(F.col(c) for c in EDGE[1:])))


def distinct_segments(segments: DataFrame) -> DataFrame:
    """A row for each node; equal repeats collapse (see conflicts() for unequal ones)."""
    return segments.groupBy("graph_id", "name").agg(F.min("sequence").alias("sequence"))


def conflicts(segments: DataFrame) -> DataFrame:
    """(graph_id, name) of nodes that are given with different sequences."""
    return segments.groupBy("graph_id", "name").agg(F.min("sequence").alias("a"), F.max("sequence").alias("b")).filter("a <> b").select("graph_id", "name")


def missing_nodes(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, name) of nodes that links need and segments lack."""
    ends = links.select("graph_id", F.col("src").alias("name")).unionByName(links.select("graph_id", F.col("dst").alias("name"))).distinct()
    return ends.join(segments.select("graph_id", "name"), ["graph_id", "name"], "left_anti")


def statistics(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, nodes, edges, seq_len): distinct nodes, canonical edges, bytes of sequence."""
    nodes = distinct_segments(segments).groupBy("graph_id").agg(F.count("*").alias("nodes"), F.sum(F.octet_length("sequence")).alias("seq_len"))
    edges = canonical_edges(links).groupBy("graph_id").agg(F.count("*").alias("edges"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(edges, "graph_id", "full").select("graph_id", zero("nodes"), zero("edges"), zero("seq_len"))


def lines(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Canonical text with its sort key: (graph_id, node, kind, src_rev, dst, dst_rev, line); lines end in a line feed.

    A node's segment line (kind 0) comes before its edges (kind 1). A union, not a join: edges already sit at their node.
    """
    text = lambda c: F.col(c).cast("string")
    key = edges.schema["dst"].dataType
    s = distinct_segments(segments).select("graph_id", F.col("name").alias("node"), F.lit(0).alias("kind"), F.lit(0).alias("src_rev"), F.lit(None).cast(key).alias("dst"), F.lit(0).alias("dst_rev"), F.concat(F.lit("S\t"), text("name"), F.lit("\t"), text("sequence"), F.lit("\n")).alias("line"))
    e = edges.select("graph_id", F.col("src").alias("node"), F.lit(1).alias("kind"), "src_rev", "dst", "dst_rev", F.concat(F.lit("L\t"), text("src"), F.lit("\t"), sign(F.col("src_rev")), F.lit("\t"), text("dst"), F.lit("\t"), sign(F.col("dst_rev")), F.lit("\n")).alias("line"))
    return s.unionByName(e)


ORDER = ["node", "kind", "src_rev", "dst", "dst_rev"]


def cells(segments: DataFrame, links: DataFrame) -> DataFrame:
    """What a graph consists of, in one shuffle: (graph_id, node, kind, src_rev, dst, dst_rev, least, most, odd).

    Kind 0 is a node with the least and the greatest sequence given for it, kind 1 a canonical edge at its source, kind 2 a node
    that an edge ends at. Names that could not be read are null; ``odd`` marks rows that say so (a column of the inputs).
    """
    key = segments.schema["name"].dataType
    none, zero = F.lit(None).cast(key), F.lit(0)
    odd = lambda t: F.col("odd") if "odd" in t.columns else F.lit(False)
    sequence = F.coalesce(F.col("sequence").cast("string"), F.lit(""))
    s = segments.select("graph_id", F.col("name").alias("node"), F.lit(0).alias("kind"), zero.alias("src_rev"), none.alias("dst"), zero.alias("dst_rev"), sequence.alias("sequence"), odd(segments).alias("odd"))
    ok = is_canonical(*(F.col(c) for c in EDGE[1:]))
    turned = F.when(ok, F.struct("src", "src_rev", "dst", "dst_rev")).otherwise(F.struct(F.col("dst").alias("src"), flip(F.col("dst_rev")).alias("src_rev"), F.col("src").alias("dst"), flip(F.col("src_rev")).alias("dst_rev")))
    edge = F.struct(F.col("t.src").alias("node"), F.lit(1).alias("kind"), F.col("t.src_rev").alias("src_rev"), F.col("t.dst").alias("dst"), F.col("t.dst_rev").alias("dst_rev"))
    end = F.struct(F.col("t.dst").alias("node"), F.lit(2).alias("kind"), zero.alias("src_rev"), none.alias("dst"), zero.alias("dst_rev"))
    e = links.select("graph_id", turned.alias("t"), odd(links).alias("odd")).select("graph_id", F.explode(F.array(edge, end)).alias("x"), "odd").select("graph_id", "x.*", F.lit(None).cast("string").alias("sequence"), "odd")
    keys = ["graph_id", *ORDER]
    return s.unionByName(e).groupBy(*keys).agg(F.min("sequence").alias("least"), F.max("sequence").alias("most"), F.max("odd").alias("odd"))


def cell_lines(rows: DataFrame) -> DataFrame:
    """Canonical text of cells(), as lines() gives it."""
    return rows.filter("kind < 2").select("graph_id", *ORDER, _line().alias("line"))


def _line():
    text = lambda c: F.col(c).cast("string")
    return F.when(F.col("kind") == 0, F.concat(F.lit("S\t"), text("node"), F.lit("\t"), "least", F.lit("\n"))).otherwise(F.concat(F.lit("L\t"), text("node"), F.lit("\t"), sign(F.col("src_rev")), F.lit("\t"), text("dst"), F.lit("\t"), sign(F.col("dst_rev")), F.lit("\n")))


def verdicts(rows: DataFrame, shown: str | None = None) -> DataFrame:
    """One row for each graph of cells(): what is wrong with it, and its statistics. ``shown``: a condition on rows whose canonical
    text is returned too, as ``text``; it must fit one value for each graph.

    (graph_id, unread, odd, conflicts, first_conflict, missing, nodes, edges, seq_len, text_bytes): nodes with a null name (as 0 or
    1), conflicting nodes and the least of them, nodes that edges need and segments lack, bytes of canonical text.
    """
    size = lambda c: F.octet_length(F.col(c).cast("string"))
    bytes_ = F.when(F.col("kind") == 0, size("node") + F.octet_length("least") + 4).when(F.col("kind") == 1, size("node") + size("dst") + 8).otherwise(0)
    is_ = lambda k: (F.col("kind") == k).cast("long")
    unread = F.col("node").isNull() | ((F.col("kind") == 1) & F.col("dst").isNull())
    listed = lambda c, order: F.expr(f"listagg({c}, '') within group (order by {order})").alias("text")
    if shown:
        rows = rows.withColumn("line", F.when((F.col("kind") < 2) & F.expr(shown), _line()))
    per_node = rows.groupBy("graph_id", "node").agg(
        F.max(unread.cast("int")).alias("unread"), F.max("odd").alias("odd"), F.max((F.col("kind") == 0).cast("int")).alias("there"), F.max((F.col("least") != F.col("most")).cast("int")).alias("unlike"),
        F.sum(is_(1)).alias("edges"), F.max(F.when(F.col("kind") == 0, F.octet_length("least"))).alias("seq_len"), F.sum(bytes_.cast("long")).alias("text_bytes"),
        *([listed("line", "kind, src_rev, dst, dst_rev")] if shown else []),
    )
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    unlike = F.coalesce(F.col("unlike"), F.lit(0)) == 1
    return per_node.groupBy("graph_id").agg(
        F.max("unread").alias("unread"), F.max("odd").alias("odd"), count(unlike).alias("conflicts"), F.min(F.when(unlike, F.col("node"))).alias("first_conflict"), count((F.col("there") == 0) & F.col("node").isNotNull()).alias("missing"),
        count(F.col("there")).alias("nodes"), count(F.col("edges")).alias("edges"), count(F.col("seq_len")).alias("seq_len"), F.sum(F.coalesce("text_bytes", F.lit(0))).alias("text_bytes"),
        *([listed("text", "node")] if shown else []),
    )


def is_subgraph(segments_a: DataFrame, links_a: DataFrame, segments_b: DataFrame, links_b: DataFrame) -> bool:
    """Extension: whether all nodes (with sequences) and edges of one graph are in another, checked on the content."""
    nodes = segments_a.select("name", "sequence").distinct().join(segments_b.select("name", "sequence"), ["name", "sequence"], "left_anti").limit(1).count()
    edges = canonical_edges(links_a).join(canonical_edges(links_b), EDGE[1:], "left_anti").limit(1).count()
    return not nodes and not edges
