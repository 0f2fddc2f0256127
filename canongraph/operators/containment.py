"""Extension: which graphs lie whole within which others, for all graphs at once, checked on their content.

A graph's elements are the lines of its canonical text: a node with its sequence, an edge. Graphs of equal content are one class,
shown by their smallest id. A class can only lie within classes that hold its rarest element, which gives the candidates; those
are verified by counting shared elements. Nothing compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.functions.shared import cut, few, stored
from canongraph.operators.canonical import cell_lines, cells
from canongraph.operators.digest import STREAM_FROM, digest_stream, texts


def _elements(segments: DataFrame, links: DataFrame, large: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(graph_id, digest, text) of each graph, kept once, and the lines of the ``large`` ones, whose text is null (None: there are none)."""
    lines = cell_lines(cells(segments, links))
    if large is None:
        lines = stored(lines, "elements")
        large = lines.groupBy("graph_id").agg(F.sum(F.octet_length("line")).alias("n")).filter(F.col("n") >= STREAM_FROM).select("graph_id")
    large, long_ = cut(large), None
    if large.limit(1).count():
        large = few(large)
        long_, lines = stored(lines.join(large, "graph_id", "left_semi"), "long"), lines.join(large, "graph_id", "left_anti")
    out = texts(lines).select("graph_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    if long_ is not None:
        out = out.unionByName(digest_stream(long_, ["sha256"]).select("graph_id", F.unhex("digest").alias("digest"), F.lit(None).cast("string").alias("text")))
    return out, long_


def _members(names: DataFrame) -> DataFrame:
    """(graph_id, class_id): only classes of several graphs are looked up."""
    several = stored(names.groupBy("digest").agg(F.min("graph_id").alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k"), "copies")
    return names.join(few(several), "digest", "left").select("graph_id", F.coalesce("first", "graph_id").alias("class_id"))


def classes(segments: DataFrame, links: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """(graph_id, class_id): the smallest id of the graphs with the same content. ``large``: see contained()."""
    return _members(stored(_elements(segments, links, large)[0].select("graph_id", "digest"), "names"))


def contained(segments: DataFrame, links: DataFrame, large: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph_id, within) for classes of graphs, and (graph_id, class_id) for all graphs.

    A class is no part of itself; graphs without any line are none of this. Copies add no pairs. ``large`` (graph_id): the graphs
    whose text may have STREAM_FROM bytes or more, if the caller knows them. The texts of the others are kept a row each.
    """
    texts_, long_ = _elements(segments, links, large)
    texts_ = stored(texts_, "texts")
    members = stored(_members(texts_.select("graph_id", "digest")), "classes")
    copies = members.filter("graph_id <> class_id").select("graph_id")
    first = texts_.join(few(copies), "graph_id", "left_anti")
    line = F.filter(F.split("text", "\n"), lambda x: x != "")
    split = lambda t: t.filter("text is not null").select("graph_id", F.size(line).cast("long").alias("n"), F.explode(line).alias("line"))
    own, long_own = split(first), None
    if long_ is not None:
        held = long_.join(few(first.filter("text is null").select("graph_id")), "graph_id", "left_semi")
        n = held.groupBy("graph_id").agg(F.count("*").alias("n"))
        long_own = held.join(few(n), "graph_id").select("graph_id", "n", F.expr("substring(line, 1, length(line) - 1)").alias("line"))
        own = own.unionByName(long_own)
    # a line that only one graph holds says that this one lies in no other; lines are counted by their hashes, so too often at worst.
    # Edges do for graphs that have any, and graphs of one line have no choice; segments are counted if other graphs need them
    edge = F.col("line").startswith("L\t")
    need = long_ is not None or first.filter((F.size(line) > 1) & ~F.concat(F.lit("\n"), "text").contains("\nL\t")).limit(1).count()
    counted = (own if need else own.filter(edge)).select("graph_id", F.xxhash64("line").alias("h")).groupBy("h").agg(F.count("*").alias("df"), F.min("graph_id").alias("graph_id"))
    counted = stored(counted.select("df", F.when(F.col("df") > 1, F.col("h")).alias("h"), F.when(F.col("df") == 1, F.col("graph_id")).alias("graph_id")), "line-counts")
    alone, df = counted.filter("df = 1").select("graph_id").distinct(), counted.filter("df > 1").select("h", "df")
    maybe = stored(first.select("graph_id").join(alone, "graph_id", "left_anti"), "maybe")
    asked = split(first.join(few(maybe), "graph_id", "left_semi"))  # whole texts meet the graphs asked for, not their lines
    if long_own is not None:
        asked = asked.unionByName(long_own.join(few(maybe), "graph_id", "left_semi"))
    asked = stored(asked.withColumn("h", F.xxhash64("line")), "asked")
    least = asked.join(few(df), "h", "left").groupBy("graph_id").agg(F.min_by(F.struct("line", "n"), F.struct(F.col("df").isNull(), "df", "line")).alias("x")).select("graph_id", "x.*")
    held = own.select(F.col("graph_id").alias("within"), "line", F.col("n").alias("m"))
    pairs = least.join(held, "line").filter("n < m and graph_id <> within").select("graph_id", "within", "n")
    if not asked.filter("n > 1").limit(1).count():
        return pairs.select("graph_id", "within"), members
    pairs = stored(pairs, "pairs")
    # a graph of one line is settled by it
    more = pairs.filter("n > 1").join(asked.select("graph_id", "line"), "graph_id").join(held.drop("m"), ["within", "line"])
    whole = more.groupBy("graph_id", "within", "n").agg(F.count("*").alias("shared")).filter("shared = n")
    return pairs.filter("n = 1").unionByName(whole.drop("shared")).select("graph_id", "within"), members
