"""Stable names of graphs, with the choice of integer or string identifiers, and messages for graphs that get none.

A graph's rows are put together once (canonical.cells), and one aggregation over them gives the verdict on every graph. Graphs
whose names are numbers up to 2**63 - 1 are done then; only the others are read again, as larger numbers or as strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.functions.keys import id_error, parse_id, parse_long, shown
from canongraph.functions.shared import cut, few, stored
from canongraph.operators import canonical
from canongraph.operators.digest import STREAM_FROM, digest_stream, digests, of_text

#: Digits of the SHA-2 kinds of an empty text are computed, not kept: see _empty().
LONG, LARGE, TEXT = "bigint", "decimal(20,0)", "string"


def with_integer_ids(segments: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names parsed as numbers: null where that fails. Zero is a node but no end of an edge."""
    s = segments.withColumn("name", parse_id(F.col("name").cast("string"), 0))
    return s, links.withColumn("src", parse_id(F.col("src").cast("string"))).withColumn("dst", parse_id(F.col("dst").cast("string")))


def _keyed(segments: DataFrame, links: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables under keys of one kind; ``odd`` marks rows that need numbers beyond 2**63 - 1."""
    if key == TEXT:
        return segments.withColumn("name", F.col("name").cast("string")), links.withColumn("src", F.col("src").cast("string")).withColumn("dst", F.col("dst").cast("string"))
    if key == LARGE:
        return with_integer_ids(segments, links)
    name = lambda c: F.col(c).cast("string")
    large = lambda c, least: F.when(parse_long(name(c), least).isNull(), parse_id(name(c), least).isNotNull()).otherwise(False)
    s = segments.select("graph_id", parse_long(name("name"), 0).alias("name"), "sequence", large("name", 0).alias("odd"))
    e = links.select("graph_id", parse_long(name("src"), 1).alias("src"), "src_rev", parse_long(name("dst"), 1).alias("dst"), "dst_rev", (large("src", 1) | large("dst", 1)).alias("odd"))
    return s, e


def _judged(segments: DataFrame, links: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cells and verdicts, each computed once. ``right`` tells whether a graph can be named under these keys."""
    rows = stored(canonical.cells(*_keyed(segments, links, key)), "cells")
    right = (F.col("unread") == 0) & (F.col("conflicts") == 0) & (F.col("missing") == 0)
    return rows, stored(canonical.verdicts(rows).withColumn("right", right), "verdicts")


def _named(rows: DataFrame, found: DataFrame, algorithms: list[str] | None) -> DataFrame:
    """Digests of the graphs that are right."""
    wrong = found.filter("not right").select("graph_id")
    if wrong.limit(1).count():
        rows = rows.join(few(wrong), "graph_id", "left_anti")
    large = found.filter(F.col("right") & (F.col("text_bytes") >= STREAM_FROM)).select("graph_id")
    return digests(canonical.cell_lines(rows), algorithms, large=large)


def _named_at_once(segments: DataFrame, links: DataFrame, key: str, algorithms: list[str] | None, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests of the graphs that are right, and verdicts on all: one aggregation by graph gives both but for the ``large`` ones.

    Only a row for each graph is kept. Nothing is shuffled if a graph's rows lie in one partition.
    """
    rows, algorithms = canonical.cells(*_keyed(segments, links, key)), algorithms or ["sha256"]
    any_large = bool(large.limit(1).count())
    short = rows.join(few(large.withColumn("large", F.lit(True))), "graph_id", "left") if any_large else rows.withColumn("large", F.lit(None).cast("boolean"))
    right = (F.col("unread") == 0) & (F.col("conflicts") == 0) & (F.col("missing") == 0)
    found = canonical.verdicts(short, "large is null").withColumn("right", right)
    found = stored(found.withColumn("names", F.when(F.col("right") & F.col("text").isNotNull(), of_text(F.col("text"), algorithms))).drop("text"), "verdicts")
    named = found.filter("right").select("graph_id", F.explode("names").alias("x")).select("graph_id", "x.algorithm", "x.digest")
    if any_large:
        long_ = found.filter("right and names is null").select("graph_id")
        named = named.unionByName(digest_stream(canonical.cell_lines(rows.join(few(long_), "graph_id", "left_semi")), algorithms))
    return named, found


def _of(table: DataFrame, graphs: DataFrame) -> DataFrame:
    return table.join(few(graphs), "graph_id", "left_semi")


def integer_failures(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id) of graphs that cannot be read with integer identifiers, for whatever reason."""
    return _judged(segments, links, LARGE)[1].filter("not right").select("graph_id")


def _conflict(name):
    return F.concat(F.lit("Node "), shown(name), F.lit(" already exists with a different sequence"))


def _lost(n):
    return F.concat(n.cast("string"), F.lit(" nodes required by the edges are missing"))


def errors(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, message) for string identifiers: the conflict of the smallest node, else the count of missing nodes.

    Tables have no line order; gfa.first_errors() finds the first error of a text.
    """
    return _string_messages(_judged(segments, links, TEXT)[1])


def _string_messages(found: DataFrame) -> DataFrame:
    return found.filter("not right").select("graph_id", F.when(F.col("conflicts") > 0, _conflict(F.col("first_conflict"))).when(F.col("missing") > 0, _lost(F.col("missing"))).otherwise("a name is missing").alias("message"))


def integer_errors(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, message) for integer identifiers: the smallest name that is no number, else the conflict of the smallest node
    (by its number; of its spellings the smallest is named), else the count of missing nodes."""
    s = segments.select("graph_id", F.col("name").cast("string").alias("name"), F.lit(0).alias("least"))
    ends = links.select("graph_id", F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("name"), F.lit(1).alias("least"))
    bad = s.unionByName(ends).withColumn("message", F.when(F.col("least") == 0, id_error(F.col("name"), 0)).otherwise(id_error(F.col("name"), 1))).filter("message is not null")
    bad = bad.groupBy("graph_id").agg(F.min_by("message", F.struct("name", "least")).alias("message")).withColumn("rank", F.lit(0))
    known = segments.select("graph_id", F.col("name").cast("string").alias("raw"), parse_id(F.col("name").cast("string"), 0).alias("key"), "sequence").filter("key is not null")
    twice = known.groupBy("graph_id", "key").agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"), F.min("raw").alias("raw")).filter("a <> b").groupBy("graph_id").agg(F.min_by("raw", "key").alias("raw")).select("graph_id", _conflict(F.col("raw")).alias("message"), F.lit(1).alias("rank"))
    lost = canonical.missing_nodes(*with_integer_ids(segments, links)).filter("name is not null").groupBy("graph_id").agg(F.count("*").alias("n")).select("graph_id", _lost(F.col("n")).alias("message"), F.lit(2).alias("rank"))
    return bad.unionByName(twice).unionByName(lost).groupBy("graph_id").agg(F.min_by("message", "rank").alias("message"))


def _empty(algorithms: list[str] | None):
    """(algorithm, digest) structs of the empty text."""
    import hashlib

    from canongraph.operators.digest import ALGORITHMS

    return F.array(*[F.struct(F.lit(a).alias("algorithm"), F.lit(hashlib.new(ALGORITHMS[a][0]).hexdigest()).alias("digest")) for a in algorithms or ["sha256"]])


def outcomes(segments: DataFrame, links: DataFrame, node_ids: str = "auto", algorithms: list[str] | None = None, graphs: DataFrame | None = None, large: DataFrame | None = None) -> DataFrame:
    """(graph_id, algorithm, digest, message): the names of all graphs, and for each that has none the reason.

    node_ids: integer, string, or auto (integer where it works; the message is that of strings then). ``graphs`` (graph_id): all
    graphs there are; those without segments and links get the name of the empty text. ``large`` (graph_id): the graphs whose text
    may have STREAM_FROM bytes or more, if the caller knows them; the others are read once then.
    """
    if node_ids not in ("auto", "integer", "string"):
        raise ValueError(f"node_ids: {node_ids}")
    named, failed, seen = [], [], []
    large = None if large is None else cut(large)
    left = None  # graphs that still need a reading; None: all
    for key in {"string": [TEXT], "integer": [LONG, LARGE], "auto": [LONG, LARGE, TEXT]}[node_ids]:
        s, e = (segments, links) if left is None else (_of(segments, left), _of(links, left))
        if key == LARGE:  # only graphs that hold larger numbers, and nothing that is no number
            larger = stored(seen[0].filter("odd and not right").select("graph_id"), "larger")
            if not larger.limit(1).count():
                continue
            s, e = _of(segments, larger), _of(links, larger)
        if large is None:
            rows, found = _judged(s, e, key)
            named.append(_named(rows, found, algorithms))
        else:
            names, found = _named_at_once(s, e, key, algorithms, large)
            named.append(names)
        seen.append(found)
        if key == TEXT:
            failed.append(_string_messages(found))
            continue
        if key == LARGE:
            left = left.join(few(found.filter("right").select("graph_id")), "graph_id", "left_anti")
        else:
            left = found.filter("not right").select("graph_id")
        left = stored(left, "left")
        if not left.limit(1).count():
            left = None
            break
    if node_ids == "integer" and left is not None:
        failed.append(integer_errors(_of(segments, left), _of(links, left)))
    none = F.lit(None).cast("string")
    out = [x.select("graph_id", "algorithm", "digest", none.alias("message")) for x in named] + [x.select("graph_id", none.alias("algorithm"), none.alias("digest"), "message") for x in failed]
    if graphs is not None:
        there = seen[0] if left is None or node_ids != "string" else seen[-1]
        bare = graphs.select("graph_id").distinct().join(there.select("graph_id"), "graph_id", "left_anti").select("graph_id", F.explode(_empty(algorithms)).alias("x"))
        out.append(bare.select("graph_id", "x.algorithm", "x.digest", none.alias("message")))
    return reduce(DataFrame.unionByName, out)


def readable(segments: DataFrame, links: DataFrame, node_ids: str = "auto") -> tuple[DataFrame, DataFrame] | None:
    """Cells and verdicts under the first kind of keys that suits all graphs; None if there is none."""
    for key in {"string": [TEXT], "integer": [LONG, LARGE], "auto": [LONG, LARGE, TEXT]}[node_ids]:
        rows, found = _judged(segments, links, key)
        if not found.filter("not right").limit(1).count():
            return rows, found
    return None


def stable_names(segments: DataFrame, links: DataFrame, node_ids: str = "auto", algorithms: list[str] | None = None, large: DataFrame | None = None) -> DataFrame:
    """(graph_id, algorithm, digest) of each valid graph; outcomes() has the others too."""
    return outcomes(segments, links, node_ids, algorithms, large=large).filter("message is null").drop("message")
