"""Graphs from GFA text, byte by byte: only the first byte of a line tells its kind, lines end at a line feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canongraph.functions.shared import few, stored
from canongraph.functions.keys import id_error, parse_id, parse_sign, shown


def read_lines(spark: SparkSession, path: str | list[str], numbered: bool = True) -> DataFrame:
    """(graph_id, line_no, value) of GFA files; graph_id is the file's path, line_no counts from 1.

    Without ``numbered`` there is no line_no, and nothing is shuffled. Lines are numbered within the blocks in which Spark
    reads a file, on top of what the blocks before hold (a row for each block).
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("graph_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    if not numbered:
        return raw.select("graph_id", "value")
    before = Window.partitionBy("graph_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("graph_id", "block").agg(F.count("*").alias("n")).select("graph_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("graph_id", "block").orderBy("at"))
    return raw.withColumn("inside", inside).join(blocks, ["graph_id", "block"]).select("graph_id", (F.col("before") + F.col("inside")).alias("line_no"), "value")


def read_offsets(spark: SparkSession, path: str, block_size: int | None = None) -> DataFrame:
    """(graph_id, offset, value) of GFA files by ranges of bytes (see sources.lines); no line is numbered or shuffled."""
    from canongraph.sources.lines import BLOCK, GfaLines

    spark.dataSource.register(GfaLines)
    return spark.read.format("gfa_lines").option("blockSize", block_size or BLOCK).load(path).withColumn("value", F.col("value").cast("string"))


def line_numbers(lines: DataFrame, at: DataFrame) -> DataFrame:
    """at: (graph_id, offset), a row for each graph. Adds ``line_no``: how many of the graph's lines start up to there."""
    wanted = few(at.select("graph_id", F.col("offset").alias("until")))
    counted = lines.select("graph_id", "offset").join(wanted, "graph_id").filter("offset <= until").groupBy("graph_id").agg(F.count("*").alias("line_no"))
    return at.join(counted, "graph_id", "left")


def field(k: int):
    """Field k (from 1) of a tab-separated value, without decoding it."""
    return F.substring_index(F.substring_index("value", "\t", k), "\t", -1)


def parse(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lines: (graph_id, value), and line_no for exact errors. Returns segments, links and errors (graph_id, line_no, message).

    Other record types, further fields and empty lines are skipped.
    """
    if "line_no" not in lines.columns:
        lines = lines.withColumn("line_no", F.lit(None).cast("int"))
    s, e = _records(lines)
    segments = s.filter("fields >= 3").select("graph_id", "name", "sequence")
    links = e.filter("fields >= 5 and src_rev is not null and dst_rev is not null").select("graph_id", "src", "src_rev", "dst", "dst_rev")
    said = _said(F.col("rank"), F.col("line_no"), F.col("message")).alias("message")
    return segments, links, _parse_errors(s, e).select("graph_id", "line_no", said)


def _records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segment and link lines with their number of fields and first fields."""
    tabs = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit("\t"), F.lit("")))
    first = F.substring(F.col("value").cast("binary"), 1, 1)
    rows = lines.filter(F.octet_length("value") > 0).withColumn("fields", tabs + 1)
    of = lambda c: rows.filter(first == F.lit(c).cast("binary"))
    s = of("S").select("graph_id", "line_no", "fields", field(2).alias("name"), field(3).alias("sequence"))
    e = of("L").select("graph_id", "line_no", "fields", field(2).alias("src"), field(3).alias("a"), field(4).alias("dst"), field(5).alias("b"))
    return s, e.withColumn("src_rev", parse_sign(F.col("a"))).withColumn("dst_rev", parse_sign(F.col("b")))


def _parse_errors(s: DataFrame, e: DataFrame) -> DataFrame:
    """(graph_id, line_no, rank, message); rank orders the errors of one line, those below 2 say at which line they are."""
    short = lambda x, n, what: x.filter(f"fields < {n}").select("graph_id", "line_no", F.lit(0).alias("rank"), F.lit(f"not enough fields for a {what}").alias("message"))
    wrong = e.filter("fields >= 5 and (src_rev is null or dst_rev is null)").select("graph_id", "line_no", F.lit(1).alias("rank"), F.concat(F.lit("Invalid orientation: "), shown(F.when(F.col("src_rev").isNull(), F.col("a")).otherwise(F.col("b")))).alias("message"))
    return short(s, 3, "segment").unionByName(short(e, 5, "link")).unionByName(wrong)


def _said(rank, number, message):
    """A message with its line, if it is one that names it."""
    return F.when(rank < 2, F.concat(F.lit("Error parsing GFA line "), F.coalesce(number.cast("string"), F.lit("?")), F.lit(": "), message)).otherwise(message)


def _events(lines: DataFrame, integer: bool) -> DataFrame:
    """(graph_id, line_no, kind, key, name, sequence, rank, message): what the lines say, each read once.

    Kind 0 is a node with its sequence, kind 1 an end of an edge, kind 2 the first error of a line (under a key of its own, so that
    they do not all meet in one place).
    """
    tabs = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit("\t"), F.lit("")))
    letter = F.substring(F.col("value").cast("binary"), 1, 1)
    kind = F.when(letter == F.lit("S").cast("binary"), "S").when(letter == F.lit("L").cast("binary"), "L")
    rows = lines.filter(F.octet_length("value") > 0).select("graph_id", F.col("line_no").cast("long").alias("line_no"), kind.alias("type"), (tabs + 1).alias("fields"), field(2).alias("a"), field(3).alias("b"), field(4).alias("c"), field(5).alias("d")).filter("type is not null")
    rows = rows.withColumn("src_rev", parse_sign(F.col("b"))).withColumn("dst_rev", parse_sign(F.col("d")))
    s, e = F.col("type") == "S", F.col("type") == "L"
    signs = F.col("src_rev").isNotNull() & F.col("dst_rev").isNotNull()
    whole = (s & (F.col("fields") >= 3)) | (e & (F.col("fields") >= 5) & signs)
    said = lambda rank, message: F.struct(F.lit(rank).alias("rank"), message.alias("message"))
    error = F.when(s & (F.col("fields") < 3), said(0, F.lit("not enough fields for a segment"))).when(e & (F.col("fields") < 5), said(0, F.lit("not enough fields for a link")))
    error = error.when(e & ~signs, said(1, F.concat(F.lit("Invalid orientation: "), shown(F.when(F.col("src_rev").isNull(), F.col("b")).otherwise(F.col("d"))))))
    a, c, keys = F.col("a"), F.col("c"), ("a", "c")
    if integer:  # names are looked at where they are read, messages made for the wrong ones only
        rows = rows.withColumn("ka", parse_id(a, 0)).withColumn("kc", F.when(e, parse_id(c, 0)))
        bad = lambda k, least: F.col(k).isNull() | ((F.col(k) == 0) & F.lit(least > 0))
        error = error.when(s & bad("ka", 0), said(2, id_error(a, 0))).when(e & bad("ka", 1), said(2, id_error(a, 1))).when(e & bad("kc", 1), said(3, id_error(c, 1)))
        keys = ("ka", "kc")
    key = lambda k, least: F.when(F.col(k) >= least, F.col(k)) if integer else F.col(k)
    none = F.lit(None).cast("string")
    row = lambda kind, k, name=none, sequence=none, rank=F.lit(None).cast("int"), message=none: F.struct(F.lit(kind).alias("kind"), k.alias("key"), name.alias("name"), sequence.alias("sequence"), rank.alias("rank"), message.alias("message"))
    node = F.when(whole & s & key(keys[0], 0).isNotNull(), row(0, key(keys[0], 0), a, F.col("b")))
    ends = [F.when(whole & e & key(k, 1).isNotNull(), row(1, key(k, 1))) for k in keys]
    own = F.col("line_no").cast("decimal(20,0)" if integer else "string")
    wrong = F.when(F.col("error").isNotNull(), row(2, own, rank=F.col("error.rank"), message=F.col("error.message")))
    rows = rows.withColumn("error", error)
    return rows.select("graph_id", "line_no", F.explode(F.array(node, *ends, wrong)).alias("x")).filter("x is not null").select("graph_id", "line_no", "x.*")


def first_errors(lines: DataFrame, integer: bool = False) -> DataFrame:
    """(graph_id, message): the first error of each text that has one. Lines are (graph_id, line_no or offset, value).

    Errors count in the order of lines; within a line too few fields come before orientations, source and target identifiers
    (``integer``), and a segment that differs from an earlier one of its node. Missing nodes are counted if there is no other error.
    """
    by_offset = "line_no" not in lines.columns
    events = _events(lines.withColumn("line_no", F.col("offset")) if by_offset else lines, integer)
    # a node's rows meet by graph and key: its segments by line, then the ends of edges, so one pass finds second sequences and lost nodes
    of_node = Window.partitionBy("graph_id", "key").orderBy("kind", "line_no", "name")
    seen = events.withColumn("first", F.first(F.struct("kind", "sequence")).over(of_node)).withColumn("k", F.row_number().over(of_node))
    twice = (F.col("kind") == 0) & (F.col("sequence") != F.col("first.sequence"))
    error = F.when(F.col("kind") == 2, F.struct("rank", "message")).when(twice, F.struct(F.lit(4).alias("rank"), F.concat(F.lit("Node "), shown(F.col("name")), F.lit(" already exists with a different sequence")).alias("message")))
    lost = ((F.col("kind") == 1) & (F.col("k") == 1)).cast("long")
    bad = seen.select("graph_id", "line_no", error.alias("x"), lost.alias("lost")).filter("x is not null or lost = 1")
    place = F.when(F.col("x").isNotNull(), F.struct(F.col("line_no").isNull().alias("none"), "line_no", "x.rank", "x.message"))
    first = bad.groupBy("graph_id").agg(F.min(place).alias("x"), F.sum("lost").alias("n"))
    missing = F.struct(F.lit(None).cast("long").alias("line_no"), F.lit(5).alias("rank"), F.concat(F.col("n").cast("string"), F.lit(" nodes required by the edges are missing")).alias("message"))
    first = first.select("graph_id", F.when(F.col("x").isNotNull(), F.struct("x.line_no", "x.rank", "x.message")).otherwise(missing).alias("x")).select("graph_id", "x.*")
    if by_offset:  # only the lines before a first error are counted
        first = stored(first, "first-errors")
        first = line_numbers(lines, first.withColumnRenamed("line_no", "offset"))
    return first.select("graph_id", _said(F.col("rank"), F.col("line_no"), F.col("message")).alias("message"))
