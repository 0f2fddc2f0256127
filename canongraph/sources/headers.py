"""Names and relations of graphs as tags, GFA header lines and GAF header lines.

Objects are rows: ``graph_names`` (obj_id, name, null if unnamed) and ``relations`` (obj_id, kind, src, dst), kind 0 for
subgraph, 1 for translation. Readers return (graph_names, relations, errors (obj_id, message)). ``name_key`` is the tag that
holds a graph's own name: give the one that the other programs use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tag of a graph's own name, if callers name no other.
NAME_KEY = "name"
#: Fixed values of the formats.
TAG_SUBGRAPH, TAG_TRANSLATION = "subgraph", "translation"
GFA_NAME, GAF_NAME, SUBGRAPH, TRANSLATION = "NM", "RN", "SG", "TL"
WHAT = {0: "subgraph", 1: "translation"}


def _pair(c):
    p = F.split(c, ",")
    return (F.size(p) == 2) & (p[0] != "") & (F.get(p, F.lit(1)) != "")


def from_tags(tags: DataFrame, lenient: bool = False, name_key: str = NAME_KEY):
    """tags: (obj_id, key, value). ``lenient``: an object with any malformed tag becomes empty instead of an error."""
    ids = tags.select("obj_id").distinct()
    named = tags.filter(F.col("key") == name_key).groupBy("obj_id").agg(F.max("value").alias("name"))
    kind = F.when(F.col("key") == TAG_SUBGRAPH, 0).when(F.col("key") == TAG_TRANSLATION, 1)
    rel = tags.withColumn("kind", kind).filter("kind is not null").select("obj_id", "kind", F.posexplode(F.split("value", ";", -1)).alias("at", "rel"))
    bad = rel.filter(~_pair(F.col("rel")))
    errors = bad.groupBy("obj_id").agg(F.min_by(F.concat(F.lit("Invalid "), F.when(F.col("kind") == 0, WHAT[0]).otherwise(WHAT[1]), F.lit(" relationship: "), F.col("rel")), F.struct("kind", "at")).alias("message"))
    relations = rel.filter(_pair(F.col("rel"))).select("obj_id", "kind", F.split("rel", ",")[0].alias("src"), F.split("rel", ",")[1].alias("dst")).distinct()
    if lenient:
        named, relations = named.join(errors, "obj_id", "left_anti"), relations.join(errors, "obj_id", "left_anti")
    return ids.join(named, "obj_id", "left"), relations, errors


def to_tags(graph_names: DataFrame, relations: DataFrame, name_key: str = NAME_KEY) -> DataFrame:
    """(obj_id, key, value); keys without data are absent."""
    name = graph_names.filter("name is not null").select("obj_id", F.lit(name_key).alias("key"), F.col("name").alias("value"))
    key = F.when(F.col("kind") == 0, TAG_SUBGRAPH).otherwise(TAG_TRANSLATION)
    rel = relations.distinct().withColumn("rel", F.concat("src", F.lit(","), "dst")).groupBy("obj_id", "kind").agg(F.expr("listagg(rel, ';') within group (order by src, dst)").alias("value"))
    return name.unionByName(rel.select("obj_id", key.alias("key"), "value"))


def set_tags(tags: DataFrame, graph_names: DataFrame, relations: DataFrame, name_key: str = NAME_KEY) -> DataFrame:
    """Tags with the three keys of the given objects replaced, or removed where there is no data; others stay."""
    own = F.col("key").isin(name_key, TAG_SUBGRAPH, TAG_TRANSLATION)
    mine = graph_names.select("obj_id").distinct().withColumn("mine", F.lit(True))
    kept = tags.join(mine, "obj_id", "left").filter(~own | F.col("mine").isNull()).drop("mine")
    return kept.unionByName(to_tags(graph_names, relations, name_key))


def to_header_lines(graph_names: DataFrame, relations: DataFrame, form: str = "gfa") -> DataFrame:
    """(obj_id, section, src, dst, line) with its sort key: the name (section 0), subgraphs (1), translations (2)."""
    gfa = form == "gfa"
    name = F.concat(F.lit(f"H\t{GFA_NAME}:Z:" if gfa else f"@{GAF_NAME}\t"), "name")
    code = F.when(F.col("kind") == 0, SUBGRAPH).otherwise(TRANSLATION)
    rel = F.concat(F.lit("H\t"), code, F.lit(":Z:"), "src", F.lit(","), "dst") if gfa else F.concat(F.lit("@"), code, F.lit("\t"), "src", F.lit("\t"), "dst")
    a = graph_names.filter("name is not null").select("obj_id", F.lit(0).alias("section"), F.lit("").alias("src"), F.lit("").alias("dst"), name.alias("line"))
    return a.unionByName(relations.distinct().select("obj_id", (F.col("kind") + 1).alias("section"), "src", "dst", rel.alias("line")))


def from_header_lines(lines: DataFrame):
    """lines: (obj_id, line_no, line), H and @XX lines in any mix; the last name wins."""
    f = F.split("line", "\t", -1)
    rows = lines.withColumn("f", f).withColumn("head", F.col("f")[0])
    gaf = (F.octet_length("head") == 3) & F.col("head").startswith("@")
    text = lambda *x: F.concat(*[F.lit(i) if isinstance(i, str) else i for i in x])
    number = F.col("line_no").cast("string")
    top = F.when(F.size("f") < 2, text("Error parsing header line ", number, ": not enough fields")).when((F.col("head") != "H") & ~gaf, text("Error parsing header line ", number, ": unknown first field ", F.col("head")))
    rows = rows.withColumn("message", top)
    # GFA: typed fields
    h = rows.filter("message is null and head = 'H'").select("obj_id", "line_no", F.posexplode(F.slice("f", 2, 1 << 30)).alias("at", "x"))
    b = F.col("x").cast("binary")
    typed = (F.octet_length("x") >= 5) & (F.substring(b, 3, 1) == F.lit(":").cast("binary")) & (F.substring(b, 5, 1) == F.lit(":").cast("binary"))
    z = typed & (F.substring(b, 4, 1) == F.lit("Z").cast("binary"))
    tag, value = F.substring("x", 1, 2), F.substring("x", 6, 1 << 30)
    h = h.withColumn("tag", F.when(z, tag)).withColumn("value", F.when(z, value))
    kind = F.when(F.col("tag") == SUBGRAPH, 0).when(F.col("tag") == TRANSLATION, 1)
    what = F.when(F.col("kind") == 0, WHAT[0]).otherwise(WHAT[1])
    h = h.withColumn("kind", kind).withColumn("message", F.when(~typed, text("Invalid GFA typed field: ", F.col("x"))).when(F.col("kind").isNotNull() & ~_pair(F.col("value")), text("Invalid ", what, " field: ", F.col("x"))))
    names = h.filter(F.col("tag") == GFA_NAME).select("obj_id", "line_no", "at", F.col("value").alias("name"))
    p = F.split("value", ",")
    rel = h.filter("kind is not null and message is null").select("obj_id", "kind", p[0].alias("src"), p[1].alias("dst"))
    bad = h.filter("message is not null").select("obj_id", "line_no", "at", "message")
    # GAF: one item a line
    g = rows.filter("message is null and head <> 'H'").withColumn("tag", F.substring("head", 2, 2)).withColumn("kind", kind)
    full = lambda n: (F.size("f") == n) & F.forall("f", lambda x: x != "")
    g = g.withColumn("message", F.when((F.col("tag") == GAF_NAME) & ~full(2), text("Invalid GAF name header line: ", F.col("line"))).when(F.col("kind").isNotNull() & ~full(3), text("Invalid GAF ", what, " header line: ", F.col("line"))))
    names = names.unionByName(g.filter((F.col("tag") == GAF_NAME) & F.col("message").isNull()).select("obj_id", "line_no", F.lit(0).alias("at"), F.get("f", F.lit(1)).alias("name")))
    rel = rel.unionByName(g.filter("kind is not null and message is null").select("obj_id", "kind", F.get("f", F.lit(1)).alias("src"), F.get("f", F.lit(2)).alias("dst"))).distinct()
    bad = bad.unionByName(rows.filter("message is not null").select("obj_id", "line_no", F.lit(-1).alias("at"), "message")).unionByName(g.filter("message is not null").select("obj_id", "line_no", F.lit(0).alias("at"), "message"))
    name = names.groupBy("obj_id").agg(F.max_by("name", F.struct("line_no", "at")).alias("name"))
    errors = bad.groupBy("obj_id").agg(F.min_by("message", F.struct("line_no", "at")).alias("message"))
    return lines.select("obj_id").distinct().join(name, "obj_id", "left"), rel, errors
