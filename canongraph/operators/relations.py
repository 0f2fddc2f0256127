"""Relations between named graphs: union, reachability, shortest paths and reports.

``relations``: (kind, src, dst), kind 0 subgraph, 1 translation (further columns such as obj_id are dropped by union()).
Search runs level by level as joins of a frontier with the relations, each level a table in the shared folder; chains are
condensed by pointer doubling first, so depth costs rounds only where paths branch. Objects are asked in bulk, by pairs (a, b).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.functions.shared import few, stored


def union(*relations: DataFrame) -> DataFrame:
    """Distinct relations of several objects; names are not copied."""
    out = None
    for r in relations:
        own = r.select("kind", "src", "dst").filter("src <> '' and dst <> ''")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def relate(name: str | None, parent: str | None, kind: int, own: DataFrame, parents: DataFrame) -> DataFrame:
    """The object's relations after it becomes a subgraph (0) or translation (1) of a parent; only if both have names."""
    if name is None or parent is None:
        return union(own)
    spark = own.sparkSession
    return union(own, parents, spark.createDataFrame([(kind, name, parent)], "kind int, src string, dst string"))


def is_same(a, b):
    """Column: equal names; never for missing ones."""
    return F.coalesce(a == b, F.lit(False))


def same_objects(names_a: DataFrame, relations_a: DataFrame, names_b: DataFrame, relations_b: DataFrame) -> bool:
    """Whether two sets of objects have equal names (missing equal to missing) and relations."""
    cols = ["obj_id", "kind", "src", "dst"]
    pairs = [(names_a.select("obj_id", "name"), names_b.select("obj_id", "name")), (relations_a.select(cols).distinct(), relations_b.select(cols).distinct())]
    return not any(x.exceptAll(y).limit(1).count() or y.exceptAll(x).limit(1).count() for x, y in pairs)


STEP = "struct<kind: int, node: string>"


def _labels(edges: DataFrame, starts: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """edges: (scope, src, kind, first, dst, length); starts: (query, scopes, source); wanted: (query, node). Returns (query, source, node, length, path).

    A path is the (kind, first) of its edges. Among paths of one length the least one counts. Rounds go on while a label gets
    better; a query is not searched beyond the lengths its wanted nodes have reached.
    """
    frontier = stored(starts.select("query", "scopes", "source", F.col("source").alias("node"), F.lit(0).cast("long").alias("length"), F.array().cast(f"array<{STEP}>").alias("path")).distinct(), "labels")
    levels = [frontier]
    while True:
        label = F.struct("length", "path")
        known = reduce(DataFrame.unionByName, levels).groupBy("query", "node").agg(F.min(label).alias("known"))
        if wanted is not None:  # a query whose nodes are all found at some length needs nothing that is as far
            reach = wanted.join(known, ["query", "node"], "left").groupBy("query").agg(F.when(F.count("*") == F.count("known"), F.max("known.length")).alias("most"))
            frontier = frontier.join(reach, "query").filter("most is null or length < most").drop("most")
        ahead = frontier.select("query", "scopes", "source", "node", "length", "path", F.explode("scopes").alias("scope")).withColumnRenamed("length", "so_far")
        step = F.concat("path", F.array(F.struct(F.col("kind").cast("int").alias("kind"), F.col("first").alias("node"))))
        reached = ahead.join(edges.withColumnRenamed("src", "node"), ["scope", "node"]).select("query", "scopes", "source", F.col("dst").alias("node"), F.struct((F.col("so_far") + F.col("length")).alias("length"), step.alias("path")).alias("label"))
        new = reached.groupBy("query", "node").agg(F.min("label").alias("label"), F.first("scopes").alias("scopes"), F.first("source").alias("source"))
        better = new.join(known, ["query", "node"], "left").filter("known is null or label < known")
        frontier = stored(better.select("query", "scopes", "source", "node", "label.length", "label.path"), "labels")
        if not frontier.limit(1).count():
            break
        levels.append(frontier)
    found = reduce(DataFrame.unionByName, levels)
    if len(levels) > 2:  # an early label may have been beaten
        found = found.groupBy("query", "node").agg(F.first("source").alias("source"), F.min(F.struct("length", "path")).alias("x")).select("query", "source", "node", "x.length", "x.path")
    return found.select("query", "source", "node", "length", "path")


def _condensed(edges: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges (scope, src, kind, first, dst, length) in which chains are one edge, and the chains: (first, rest), further steps.

    Inside a chain are nodes with one edge in and one out that are not ``kept`` (node). Each finds the first node of its chain by
    pointer doubling, so a chain of n nodes takes log n rounds. Chains that are closed in themselves lead nowhere and go.
    """
    plain = edges.select("scope", "src", "kind", F.col("dst").alias("first"), "dst", F.lit(1).cast("long").alias("length"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.first("dst").alias("to"), F.first("kind").alias("to_kind"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.first("src").alias("came"), F.first("kind").alias("came_kind"))
    inner = out.join(into, "node").filter("n_out = 1 and n_in = 1 and node <> to").join(few(kept), "node", "left_anti")
    inner = stored(inner.select("node", "to", "to_kind", "came", "came_kind"), "inner")
    n = inner.count()
    if not n:
        return plain, None
    head = inner.select(F.col("node").alias("came"), F.lit(True).alias("inside"))
    jump = stored(inner.join(head, "came", "left").select("node", F.when(F.col("inside"), F.col("came")).otherwise(F.col("node")).alias("at"), F.coalesce("inside", F.lit(False)).cast("long").alias("far"), F.col("inside").isNull().alias("done")), "jump")
    for _ in range(n.bit_length()):
        if not jump.filter("not done").limit(1).count():
            break
        other = jump.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"), F.col("done").alias("ended"))
        jump = stored(jump.join(other, "at").select("node", F.col("next").alias("at"), (F.col("far") + F.col("more")).alias("far"), F.col("ended").alias("done")), "jump")
    placed = jump.filter("done").select("node", F.col("at").alias("head"), "far").join(inner, "node")
    chains = placed.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("far", F.col("came_kind").alias("kind"), "node"))).alias("nodes"), F.max(F.struct("far", "to", "to_kind")).alias("last"), F.min(F.struct("far", "came", "came_kind")).alias("begin"))
    tail = F.array(F.struct(F.col("last.to_kind").cast("int").alias("kind"), F.col("last.to").alias("node")))
    rest = F.concat(F.transform(F.slice("nodes", F.lit(2), F.size("nodes")), lambda x: F.struct(x["kind"].cast("int").alias("kind"), x["node"].alias("node"))), tail)
    chains = stored(chains.select(F.col("head").alias("first"), F.col("begin.came").alias("src"), F.col("begin.came_kind").alias("kind"), F.col("last.to").alias("dst"), (F.size("nodes") + 1).cast("long").alias("length"), rest.alias("rest")), "chains")
    gone = inner.select("node")
    whole = plain.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
    scope = edges.select("scope").limit(1)
    return whole.select("scope", "src", "kind", "first", "dst", "length").unionByName(chains.join(F.broadcast(scope)).select("scope", "src", "kind", "first", "dst", "length")), chains.select("first", "rest")


def _spelled(found: DataFrame, chains: DataFrame | None) -> DataFrame:
    """Paths with the steps inside their chains: (query, source, node, steps)."""
    if chains is None:
        return found.select("query", "source", "node", F.col("path").alias("steps"))
    parts = found.select("query", "source", "node", F.posexplode("path").alias("at", "step")).join(chains, F.col("step.node") == F.col("first"), "left")
    full = F.concat(F.array("step"), F.coalesce("rest", F.array().cast(f"array<{STEP}>")))
    steps = parts.select("query", "source", "node", "at", full.alias("full")).groupBy("query", "source", "node").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "full"))), lambda x: x["full"])).alias("steps"))
    return steps.unionByName(found.filter("length = 0").select("query", "source", "node", F.col("path").alias("steps")))


def shortest_paths(relations: DataFrame, sources: DataFrame, kinds: tuple[int, ...] = (0, 1), targets: DataFrame | None = None) -> DataFrame:
    """(source, node, steps array<struct<kind, node>>) of all nodes reachable from ``sources`` (source), itself included.

    Among shortest paths the least sequence of steps wins (subgraph before translation, then by name), as a first-in
    first-out search over sorted neighbours finds it. With ``targets`` (source, node) only those are returned, a source
    is searched no further than its targets ask for, and chains of names with one way in and out are one step of the search.
    """
    edges = stored(relations.filter(F.col("kind").isin(list(kinds))).select(F.lit(0).alias("scope"), "kind", "src", "dst").distinct(), "relations")
    starts = sources.select(F.col("source").alias("query"), F.array(F.lit(0)).alias("scopes"), "source")
    if targets is None:
        plain = edges.select("scope", "src", "kind", F.col("dst").alias("first"), "dst", F.lit(1).cast("long").alias("length"))
        return _spelled(_labels(plain, starts, None), None).drop("query")
    wanted = stored(targets.select(F.col("source").alias("query"), "node").distinct(), "wanted")
    kept = wanted.select(F.col("query").alias("node")).unionByName(wanted.select("node")).unionByName(sources.select(F.col("source").alias("node"))).distinct()
    steps, chains = _condensed(edges, kept)
    found = _labels(stored(steps, "steps"), starts, wanted).join(wanted, ["query", "node"], "left_semi")
    return _spelled(found, chains).drop("query")


def _pairs_found(relations: DataFrame, pairs: DataFrame, kinds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(source, node, steps) for those of the pairs (src, dst) that have a path."""
    targets = pairs.filter("src is not null and dst is not null").select(F.col("src").alias("source"), F.col("dst").alias("node"))
    return shortest_paths(relations, targets.select("source"), kinds, targets)


def object_paths(names: DataFrame, relations: DataFrame, pairs: DataFrame, kinds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(a, b, steps): paths from the name of object a to that of object b by the relations of those two objects alone.

    names: (obj_id, name), relations: (obj_id, kind, src, dst), pairs: (a, b). Each search walks its two objects' relations where
    they are: nothing is copied for a pair, and what other objects know plays no part.
    """
    edges = relations.filter(F.col("kind").isin(list(kinds))).filter("src <> '' and dst <> ''").select(F.col("obj_id").alias("scope"), "kind", "src", "dst").distinct()
    edges = stored(edges.select("scope", "src", "kind", F.col("dst").alias("first"), "dst", F.lit(1).cast("long").alias("length")), "relations")
    name = lambda c, to: names.filter("name is not null").select(F.col("obj_id").alias(c), F.col("name").alias(to))
    asked = pairs.select("a", "b").distinct().join(name("a", "source"), "a").join(name("b", "node"), "b")
    asked = stored(asked.select(F.struct("a", "b").alias("query"), F.array_distinct(F.array("a", "b")).alias("scopes"), "source", "node"), "asked")
    found = _labels(edges, asked.select("query", "scopes", "source"), asked.select("query", "node"))
    return found.join(asked.select("query", "node"), ["query", "node"], "left_semi").select("query.a", "query.b", F.col("path").alias("steps"))


def objects_reachable(names: DataFrame, relations: DataFrame, pairs: DataFrame, kinds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """pairs: (a, b) of objects. Adds ``answer``: whether a's name leads to b's by what the two know; false without both names."""
    found = object_paths(names, relations, pairs, kinds).select("a", "b", F.lit(True).alias("found"))
    return pairs.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("found", F.lit(False)).alias("answer"))


def describe_objects(names: DataFrame, relations: DataFrame, pairs: DataFrame, first: str, second: str, compat_path_tail: bool = False) -> DataFrame:
    """pairs: (a, b) of objects. Adds ``report`` by the relations of those two (see describe())."""
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    paths = stored(object_paths(names, relations, pairs.select("a", "b").unionByName(turned)), "object-paths")
    name = lambda c, to: names.select(F.col("obj_id").alias(c), F.col("name").alias(to))
    x = pairs.select("a", "b").join(name("a", "src"), "a", "left").join(name("b", "dst"), "b", "left")
    x = x.join(paths.withColumnRenamed("steps", "ahead"), ["a", "b"], "left").join(paths.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("steps").alias("back")), ["a", "b"], "left")
    x = x.withColumnsRenamed({"a": "one_object", "b": "other_object"})
    return _reports(x, first, second, compat_path_tail).select(F.col("one_object").alias("a"), F.col("other_object").alias("b"), "report")


def same_names(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: (a, b) of objects. Adds ``answer``: whether both have names, and the same one."""
    name = lambda c, to: names.select(F.col("obj_id").alias(c), F.col("name").alias(to))
    return pairs.select("a", "b").join(name("a", "x"), "a", "left").join(name("b", "y"), "b", "left").select("a", "b", is_same(F.col("x"), F.col("y")).alias("answer"))


def equal_objects(names: DataFrame, relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: (a, b) of objects. Adds ``answer``: whether their names (missing equal to missing) and all their relations are equal.

    Relations are compared where they meet: as many in common as either has.
    """
    own = stored(relations.select("obj_id", "kind", "src", "dst").distinct(), "own")
    count = own.groupBy("obj_id").agg(F.count("*").alias("n"))
    asked = pairs.select("a", "b").distinct()
    a, b = (own.select(F.col("obj_id").alias(c), "kind", "src", "dst") for c in "ab")
    shared = asked.join(a, "a").join(b, ["b", "kind", "src", "dst"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    name = lambda c, to: names.select(F.col("obj_id").alias(c), F.col("name").alias(to))
    size = lambda c, to: count.select(F.col("obj_id").alias(c), F.col("n").alias(to))
    x = pairs.select("a", "b").join(name("a", "x"), "a", "left").join(name("b", "y"), "b", "left").join(size("a", "n"), "a", "left").join(size("b", "m"), "b", "left").join(shared, ["a", "b"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return x.select("a", "b", (F.col("x").eqNullSafe(F.col("y")) & (zero("n") == zero("m")) & (zero("n") == zero("shared"))).alias("answer"))


def relate_objects(names: DataFrame, relations: DataFrame, pairs: DataFrame, kind: int) -> DataFrame:
    """(obj_id, kind, src, dst): the relations of each object a after it becomes a subgraph (0) or translation (1) of each object b.

    pairs: (a, b). Where both have names, a's relations grow by the one between them and by all of b's, as b's were before.
    """
    name = lambda c, to: names.filter("name is not null").select(F.col("obj_id").alias(c), F.col("name").alias(to))
    both = pairs.select("a", "b").distinct().join(name("a", "src"), "a").join(name("b", "dst"), "b")
    new = both.select(F.col("a").alias("obj_id"), F.lit(kind).alias("kind"), "src", "dst")
    taken = both.select("a", "b").join(relations.select(F.col("obj_id").alias("b"), "kind", "src", "dst"), "b").select(F.col("a").alias("obj_id"), "kind", "src", "dst")
    out = relations.select("obj_id", "kind", "src", "dst").unionByName(new).unionByName(taken)
    return out.filter("src <> '' and dst <> ''").distinct()


def reachable(relations: DataFrame, pairs: DataFrame, kinds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """pairs: (src, dst), either may be null. Adds ``answer``: whether dst is reachable; true for a name itself, false for null."""
    paths = _pairs_found(relations, pairs, kinds).select(F.col("source").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("found"))
    return pairs.join(paths, ["src", "dst"], "left").select("src", "dst", F.coalesce("found", F.lit(False)).alias("answer"))


def is_subgraph_of(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    return reachable(relations, pairs, (0,))


def translates_to(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    return reachable(relations, pairs, (0, 1))


def describe(relations: DataFrame, pairs: DataFrame, first: str, second: str, compat_path_tail: bool = False) -> DataFrame:
    """pairs: (src, dst). Adds ``report``: how the two graphs are related, tried forward, then backward.

    With ``compat_path_tail`` the last name of a path is the first one again, as older tools print it.
    """
    paths = _pairs_found(relations, pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    ahead = paths.select(F.col("source").alias("src"), F.col("node").alias("dst"), F.col("steps").alias("ahead"))
    back = paths.select(F.col("source").alias("dst"), F.col("node").alias("src"), F.col("steps").alias("back"))
    x = pairs.join(ahead, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
    return _reports(x, first, second, compat_path_tail).select("src", "dst", "report")


def _reports(x: DataFrame, first: str, second: str, compat_path_tail: bool) -> DataFrame:
    """Adds ``report`` to names (src, dst) with the paths ``ahead`` and ``back`` between them, null where there is none."""
    forward = F.col("ahead").isNotNull()
    none = F.lit("(no name)")
    x = x.withColumn("steps", F.coalesce("ahead", "back")).withColumn("a", F.coalesce(F.when(forward, F.col("src")).otherwise(F.col("dst")), none)).withColumn("b", F.coalesce(F.when(forward, F.col("dst")).otherwise(F.col("src")), none))
    x = x.withColumn("one", F.when(forward, first).otherwise(second)).withColumn("two", F.when(forward, second).otherwise(first))
    s = lambda c: c.cast("string")
    n = F.size("steps")
    relation = F.transform("steps", lambda e, i: F.concat(F.lit("Graph "), s(i + 1), F.when(e["kind"] == 1, F.lit(" translates to")).otherwise(F.lit(" is a subgraph of")), F.lit(" graph "), s(i + 2), F.lit("\n")))
    tail = lambda e, i: F.when(F.lit(compat_path_tail) & (i == n - 1), F.col("a")).otherwise(e["node"])
    names = F.transform("steps", lambda e, i: F.concat(s(i + 2), F.lit("\t"), tail(e, i), F.lit("\n")))
    describe_ = lambda k, what: F.concat(F.lit("Name "), s(k), F.lit(" is for "), what, F.lit("\n"))
    head = describe_(F.lit(1), F.col("one"))
    known = F.concat(head, F.array_join(relation, ""), describe_(n + 1, F.col("two")), F.lit("With graph names:\n1\t"), F.col("a"), F.lit("\n"), F.array_join(names, ""))
    unknown = F.concat(head, describe_(F.lit(2), F.col("two")), F.lit("With graph names:\n1\t"), F.col("a"), F.lit("\n2\t"), F.col("b"), F.lit("\n"))
    return x.withColumn("report", F.when(F.col("steps").isNotNull(), known).otherwise(unknown))
