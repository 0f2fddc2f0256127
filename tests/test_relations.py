import random
from collections import deque

from pyspark.sql import functions as F

from canongraph.operators import relations as R
from canongraph.sources import headers as H

RELATIONS = [(0, "A", "B"), (0, "C", "D"), (0, "D", "E"), (1, "B", "C"), (1, "C", "F")]


def frame(spark, rows=RELATIONS):
    return spark.createDataFrame(rows, "kind int, src string, dst string")


def answers(spark, fn, pairs):
    return {(r.src, r.dst): r.answer for r in fn(frame(spark), spark.createDataFrame(pairs, "src string, dst string")).collect()}


def test_reachability(spark):
    sub = answers(spark, R.is_subgraph_of, [("A", "B"), ("C", "E"), ("A", "C"), ("B", "A"), ("A", "A"), ("Z", "Z"), (None, "A"), ("A", None)])
    assert sub == {("A", "B"): True, ("C", "E"): True, ("A", "C"): False, ("B", "A"): False, ("A", "A"): True, ("Z", "Z"): True, (None, "A"): False, ("A", None): False}
    assert all(answers(spark, R.translates_to, [("A", "B"), ("B", "C"), ("A", "C"), ("C", "E"), ("B", "F")]).values())
    assert not any(answers(spark, R.translates_to, [("B", "A"), ("F", "B"), ("E", "C")]).values())


def first_in_first_out(rows, source):
    out, queue = {source: []}, deque([source])
    while queue:
        n = queue.popleft()
        for k, s, d in sorted(set(rows)):
            if s == n and d not in out:
                out[d] = out[n] + [(k, d)]
                queue.append(d)
    return out


def test_paths_are_those_of_a_queue(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.choice("abcdefghij"), rng.choice("abcdefghij")) for _ in range(25)]
    got = {}
    for r in R.shortest_paths(frame(spark, rows), spark.createDataFrame([(c,) for c in "abc"], "source string")).collect():
        got.setdefault(r.source, {})[r.node] = [(x.kind, x.node) for x in r.steps]
    assert got == {c: first_in_first_out(rows, c) for c in "abc"}


def test_targets_bound_the_search(spark):
    rows = [(0, f"n{i}", f"n{i + 1}") for i in range(6)] + [(1, "n0", "n3"), (0, "a", "b")]
    targets = spark.createDataFrame([("n0", "n4"), ("n0", "n0"), ("a", "n1"), ("a", "b")], "source string, node string")
    got = {(r.source, r.node): [(x.kind, x.node) for x in r.steps] for r in R.shortest_paths(frame(spark, rows), targets.select("source"), targets=targets).collect()}
    assert got == {("n0", "n4"): [(1, "n3"), (0, "n4")], ("n0", "n0"): [], ("a", "b"): [(0, "b")]}


def test_name_key(spark):
    names = spark.createDataFrame([("o", "A")], "obj_id string, name string")
    tags = H.to_tags(names, frame(spark).limit(0).withColumn("obj_id", F.lit("o")), name_key="my-name")
    assert [tuple(r) for r in tags.collect()] == [("o", "my-name", "A")]
    assert H.from_tags(tags)[0].first().name is None and H.from_tags(tags, name_key="my-name")[0].first().name == "A"


def test_report(spark):
    pairs = spark.createDataFrame([("A", "D"), ("D", "A"), ("A", "X"), (None, "A")], "src string, dst string")
    got = {(r.src, r.dst): r.report for r in R.describe(frame(spark), pairs, "this", "that").collect()}
    steps = "Graph 1 is a subgraph of graph 2\nGraph 2 translates to graph 3\nGraph 3 is a subgraph of graph 4\n"
    tail = "With graph names:\n1\tA\n2\tB\n3\tC\n4\tD\n"
    assert got["A", "D"] == f"Name 1 is for this\n{steps}Name 4 is for that\n{tail}"
    assert got["D", "A"] == f"Name 1 is for that\n{steps}Name 4 is for this\n{tail}"
    assert got["A", "X"] == "Name 1 is for that\nName 2 is for this\nWith graph names:\n1\tX\n2\tA\n"
    assert got[None, "A"] == "Name 1 is for that\nName 2 is for this\nWith graph names:\n1\tA\n2\t(no name)\n"
    old = R.describe(frame(spark), pairs.limit(1), "this", "that", compat_path_tail=True).first().report
    assert old.endswith("3\tC\n4\tA\n")


def test_tags_and_headers_round_trip(spark):
    names = spark.createDataFrame([("o", "A"), ("p", None)], "obj_id string, name string")
    rel = frame(spark).withColumn("obj_id", F.lit("o")).select("obj_id", "kind", "src", "dst")
    tags = H.to_tags(names, rel)
    assert {(r.key, r.value) for r in tags.collect()} == {("name", "A"), ("subgraph", "A,B;C,D;D,E"), ("translation", "B,C;C,F")}
    n, r, errors = H.from_tags(tags)
    assert R.same_objects(n, r, names.filter("obj_id = 'o'"), rel) and not errors.count()
    for form in ("gfa", "gaf"):
        lines = H.to_header_lines(names, rel, form)
        listed = [x.line for x in lines.orderBy("section", "src", "dst").collect()]
        assert len(listed) == 6 and listed[0] == ("H\tNM:Z:A" if form == "gfa" else "@RN\tA")
        extra = spark.createDataFrame([("o", 1, "H\tVN:Z:1.1"), ("o", 2, "@HD\tVN:Z:1.0")], "obj_id string, line_no int, line string")
        n, r, errors = H.from_header_lines(extra.unionByName(lines.select("obj_id", F.lit(3).alias("line_no"), "line")))
        assert R.same_objects(n, r, names.filter("obj_id = 'o'"), rel) and not errors.count()
    kept = H.set_tags(spark.createDataFrame([("p", "name", "old"), ("p", "source", "x")], "obj_id string, key string, value string"), names.filter("obj_id = 'p'"), rel.limit(0))
    assert [(x.key, x.value) for x in kept.collect()] == [("source", "x")]


def test_malformed(spark):
    tags = spark.createDataFrame([("a", "subgraph", "A,B;"), ("b", "translation", "A,B,C"), ("c", "name", "")], "obj_id string, key string, value string")
    n, r, errors = H.from_tags(tags)
    assert {x.obj_id: x.message for x in errors.collect()} == {"a": "Invalid subgraph relationship: ", "b": "Invalid translation relationship: A,B,C"}
    n, r, _ = H.from_tags(tags, lenient=True)
    assert r.count() == 0 and {x.obj_id: x.name for x in n.collect()} == {"a": None, "b": None, "c": ""}
    lines = {"a": ["H"], "b": ["X\ty"], "c": ["H\tNM:Z:x", "H\tbad"], "d": ["H\tSG:Z:A"], "e": ["@RN\t"], "f": ["@SG\tA"], "g": ["@TL\tA\tB\tC"], "h": ["H\tNM:Z:x\tXX:i:1\tSG:i:A", "@RN\ty", "@ZZ\tq"]}
    rows = [(k, i + 1, x) for k, v in lines.items() for i, x in enumerate(v)]
    n, r, errors = H.from_header_lines(spark.createDataFrame(rows, "obj_id string, line_no int, line string"))
    assert {x.obj_id: x.message for x in errors.collect()} == {"a": "Error parsing header line 1: not enough fields", "b": "Error parsing header line 1: unknown first field X", "c": "Invalid GFA typed field: bad", "d": "Invalid subgraph field: SG:Z:A", "e": "Invalid GAF name header line: @RN\t", "f": "Invalid GAF subgraph header line: @SG\tA", "g": "Invalid GAF translation header line: @TL\tA\tB\tC"}
    assert {x.obj_id: x.name for x in n.collect()}["h"] == "y"


def test_inherited_relations(spark):
    none = frame(spark, []).limit(0)
    b = R.relate("B", "C", 1, none, R.relate("C", "D", 0, frame(spark, [(1, "C", "F")]), frame(spark, [(0, "D", "E")])))
    a = R.relate("A", "B", 0, none, b)
    assert {tuple(r) for r in a.collect()} == set(RELATIONS)
    assert R.relate(None, "B", 0, none, b).count() == 0
