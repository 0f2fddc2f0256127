"""Search over deep and random relations, by sources and by objects, against a first-in first-out search."""

import random
from collections import deque

from canongraph.operators import relations as R

REL = "kind int, src string, dst string"


def fifo(edges, source, kinds=(0, 1)):
    """Steps to all names reachable from ``source``, as a queue over sorted neighbours finds them."""
    out = {}
    for k, a, b in sorted(set(edges)):
        if k in kinds:
            out.setdefault(a, []).append((k, b))
    came, queue = {source: []}, deque([source])
    while queue:
        now = queue.popleft()
        for k, b in out.get(now, []):
            if b not in came:
                came[b] = [*came[now], (k, b)]
                queue.append(b)
    return came


def steps(row):
    return [(x.kind, x.node) for x in row.steps]


def test_a_long_chain_takes_few_jobs(spark):
    n = 10_000
    rows = [(i % 2, f"n{i}", f"n{i + 1}") for i in range(n)] + [(0, "n77", "side"), (1, "side", "n80"), (0, "loop", "pool"), (0, "pool", "loop"), (0, "n5", "n5")]
    table = spark.createDataFrame(rows, REL)
    asked = spark.createDataFrame([("n0", f"n{n}"), ("n3", "n4999"), (f"n{n}", "n0"), ("n0", "n0"), ("n0", "loop"), ("n0", "nowhere")], "source string, node string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "a long chain")
    got = {(r.source, r.node): steps(r) for r in R.shortest_paths(table, asked.select("source"), targets=asked).collect()}
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert set(got) == {("n0", f"n{n}"), ("n3", "n4999"), ("n0", "n0")}
    for (a, b), found in got.items():
        assert found == fifo(rows, a)[b]
    assert jobs < 250, jobs  # a search name by name needs some 30,000


def test_random_relations_equal_a_queue(spark):
    rng = random.Random(5)
    for names, many in ((12, 16), (40, 44)):
        rows = [(rng.randrange(2), f"x{rng.randrange(names)}", f"x{rng.randrange(names)}") for _ in range(many)]
        table = spark.createDataFrame(rows, REL)
        asked = [(f"x{rng.randrange(names)}", f"x{rng.randrange(names)}") for _ in range(25)]
        for kinds in ((0,), (0, 1)):
            want = {(a, b): fifo(rows, a, kinds)[b] for a, b in asked if b in fifo(rows, a, kinds)}
            targets = spark.createDataFrame(asked, "source string, node string")
            got = {(r.source, r.node): steps(r) for r in R.shortest_paths(table, targets.select("source"), kinds, targets).collect()}
            assert got == want
    everything = {(r.source, r.node): steps(r) for r in R.shortest_paths(table, targets.select("source")).collect()}
    assert everything == {(a, b): s for a in {a for a, _ in asked} for b, s in fifo(rows, a).items()}


def test_objects_know_only_their_own(spark):
    rng = random.Random(6)
    own = {f"o{i}": [(rng.randrange(2), f"x{rng.randrange(9)}", f"x{rng.randrange(9)}") for _ in range(rng.randrange(6))] for i in range(14)}
    name = {o: rng.choice([None, *[f"x{i}" for i in range(9)]]) for o in own}
    names = spark.createDataFrame(list(name.items()), "obj_id string, name string")
    table = spark.createDataFrame([(o, *r) for o, rows in own.items() for r in rows], f"obj_id string, {REL}")
    asked = [(a, b) for a in own for b in own if rng.random() < 0.6]
    pairs = spark.createDataFrame(asked, "a string, b string")
    for kinds in ((0,), (0, 1)):
        got = {(r.a, r.b): r.answer for r in R.objects_reachable(names, table, pairs, kinds).collect()}
        want = {(a, b): name[a] is not None and name[b] is not None and name[b] in fifo(own[a] + own[b], name[a], kinds) for a, b in asked}
        assert got == want
    reports = {(r.a, r.b): r.report for r in R.describe_objects(names, table, pairs, "A", "B").collect()}
    assert set(reports) == set(asked)
    for a, b in asked[:4]:
        both = spark.createDataFrame(own[a] + own[b], REL)
        one = R.describe(both, spark.createDataFrame([(name[a], name[b])], "src string, dst string"), "A", "B").first().report
        assert reports[a, b] == one
    same = {(r.a, r.b): r.answer for r in R.same_names(names, pairs).collect()}
    assert same == {(a, b): name[a] is not None and name[a] == name[b] for a, b in asked}
    equal = {(r.a, r.b): r.answer for r in R.equal_objects(names, table, pairs).collect()}
    assert equal == {(a, b): name[a] == name[b] and set(own[a]) == set(own[b]) for a, b in asked}
    grown = {}
    for r in R.relate_objects(names, table, pairs.filter("a = 'o1'"), 1).filter("obj_id = 'o1'").collect():
        grown.setdefault((r.kind, r.src, r.dst), 0)
    want = set(own["o1"])
    for a, b in asked:
        if a == "o1" and name[a] and name[b]:
            want |= {(1, name[a], name[b]), *own[b]}
    assert set(grown) == want
