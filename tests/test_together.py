"""Graphs whose rows lie together are named, related and judged without a shuffle of their own."""

import random
import re

import pytest

from canongraph.operators import canonical, containment, digest, ordered
from canongraph.plans import naming
from canongraph.plans.catalogue import QUERIES
from canongraph.sources import gfa

SF = "/root/testdata/sf0.001"


def shuffles(frame):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", frame._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name, most", [("stable_name_str", 2), ("digest_family", 2), ("adjacency_str", 4), ("adjacency_int", 4), ("digest_family_sha256", 2), ("canonical_lines_str", 2), ("canonical_lines_int", 2), ("first_errors_table", 1)])
def test_only_the_tables_are_shuffled(spark, name, most):
    assert shuffles(QUERIES[name](spark, SF)) <= most


def tables(spark):
    rng = random.Random(3)
    s = [(g, str(n) if g % 3 else f"x{n}", rng.choice(["A", "GT"])) for g in range(12) for n in range(1, 2 + g % 5)]
    e = [(g, a, rng.randrange(2), b, rng.randrange(2)) for g in range(12) for a, b in [rng.choices([x[1] for x in s if x[0] == g] + ["9"] * (g == 4), k=2) for _ in range(g % 4)]]
    return spark.createDataFrame(s, "graph_id long, name string, sequence string"), spark.createDataFrame(e, "graph_id long, src string, src_rev int, dst string, dst_rev int")


@pytest.mark.parametrize("which", ["graph_id < 0", "graph_id % 2 = 0", "true"])
def test_known_large_graphs_change_nothing(spark, which):
    s, e = tables(spark)
    large = s.select("graph_id").distinct().filter(which)
    rows = lambda f: sorted(map(repr, f.collect()))
    for mode in ("auto", "integer", "string"):
        assert rows(naming.outcomes(s, e, mode, ["sha256", "sha512_256"], large=large)) == rows(naming.outcomes(s, e, mode, ["sha256", "sha512_256"]))
    lines = canonical.lines(s, canonical.canonical_edges(e))
    assert rows(digest.digests(lines, list(digest.ALGORITHMS), large=large)) == rows(digest.digests(lines, list(digest.ALGORITHMS)))
    assert rows(ordered.placed(lines, large=large).select("graph_id", "line", "place")) == rows(ordered.placed(lines).select("graph_id", "line", "place"))
    assert rows(containment.classes(s, e, large)) == rows(containment.contained(s, e)[1])
    for got, want in zip(containment.contained(s, e, large), containment.contained(s, e)):
        assert rows(got) == rows(want)


def test_first_errors_of_a_line_and_a_node(spark):
    texts = ["S\t1\tA\nS\t1\tA\nS\t1\tC\nL\t1\t+\tx\t?\t*", "L\t7\t+\t8\t+\t*\nL\t7\t+\t8\t-\t*\nS\t7\tA", "S\t2\tA\nL\t2\t+\t0\t+\t*\nL\tq\t+\t0\t+\t*"]
    rows = spark.createDataFrame([(g, i + 1, v) for g, t in enumerate(texts) for i, v in enumerate(t.split("\n"))], "graph_id int, line_no int, value string")
    of = lambda integer: {r.graph_id: r.message for r in gfa.first_errors(rows, integer).collect()}
    assert of(False) == {0: "Node 1 already exists with a different sequence", 1: "1 nodes required by the edges are missing", 2: "2 nodes required by the edges are missing"}
    assert of(True) == {0: "Node 1 already exists with a different sequence", 1: "1 nodes required by the edges are missing", 2: "Node identifier 0 is reserved for technical purposes"}
