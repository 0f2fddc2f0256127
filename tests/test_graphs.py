import hashlib
import random

import pytest
from pyspark.sql import functions as F

from canongraph import cli
from canongraph.operators import canonical, digest
from canongraph.plans import naming
from canongraph.sources import adjacency, gfa
from canongraph.streaming.names import name_files

EXAMPLE = "H\tVN:Z:1.0\nS\t11\tACCTT\nS\t12\tTCAAGG\nS\t13\tCTTGATT\nL\t11\t+\t12\t-\t0M\nL\t12\t-\t13\t+\t0M\nL\t11\t+\t13\t+\t0M\nP\t14\t11+,12-,13+\t0M,0M\n"
NAME = "54b49d18354a34fbd1af9aaac279e1b3ee67b2f68f0ff79f5ebf6c50c8d922a5"


def numbered(spark, texts):
    rows = [(g, i + 1, line) for g, t in texts.items() for i, line in enumerate(t.split("\n")) if line or i < t.count("\n")]
    return spark.createDataFrame(rows, "graph_id string, line_no int, value string")


def read(spark, texts):
    return gfa.parse(numbered(spark, texts))


def names(spark, texts, mode="auto", algorithms=None):
    s, e, _ = read(spark, texts)
    return {(r.graph_id, r.algorithm): r.digest for r in naming.stable_names(s, e, mode, algorithms).collect()}


def plain(text, integer):
    """The canonical text, by hand."""
    key = int if integer else str.encode
    nodes, edges = {}, set()
    for line in text.split("\n"):
        f = line.split("\t")
        if line[:1] == "S":
            nodes[key(f[1])] = f[2]
        elif line[:1] == "L":
            a, x, b, y = key(f[1]), f[2] == "-", key(f[3]), f[4] == "-"
            if not (a < b or (a == b and not (x and y))):
                a, x, b, y = b, not y, a, not x
            edges.add((a, x, b, y))
    show = str if integer else bytes.decode
    out = ""
    for n in sorted(nodes):
        out += f"S\t{show(n)}\t{nodes[n]}\n"
        out += "".join(f"L\t{show(a)}\t{'+-'[x]}\t{show(b)}\t{'+-'[y]}\n" for a, x, b, y in sorted(edges) if a == n)
    return out


def test_published_example(spark):
    got = names(spark, {"g": EXAMPLE}, algorithms=list(digest.ALGORITHMS))
    assert got["g", "sha256"] == NAME
    text = plain(EXAMPLE, True).encode()
    assert {a: got["g", a] for a in digest.ALGORITHMS} == {a: hashlib.new(n, text).hexdigest() for a, (n, _) in digest.ALGORITHMS.items()}
    s, e, _ = read(spark, {"g": EXAMPLE})
    assert canonical.statistics(s, e).collect()[0].asDict() == {"graph_id": "g", "nodes": 3, "edges": 3, "seq_len": 18}


def test_random_graphs_by_all_paths(spark):
    rng = random.Random(11)
    texts = {}
    for g in range(12):
        n = 6
        rows = [f"S\t{i}\t{rng.choice(['GATTACA', 'CT', '', '*'])}" for i in range(1, 2 * n, 2)] + [f"L\t{rng.randrange(1, 2 * n, 2)}\t{rng.choice('+-')}\t{rng.randrange(1, 2 * n, 2)}\t{rng.choice('+-')}\t0M" for _ in range(30)]
        rng.shuffle(rows)
        texts[f"g{g}"] = "\n".join(rows)
    for integer in (True, False):
        want = {(g, "sha256"): hashlib.sha256(plain(t, integer).encode()).hexdigest() for g, t in texts.items()}
        assert names(spark, texts, "integer" if integer else "string") == want
    s, e, _ = read(spark, texts)
    s, e = naming.with_integer_ids(s, e)
    lines = canonical.lines(s, canonical.canonical_edges(e))
    for stream_from in (1, 1 << 30):
        got = {r.graph_id: r.digest for r in digest.digests(lines, ["sha256"], stream_from).collect()}
        assert got == {g: hashlib.sha256(plain(t, True).encode()).hexdigest() for g, t in texts.items()}
    table = adjacency.from_links(s, e)
    got = {r.graph_id: r.digest for r in digest.digests(canonical.lines(*adjacency.tables(table))).collect()}
    assert got == {g: hashlib.sha256(plain(t, True).encode()).hexdigest() for g, t in texts.items()}


@pytest.mark.parametrize(
    "text, mode",
    [("S\t007\tA\nS\t+8\tC\nL\t7\t+\t8\t+\t*", "integer"), ("S\t7\tA\nS\t07\tC", "string"), ("S\tx\tA", "string"), ("S\t0\tA", "integer"), ("S\t0\tA\nL\t0\t+\t0\t+\t*", "string"), ("S\t18446744073709551615\tA", "integer"), ("S\t18446744073709551616\tA", "string"), ("S\t\tA", "string"), ("S\t1\tA\r", "integer"), ("Sfoo\t1\tAC", "integer"), ("L\t1\t+\t1\t-\t*\n\nS\t1\tA\nS\t1\tA", "integer")],
)
def test_auto_mode(spark, text, mode):
    got = names(spark, {"g": text})
    assert got == names(spark, {"g": text}, mode) and len(got) == 1
    if mode == "string":
        assert names(spark, {"g": text}, "integer") == {}
    assert got["g", "sha256"] == hashlib.sha256(plain(text, mode == "integer").encode()).hexdigest()


def test_errors(spark):
    texts = {"a": "S\t1", "b": "S\t1\tA\n\nL\t1\t+\t1\t+", "c": "S\t1\tA\nL\t1\tx\t1\ty\t*", "d": "L\t1\t+\t1", "e": "L\t1\t+\t1\t+\r"}
    got = {r.graph_id: r.message for r in gfa.first_errors(numbered(spark, texts)).collect()}
    assert got == {"a": "Error parsing GFA line 1: not enough fields for a segment", "c": "Error parsing GFA line 2: Invalid orientation: x", "d": "Error parsing GFA line 1: not enough fields for a link", "e": "Error parsing GFA line 1: Invalid orientation: +\r"}
    s, e, _ = read(spark, {"m": "S\t1\tA\nL\t1\t+\t2\t+\t*\nL\t3\t+\t1\t+\t*", "k": "S\tq\tA\nS\tq\tC"})
    assert {r.graph_id: r.message for r in naming.errors(s, e).collect()} == {"m": "2 nodes required by the edges are missing", "k": "Node q already exists with a different sequence"}
    assert naming.stable_names(s, e).count() == 0


def test_first_error_counts(spark):
    node = "Error parsing node name "
    cases = {
        "S\tq\tA\nS\tq\tC\nS\tz": ("Node q already exists with a different sequence", node + "q: invalid digit found in string"),
        "S\tz\nS\t1\tA\nS\t1\tC": ("Error parsing GFA line 1: not enough fields for a segment",) * 2,
        "S\t1\tA\nS\t01\tC\nL\t1\t+\t2\t?\t*": ("Error parsing GFA line 3: Invalid orientation: ?", "Node 01 already exists with a different sequence"),
        "L\tx\t+\t\t+\t*": ("2 nodes required by the edges are missing", node + "x: invalid digit found in string"),
        "S\t1\tA\nL\t1\t+\t\t+\t*": ("1 nodes required by the edges are missing", node + ": cannot parse integer from empty string"),
        "S\t0\tA\nL\t0\t+\t0\t+\t*": (None, "Node identifier 0 is reserved for technical purposes"),
        "S\t18446744073709551616\tA": (None, node + "18446744073709551616: number too large to fit in target type"),
        "S\t+\tA": (None, node + "+: invalid digit found in string"),
        "S\t3\tA\nS\t3\tA\nS\t4\tC": (None, None),
        "L\t5\t+\t6\t+\t*\nL\t5\t-\t6\t-\t*\nS\t6\tA": ("1 nodes required by the edges are missing",) * 2,
    }
    rows = numbered(spark, dict(zip(map(str, range(len(cases))), cases)))
    for integer in (False, True):
        got = {r.graph_id: r.message for r in gfa.first_errors(rows, integer).collect()}
        assert [got.get(str(i)) for i in range(len(cases))] == [x[integer] for x in cases.values()]


def test_line_numbers_over_blocks(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.gfa").write_text("".join(f"S\t{i}\tA\n" if i % 7 else "\n" for i in range(400)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = gfa.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(rows) == 800 and all(r.value == (f"S\t{r.line_no - 1}\tA" if (r.line_no - 1) % 7 else "") for r in rows)


def test_long_texts_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(digest, "CHUNK", 100)
    text = "\n".join(f"S\t{i * 7 % 500}\t{'ACGT' * (i % 5)}" for i in range(500))
    s, e, _ = read(spark, {"g": text, "h": EXAMPLE})
    s, e = naming.with_integer_ids(s, e)
    got = {r.graph_id: r.digest for r in digest.digests(canonical.lines(s, canonical.canonical_edges(e)), None, 10).collect()}
    assert got == {"g": hashlib.sha256(plain(text, True).encode()).hexdigest(), "h": NAME}


def test_self_loops_and_subgraph(spark):
    s, e, _ = read(spark, {"g": "S\t1\tA\nL\t1\t-\t1\t-\t*\nL\t1\t+\t1\t-\t*\nL\t1\t-\t1\t+\t*\nL\t1\t+\t1\t+\t*"})
    assert sorted((r.src_rev, r.dst_rev) for r in canonical.canonical_edges(e).collect()) == [(0, 0), (0, 1), (1, 0)]
    more, links, _ = read(spark, {"h": EXAMPLE})
    assert canonical.is_subgraph(more.filter("name <> '12'"), links.filter("src = '11' and dst = '13'"), more, links)
    assert not canonical.is_subgraph(more, links, more.filter("name <> '12'"), links)


def test_files_command_line_and_stream(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    path = folder / "example.gfa"
    path.write_text(EXAMPLE)
    assert cli.main([str(path)], spark) == 0 and capsys.readouterr().out == f"{NAME}  {path}\n"
    assert cli.main(["-b", str(path)], spark) == 0 and "3 nodes, 3 edges, 18 bp" in capsys.readouterr().err
    assert cli.main([], spark) == 1 and cli.main([str(folder / "none.gfa")], spark) == 1
    bad = tmp_path / "bad.gfa"
    bad.write_text("S\t1\tA\nL\t1\t?\t1\t+\t*\n")
    assert cli.main([str(bad)], spark) == 1 and "line 2: Invalid orientation: ?" in capsys.readouterr().err
    bad.write_text("S\tx\tA\nS\tx\tC\nL\n")
    assert cli.main(["-i", str(bad)], spark) == 1 and capsys.readouterr().err == "Error parsing node name x: invalid digit found in string\n"
    assert cli.main([str(bad)], spark) == 1 and capsys.readouterr().err == "Node x already exists with a different sequence\n"
    query = name_files(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert [r.digest for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [NAME]
    lines = gfa.read_lines(spark, str(path)).orderBy("line_no").select(F.col("value")).collect()
    assert [r.value for r in lines] == EXAMPLE.split("\n")[:-1]
