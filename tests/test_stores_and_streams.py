"""Ordered text, byte ranges, tags written back, graphs in pieces, outcomes and containment."""

import hashlib
import os
import random
from pathlib import Path
from threading import Thread

import pytest
from pyspark.sql import functions as F

from canongraph import cli
from canongraph.functions import shared
from canongraph.operators import canonical, containment, digest, ordered
from canongraph.plans import naming
from canongraph.sources import gfa, headers, tagstore
from canongraph.streaming.pieces import name_pieces
from tests.test_graphs import EXAMPLE, NAME, numbered, plain, read


def random_text(rng, n=8):
    rows = [f"S\t{i}\t{rng.choice(['GATTACA', 'CT', '', '*'])}" for i in range(1, n)] + [f"L\t{rng.randrange(1, n)}\t{rng.choice('+-')}\t{rng.randrange(1, n)}\t{rng.choice('+-')}\t0M" for _ in range(2 * n)]
    rng.shuffle(rows)
    return "\n".join(rows)


def test_places_and_files_of_text(spark, tmp_path):
    rng = random.Random(2)
    texts = {f"g{i}": random_text(rng, rng.choice([2, 5, 60])) for i in range(9)}
    s, e, _ = read(spark, texts)
    s, e = naming.with_integer_ids(s, e)
    lines = canonical.lines(s, canonical.canonical_edges(e))
    want = {g: plain(t, True) for g, t in texts.items()}
    for parts in (1, 3, 17):
        got = {}
        for r in ordered.placed(lines, parts).collect():
            got.setdefault(r.graph_id, {})[r.place] = r.line
        assert {g: "".join(x[i] for i in range(1, len(x) + 1)) for g, x in got.items()} == want
        path = str(tmp_path / f"text{parts}")
        ordered.write_text(lines, path, parts)
        files = sorted(f for f in os.listdir(f"{path}/text") if f.startswith("part-"))
        whole = "".join(open(f"{path}/text/{f}").read() for f in files)
        assert whole == "".join(want[g] for g in sorted(want))
        back = ordered.read_graph(spark, path).orderBy("graph_id", "place").collect()
        assert {g: "".join(r.line for r in back if r.graph_id == g) for g in want} == want
        one = ordered.read_graph(spark, path, spark.createDataFrame([("g3",)], "graph_id string")).orderBy("place").collect()
        assert "".join(r.line for r in one) == want["g3"]


def test_lines_by_byte_ranges(spark, tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "in"
    folder.mkdir()
    kinds = {"crlf": b"S\t1\tA\r\nS\t2\tC\r\nL\t1\t+\t2\t+\r\n", "open": b"S\t1\tA\nL\t1\t+\t1\t-\t*", "empty": b"", "feeds": b"\n\nS\t1\tA\n\n", "bytes": b"S\tn\xff\xfe\tAC\nL\tn\xff\xfe\t+\tn\xff\xfe\t?\t*\n", "long": b"S\t1\t" + b"ACGT" * 4000 + b"\nS\t2\tC\nS\t3"}
    for name, data in kinds.items():
        (folder / f"{name}.gfa").write_bytes(data)
    (folder / "random.gfa").write_text("\n".join(random_text(rng) for _ in range(5)) + "\nS\t1\tother")
    numbered_ = gfa.read_lines(spark, str(folder)).withColumn("graph_id", F.regexp_extract("graph_id", r"(\w+)\.gfa", 1))
    want = sorted((r.graph_id, r.line_no, bytes(r.v)) for r in numbered_.withColumn("v", F.col("value").cast("binary")).collect())
    errors = {m: sorted(map(tuple, gfa.first_errors(numbered_, m).collect())) for m in (False, True)}
    assert dict(errors[False])["bytes"] == "Error parsing GFA line 2: Invalid orientation: ?" and dict(errors[False])["long"].startswith("Error parsing GFA line 3: not enough")
    for block in (500, 1000, 1 << 20):  # smaller ones: lines_of(), below
        got = gfa.read_offsets(spark, str(folder), block).withColumn("graph_id", F.regexp_extract("graph_id", r"(\w+)\.gfa", 1))
        rows = sorted((r.graph_id, r.offset, bytes(r.v)) for r in got.withColumn("v", F.col("value").cast("binary")).collect())
        assert [(g, v) for g, _, v in rows] == [(g, v) for g, _, v in want]
        assert all(kinds[g][o : o + len(v)] == v for g, o, v in rows if g in kinds)
        if block > 500:
            for mode in (False, True):
                assert sorted(map(tuple, gfa.first_errors(got, mode).collect())) == errors[mode]


def test_splitting_at_every_byte():
    import io

    from canongraph.sources.lines import lines_of

    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"ab\n\r\t") for _ in range(rng.randint(0, 60)))
        want, at = [], 0
        for x in data.split(b"\n"):
            want.append((at, x))
            at += len(x) + 1
        want = want[:-1] if want[-1][1] == b"" else want
        for block in (1, 2, 3, 7, 64):
            for piece in (1, 2, 5, 100):
                got = []
                for a in range(0, len(data), block):
                    for offsets, ends, raw in lines_of(io.BytesIO(data), a, min(a + block, len(data)), piece):
                        first = 0
                        for o, e in zip(offsets, ends):
                            got.append((int(o), bytes(raw[first:e])))
                            first = e
                assert got == want


def test_messages_repair_bytes(spark):
    raw = spark.createDataFrame([("g", 1, bytearray(b"S\tn\xff\tA")), ("g", 2, bytearray(b"S\tn\xff\tC")), ("h", 1, bytearray(b"L\t1\t\xf0\x9f\t2\t+")), ("i", 1, bytearray(b"S\t\xe9\tA"))], "graph_id string, line_no int, value binary")
    lines = raw.withColumn("value", F.col("value").cast("string"))
    assert {r.graph_id: r.message for r in gfa.first_errors(lines, True).collect()} == {"g": "Error parsing node name n�: invalid digit found in string", "h": "Error parsing GFA line 1: Invalid orientation: �", "i": "Error parsing node name �: invalid digit found in string"}
    assert {r.graph_id: r.message for r in gfa.first_errors(lines).collect()}["g"] == "Node n� already exists with a different sequence"
    s, e, _ = gfa.parse(lines)
    assert {r.graph_id: r.message for r in naming.outcomes(s, e).collect()}["g"] == "Node n� already exists with a different sequence"
    # names that are no UTF-8 are named by their bytes
    (got,) = [r for r in naming.outcomes(s, e).collect() if r.graph_id == "i"]
    assert got.digest == hashlib.sha256(b"S\t\xe9\tA\n").hexdigest()


def test_outcomes_of_all_graphs(spark):
    texts = {"ok": EXAMPLE, "word": "S\tx\tA", "twice": "S\tx\tA\nS\tx\tC", "lost": "S\t1\tA\nL\t1\t+\t2\t+\t*", "zero": "S\t0\tA", "edge0": "S\t0\tA\nL\t0\t+\t0\t+\t*", "seven": "S\t7\tA\nS\t07\tC", "large": f"S\t{2**64 - 1}\tA\nS\t5\tC\nL\t{2**64 - 1}\t+\t5\t+\t*", "beyond": f"S\t{2**64}\tA"}
    s, e, _ = read(spark, texts)
    graphs = spark.createDataFrame([(g,) for g in [*texts, "none"]], "graph_id string")
    strings = {"twice": "Node x already exists with a different sequence", "lost": "1 nodes required by the edges are missing"}
    integers = strings | {"word": "Error parsing node name x: invalid digit found in string", "twice": "Error parsing node name x: invalid digit found in string", "edge0": "Node identifier 0 is reserved for technical purposes", "seven": "Node 07 already exists with a different sequence", "beyond": f"Error parsing node name {2**64}: number too large to fit in target type"}
    for mode, bad in (("auto", strings), ("string", strings), ("integer", integers)):
        rows = naming.outcomes(s, e, mode, graphs=graphs).collect()
        assert len(rows) == len(texts) + 1
        assert {r.graph_id: r.message for r in rows if r.message} == bad
        as_int = {g for g in texts if g not in integers} if mode != "string" else set()
        want = {g: hashlib.sha256(plain(t, g in as_int).encode()).hexdigest() for g, t in texts.items() if g not in bad} | {"none": hashlib.sha256(b"").hexdigest()}
        assert {r.graph_id: r.digest for r in rows if not r.message} == want


def test_benchmark_of_invalid_graphs_fails(spark, tmp_path, capsys):
    path = tmp_path / "bad.gfa"
    path.write_text("S\tx\tA\nL\tx\t+\ty\t+\t*\n")
    for flags in ([], ["-s"], ["-b"], ["-s", "-b"]):
        assert cli.main([*flags, str(path)], spark) == 1
        assert capsys.readouterr().err == "1 nodes required by the edges are missing\n"
    for flags in (["-i"], ["-i", "-b"]):
        assert cli.main([*flags, str(path)], spark) == 1
        assert capsys.readouterr().err == "Error parsing node name x: invalid digit found in string\n"
    path.write_text("H\tVN:Z:1.0\n")
    assert cli.main(["-b", str(path)], spark) == 0 and "0 nodes, 0 edges, 0 bp" in capsys.readouterr().err
    assert cli.main([str(path)], spark) == 0 and capsys.readouterr().out == f"{hashlib.sha256(b'').hexdigest()}  {path}\n"


def test_tags_are_written_back_whole_or_not(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    tags = spark.createDataFrame([(f"o{i}", k, f"{k}{i}") for i in range(20) for k in ("name", "subgraph", "other")], "obj_id string, key string, value string")
    shown = lambda *v: sorted(map(tuple, tagstore.read_tags(spark, path, *v).collect()))
    assert shown() == []
    assert tagstore.write_tags(spark, path, tags, 4) == 1
    first = shown()
    assert first == sorted(map(tuple, tags.collect()))
    names = spark.createDataFrame([("o1", "new"), ("o2", None), ("o99", "fresh")], "obj_id string, name string")
    rel = spark.createDataFrame([("o1", 0, "a", "b"), ("o1", 1, "a", "c"), ("o5", 0, "not", "given")], "obj_id string, kind int, src string, dst string")

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # killed when all is staged and nothing is committed
        m.setattr(tagstore, "_commit", dies)
        with pytest.raises(RuntimeError):
            tagstore.write_back(spark, path, names, rel)
    assert shown() == first
    assert tagstore.write_back(spark, path, names, rel) == 2
    want = sorted(map(tuple, headers.set_tags(tags, names, rel.filter("obj_id <> 'o5'")).collect()))
    assert shown() == want and shown(1) == first
    assert tagstore.write_back(spark, path, names, rel) == 2 and shown() == want  # an equal run changes nothing
    # another writer commits in between: the write starts again from what that wrote
    real, once = tagstore._commit, []

    def late(spark_, path_, number, content):
        if not once:
            once.append(1)
            tagstore.write_tags(spark_, path_, spark_.createDataFrame([("o3", "name", "theirs")], "obj_id string, key string, value string"))
        return real(spark_, path_, number, content)

    monkeypatch.setattr(tagstore, "_commit", late)
    assert tagstore.write_tags(spark, path, spark.createDataFrame([("o4", "name", "mine")], "obj_id string, key string, value string")) == 4
    assert {r for r in shown() if r[0] in ("o3", "o4")} == {("o3", "name", "theirs"), ("o4", "name", "mine")}
    assert tagstore.vacuum(spark, path) > 0 and tagstore._manifests(spark, path) == [4]
    assert {r for r in shown() if r[0] in ("o3", "o4")} == {("o3", "name", "theirs"), ("o4", "name", "mine")}


def test_graphs_in_pieces(spark, tmp_path):
    rng = random.Random(9)
    texts = {f"g{i}": random_text(rng, 4) for i in range(5)} | {"example": EXAMPLE, "bad": "S\t1\tA\nL\t1\t+\t1", "lost": "S\t1\tA\nL\t1\t+\t2\t+\t*", "none": "H\tVN:Z:1.0"}
    rows = [(r.graph_id, r.line_no, r.value) for r in numbered(spark, texts).collect()]
    rows += [(g, max(n for h, n, _ in rows if h == g), None) for g in texts] + rng.sample(rows, 10)  # ends, and lines that come twice
    rows += [("half", 1, "S\t1\tA"), ("half", 3, None)]
    rng.shuffle(rows)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "graph_id string, line_no long, value string"

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = name_pieces(stream, out, check)
        query.awaitTermination()
        assert query.exception() is None

    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :]):  # started again each time, from the checkpoint
        run(part)
    got = {r.graph_id: (r.digest, r.message) for r in spark.read.parquet(out).collect()}
    want = {g: (hashlib.sha256(plain(t, True).encode()).hexdigest(), None) for g, t in texts.items() if g not in ("bad", "lost")}
    want |= {"bad": (None, "Error parsing GFA line 2: not enough fields for a link"), "lost": (None, "1 nodes required by the edges are missing")}
    assert got == want and got["example"][0] == NAME
    assert spark.read.parquet(out).count() == len(want)


def test_containment_equals_all_pairs(spark):
    rng = random.Random(4)
    graphs = {}
    for i in range(25):
        nodes = {n: "ACGT"[n % 4] if rng.random() < 0.9 else "N" for n in rng.sample(range(1, 7), rng.randrange(0, 5))}
        ends = list(nodes)
        links = [(rng.choice(ends), rng.randrange(2), rng.choice(ends), rng.randrange(2)) for _ in range(rng.randrange(4))] if ends else []
        graphs[i] = (nodes, links)
    graphs |= {30 + i: graphs[i] for i in range(5)}  # copies
    s = spark.createDataFrame([(g, n, q) for g, (nodes, _) in graphs.items() for n, q in nodes.items()], "graph_id long, name long, sequence string")
    e = spark.createDataFrame([(g, *x) for g, (_, links) in graphs.items() for x in links], "graph_id long, src long, src_rev int, dst long, dst_rev int")
    pairs, members = containment.contained(s, e)
    sets = {}
    for r in canonical.cell_lines(canonical.cells(s, e)).collect():
        sets.setdefault(r.graph_id, set()).add(r.line)
    first = {g: min(h for h in sets if sets[h] == sets[g]) for g in sets}
    assert {r.graph_id: r.class_id for r in members.collect()} == first
    reps = set(first.values())
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in reps for b in reps if a != b and sets[a] < sets[b]}


def test_digest_family_of_many_graphs(spark):
    rng = random.Random(12)
    texts = {f"g{i}": random_text(rng, rng.choice([2, 4, 30])) for i in range(15)}
    s, e, _ = read(spark, texts)
    got = {(r.graph_id, r.algorithm): r.digest for r in naming.stable_names(s, e, algorithms=list(digest.ALGORITHMS)).collect()}
    assert got == {(g, a): hashlib.new(n, plain(t, True).encode()).hexdigest() for g, t in texts.items() for a, (n, _) in digest.ALGORITHMS.items()}


def test_release_removes_tables(spark):
    table = shared.stored(spark.range(5), "some")
    path = list(shared._MADE)[-1]
    assert table.count() == 5 and shared.release(spark) > 0
    fs, where = shared.file_system(spark, path)
    assert not fs.exists(where)


def test_pieces_are_given_up_in_time(spark, tmp_path):
    import time

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "graph_id string, line_no long, value string"
    spark.createDataFrame([("half", 1, "S\t1\tA"), ("half", 3, None), ("whole", 1, "S\t1\tA"), ("whole", 1, None)], schema).write.parquet(source)
    query = name_pieces(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "check"), timeout_ms=500, once=False)
    try:
        got, until = {}, time.time() + 90
        while len(got) < 2 and time.time() < until and query.isActive:
            time.sleep(1)
            if os.path.isdir(out) and any(f.endswith(".parquet") for _, _, fs in os.walk(out) for f in fs):
                got = {r.graph_id: (r.digest, r.message) for r in spark.read.schema("graph_id string, algorithm string, digest string, message string").parquet(f"{out}/batch=*").collect()}
    finally:
        query.stop()
    assert got == {"half": (None, "Graph is incomplete: 1 of 3 lines"), "whole": (hashlib.sha256(b"S\t1\tA\n").hexdigest(), None)}


def test_scopes_remove_what_is_made_in_them(spark, tmp_path):
    def there(df):
        return [f for f in df.inputFiles() if Path(f.removeprefix("file://")).exists()]

    before, made = shared.stored(spark.range(5), "before"), set(shared._MADE)
    with shared.scope():
        a, b = shared.stored(spark.range(7), "inner"), shared.cut(spark.range(9).repartition(2))
        checkpoints = [p for p in shared._MADE if "rdd-" in p and p not in made]
        assert there(a) and b.count() == 9 and len(checkpoints) == 1 and Path(checkpoints[0].removeprefix("file:")).exists()
        with shared.scope():
            c = shared.stored(spark.range(3), "innermost")
        assert not there(c) and there(a)
        other = []
        t = Thread(target=lambda: other.append(shared.stored(spark.range(2), "thread")))
        t.start()
        t.join()
        b.write.parquet(str(tmp_path / "kept"))
    assert not there(a) and not Path(checkpoints[0].removeprefix("file:")).exists()
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 9 and before.count() == 5 and other[0].count() == 2
    with pytest.raises(ZeroDivisionError), shared.scope():
        d = shared.stored(spark.range(3), "failed")
        1 / 0
    assert not there(d)
