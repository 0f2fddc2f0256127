"""Ranked search, nearest neighbours and the prefix trie against plain versions, odd rows included."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canongraph.llm import annsearch, lexsearch, prefixtrie, queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark conversations".split()


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_nearest_neighbours", "op13_prefix_trie"])
def test_equals_sql(spark, name):
    frame = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(frame.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[c] for c in cols)) for r in frame.collect())


# -- ranked search ------------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, most = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n) // most if most else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if s > 0:
                found.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if late else doc, -s) for r, (s, late, doc) in enumerate(sorted(found)[:k])]
    return out


DOCS = T.StructType([T.StructField("rank", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
ITEMS = T.StructType([T.StructField("score", T.StringType()), T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def test_search_takes_odd_rows(spark):
    long_text = " ".join(f"w{i % 977}" for i in range(200_000))
    docs = [(1, "Red fox, red FOX"), (2, "red fox red fox"), (3, None), (4, ""), (5, " ,.;- "), (5, "the red ox"), (None, "red fox"), (None, "red"), (6, "Ünïcode Über-wörd naïve"), (7, long_text), (8, "x" * 100_000 + " fox"), (-3, "red fox red fox"), (9, "the the the")]
    items = [(10, "red fox"), (11, "red red FOX!"), (11, "über wörd"), (None, "the ox w5"), (12, None), (13, ""), (14, "unseen"), (15, "x" * 100_000)]
    table = spark.createDataFrame([("a", *x) for x in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([("b", *x) for x in items], ITEMS)
    for shard in (4, 10**6):
        for k in (3, 20):
            got = lexsearch.search(lexsearch.build(table, shard=shard), asked, k).collect()
            assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_search(docs, items, k)))


def test_search_in_slices_and_empty_tables(spark, monkeypatch):
    docs = [(i, " ".join(f"t{(i * j) % 7}" for j in range(1, 9))) for i in range(60)]
    items = [(i, f"t{i % 7} t{i % 3} t1") for i in range(9)]
    table, asked = spark.createDataFrame([("", *x) for x in docs], DOCS), spark.createDataFrame([("", *x) for x in items], ITEMS)
    monkeypatch.setattr(lexsearch, "SLICE_ITEMS", 2)
    got = lexsearch.search(lexsearch.build(table), asked, 5).collect()
    assert sorted(map(tuple, got)) == sorted(plain_search(docs, items, 5))  # ties are cut by id
    assert not lexsearch.search(lexsearch.build(table.limit(0)), asked).collect()
    assert not lexsearch.search(lexsearch.build(table), asked.limit(0)).collect()


# -- nearest neighbours -------------------------------------------------------------------------------------------------


def in_order(q, v):
    """The inner product, added in order (Python's sum() compensates)."""
    total = 0.0
    for x, y in zip(q, v):
        total += float(x) * float(y)
    return total


def plain_nearest(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if i is not None and i % 20 == 0:
            found = sorted((-in_order(q, v), j is None, j or 0) for b, (j, v) in enumerate(fine) if a != b and len(v) == len(q))
            out += [(i, r + 1, None if late else j, -s) for r, (s, late, j) in enumerate(found[:k])]
    return out


def vectors(spark, rows, kind):
    return spark.createDataFrame([("a", *x) for x in rows], T.StructType([T.StructField("cell", T.StringType()), T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(kind))]))


@pytest.mark.parametrize("kind", [T.FloatType(), T.DoubleType()])
def test_nearest_takes_odd_rows(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(7)]) for i in range(200)]
    rows += [(i, rows[i % 5][1]) for i in range(200, 260)]  # copies: equal scores
    rows += [(300, None), (320, []), (340, [0.0] * 7), (360, [1.0, None] + [0.0] * 5), (380, [float("nan")] + [1.0] * 6), (400, [float("inf")] + [1.0] * 6)]
    rows += [(40, [2.0] * 7), (None, [3.0] * 7), (None, rows[0][1]), (420, [1.0, 2.0]), (421, [2.0, 1.0]), (440, [5.0]), (60, rows[60][1])]
    got = annsearch.nearest(vectors(spark, rows, kind), F.col("vec_id") % 20 == 0, 6).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_nearest(rows, 6)))


def test_nearest_in_many_blocks_reaches_the_recall(spark, monkeypatch):
    monkeypatch.setattr(annsearch, "BLOCK", 64)
    monkeypatch.setattr(annsearch, "QUERIES", 8)
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((6, 48)) * 3
    points = [(i, [float(np.float32(x)) for x in middle[i % 6] * (i % 2) + rng.standard_normal(48)]) for i in range(1500)]
    got = annsearch.nearest(vectors(spark, points, T.FloatType()), F.col("vec_id") % 20 == 0).collect()
    truth = plain_nearest(points, 20)
    assert len(got) == len(truth)
    same = {(r.query_id, r.vec_id, r.score) for r in got} & {(a, c, d) for a, _, c, d in truth}
    assert len(same) >= 0.98 * len(truth)
    assert all(math.isclose(r.score, sum(x * y for x, y in zip(points[r.query_id][1], points[r.vec_id][1])), rel_tol=1e-12, abs_tol=1e-12) for r in got)


def test_nearest_of_few_and_none(spark):
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])], T.FloatType())
    assert [tuple(r) for r in annsearch.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert not annsearch.nearest(few.limit(0), F.col("vec_id") % 20 == 0).collect()
    assert not annsearch.nearest(few.filter("vec_id = 1"), F.col("vec_id") % 20 == 0).collect()


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((20, 64))
    c = x.mean(0)
    est, err = annsearch.estimate(q, *annsearch.encode(x, c), c)
    assert (np.abs(est - q @ x.T) <= err).mean() > 0.997
    assert (err < 3 * np.abs(q @ x.T).std()).all()


# -- prefix trie --------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    turns: dict = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    nodes: dict = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full = own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]
        for d in range(len(full) + 1):
            nodes.setdefault(tuple(full[:d]), []).append((c, d == len(full)))
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        members = [c for c, _ in nodes[path]]
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[:-1] == path]
        saved = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        done = ",".join(map(str, sorted(c for c, e in nodes[path] if e)))
        out[path] = (min(members), len(path), min(c for c, _ in nodes[path[:-1]]) if path else None, len(members), len(kids), sum(out[p][5] for p in kids) or 1, saved + sum(out[p][6] for p in kids), hashlib.sha256(done.encode()).hexdigest())
    return sorted(map(repr, out.values()))


CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("depth", T.StringType()), T.StructField("ids", T.StringType())])


def conversations(spark, rows):
    return spark.createDataFrame([(*x, "a", "b") for x in rows], CONV).repartition(3)


@pytest.mark.parametrize("local", [1, 6, prefixtrie.LOCAL])
def test_trie_takes_odd_rows(spark, local):
    rng = np.random.default_rng(8)
    rows = [(c, t, "user" if t % 2 else "bot", f"say {rng.integers(0, 3)} of it") for c in range(-45, 90) for t in range(int(rng.integers(1, 6)))]
    rows += [(200 + c, t, "user", "the same words again") for c in range(30) for t in range(9)]  # copies, and a long way alike
    rows += [(None, 0, "user", "lost"), (300, None, None, None), (300, 0, "user", ""), (301, 1, None, "a\tb\x0bc  d"), (301, 1, "x", "tie"), (301, 1, "x", "tie"), (303, 0, "user", "alone")]
    rows += [(400, t, "user", "word " * (t % 3)) for t in range(400)] + [(401, 0, "user", "long " * 50_000)]
    got = prefixtrie.trie(conversations(spark, rows), local).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_trie(rows)


def test_trie_of_few_and_none(spark):
    assert not prefixtrie.trie(conversations(spark, [(None, 0, "a", "b")])).collect()
    assert not prefixtrie.trie(conversations(spark, [(1, 0, "a", "b")]).limit(0)).collect()
    for rows in ([(7, 0, "a", "b")], [(20, 0, "a", "b c"), (20, 1, "a", "b c"), (23, 0, "x", "y")]):
        assert sorted(repr(tuple(r)) for r in prefixtrie.trie(conversations(spark, rows)).collect()) == plain_trie(rows)


def test_hashes_of_members_over_bounds(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 64)
    rows = [("abc"[min(i % 7, 2)], i * 37 % 1009 - 300) for i in range(1000)]
    got = {r.print: r.ends for r in prefixtrie.ends(spark.createDataFrame(rows, "print string, conv_id long")).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(c for p, c in rows if p == k))).encode()).hexdigest() for k in "abc"}
