import numpy as np
import pytest

from canongraph.llm import embdedup
from tests.llm import brute


def check(spark, rows):
    got = {r.vec_id: r for r in embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = [i for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    by = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i in set(good)}
    links = [(a, b) for k, a in enumerate(good) for b in good[k + 1 :] if len(by[a]) == len(by[b]) and by[a] @ by[b] / (np.linalg.norm(by[a]) * np.linalg.norm(by[b])) >= 0.9]
    c = brute.union(max(i for i, _, _ in rows) + 1, links)
    for i, _, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in x for x in links), c[i], c[i] == i), i
    assert len(got) == len(rows)


def test_table_and_odd_vectors(spark):
    rows = [(r.vec_id, list(r.embedding), 0) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng = np.random.default_rng(0)
    base = rng.normal(size=64)
    rows += [(1000 + i, (base + rng.normal(size=64) * 0.4 * i / 40).tolist(), 1) for i in range(40)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 64, 0), (2003, [1.0] * 63 + [None], 0), (2004, [1.0] * 63 + [float("nan")], 0), (2005, [1.0] * 63 + [float("inf")], 0), (2006, [1.0, 0.0], 0), (2007, [0.9, 0.1], 0), (2008, [3e38] * 64, 0), (2009, [1e-38] * 64, 0)]
    check(spark, rows)


@pytest.mark.parametrize("undecided", [0, 8192])
def test_many_small_blocks(spark, monkeypatch, undecided):
    monkeypatch.setattr(embdedup, "BLOCK", 16)
    monkeypatch.setattr(embdedup, "UNDECIDED", undecided)  # 0: every tile with an open pair is computed again whole
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(150)]
    centre = rng.normal(size=8)
    rows += [(200 + i, (centre + rng.normal(size=8) * 0.02).tolist(), 0) for i in range(120)]  # a dense cell
    rows += [(400 + i, (centre + rng.normal(size=8) * 0.45).tolist(), 0) for i in range(120)]  # many at the threshold
    rows += [(600 + i, rows[i % 3][1], 0) for i in range(60)] + [(700 + i, (np.array(rows[i][1]) * 3).tolist(), 0) for i in range(20)]
    check(spark, rows)


def test_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [0.0, 1.0], "c"), (2, [1.0, 0.1], "d"), (None, [1.0, 0.0], "e"), (None, None, "f"), (3, [1.0, 0.05], "g")]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, node string, n_links int, kept int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdedup.near_duplicates(frame).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), None: (0, None, False)}


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = embdedup.unit(rng.normal(size=(300, 48)) ** 3)
    q, s, e = embdedup.quantise(x)
    product = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(product - x @ x.T) <= (1 + e[:, None]) * e[None, :] + e[:, None]).all()


def test_empty(spark):
    assert embdedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
