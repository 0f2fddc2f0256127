import hashlib
import random
import re

import numpy as np
import pytest

from canongraph.llm import suffixdedup
from tests.llm import brute
from tests.llm.conftest import TEXTS


def check(spark, texts, length):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in suffixdedup.digests(frame, length).collect()}
    assert len(got) == len(texts)
    for i, (d, g) in enumerate(zip(*brute.repeated(texts, length))):
        kept = bytes(b for b, x in zip(d, g) if not x)
        want = (len(d), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, i


def test_equals_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts + TEXTS, 200)


@pytest.mark.parametrize("length", [8, 24])
def test_overlaps_runs_and_near_misses(spark, length):
    rng = random.Random(length)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 8))) for _ in range(120)]
    texts += ["a" * 300, "ab" * 200, "x" * length, "x" * (length + 1), None, "é" * 30, "zé" * 3]
    check(spark, texts, length)


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 3000, 20_000):
        words = [rng.integers(0, top, n).astype(np.uint64) for top in (5, 40, 1 << 62)]
        words[0][: n // 2] = 3
        order = suffixdedup.multikey_quicksort(*words, few=16)
        assert sorted(order.tolist()) == list(range(n))
        assert (order == np.lexsort(words[::-1])).all() or all((w[order] == w[np.lexsort(words[::-1])]).all() for w in words)


def test_many_buckets_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PER_BUCKET", 100)
    monkeypatch.setattr(suffixdedup, "FLUSH", 400)
    monkeypatch.setattr(suffixdedup, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    same = "".join(rng.choice("abcdef ") for _ in range(400))
    texts = ["".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + same[a : a + rng.randrange(20, 300)] + str(i) for i, a in enumerate([rng.randrange(200) for _ in range(80)])]
    check(spark, texts + [same] * 30 + ["ab" * 500], 32)


def test_repeated_rows_and_clashing_columns(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(90))
    rows = [(1, text, 5, "a"), (1, text, 6, "b"), (2, "z" + text[:150], 7, "c"), (None, "y" * 10, 8, "d"), (None, None, 9, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rid int, spans string")
    got = suffixdedup.deduplicate(frame, 100, keep=["doc_id", "rid", "spans"])
    assert got.columns == ["doc_id", "rid", "spans", "kept", "n_bytes"]
    rows = {r.rid: (r.doc_id, len(r.kept), r.n_bytes, [tuple(x) for x in r.spans or []]) for r in got.collect()}
    n = len(text)
    assert rows == {5: (1, 0, n, [(0, n)]), 6: (1, 0, n, [(0, n)]), 7: (2, 1, 151, [(1, 151)]), 8: (None, 10, 10, []), 9: (None, 0, 0, [])}


def test_row_names_that_collide_are_drawn_again(spark, monkeypatch):
    real = suffixdedup.F.xxhash64
    monkeypatch.setattr(suffixdedup.F, "xxhash64", lambda *c: real(*c) if len(c) < 3 or "'0'" not in repr(c[0]) and "Column<'0'>" not in repr(c[0]) else real(c[2]).cast("long") * 0 + 1)
    texts = ["a" * 40 + str(i) for i in range(6)] + ["b" * 30]
    check(spark, texts, 20)


def test_empty_table(spark, docs):
    assert suffixdedup.digests(docs.limit(0)).count() == 0
