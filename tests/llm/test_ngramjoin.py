import random

from canongraph.llm import components, ngramjoin
from tests.llm import brute
from tests.llm.conftest import TEXTS


def check(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(frame).collect()}
    n, c = brute.jaccard_components(texts)
    assert [got[i] for i in range(len(texts))] == list(zip(n, c))


def test_equals_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts + TEXTS)


def test_chains_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):  # each copy drifts: neighbours link, far ones do not
        base = list(base)
        base[rng.randrange(len(base))] = f"x{i}"
        texts.append(" ".join(base))
    common = " ".join(f"c{i}" for i in range(40))
    texts += [common + " " + " ".join(f"u{i}_{j}" for j in range(rng.randrange(1, 20))) for i in range(60)]
    rng.shuffle(texts)
    check(spark, texts)


def test_longer_and_shorter_copies(spark):
    rng = random.Random(7)
    texts = []
    for t, percent in enumerate((15, 18, 20, 22, 25, 30)):
        base = [f"w{t}_{i}" for i in range(124 + t)]
        more = [f"m{t}_{i}" for i in range(len(base) * percent // 100)]
        texts += [" ".join(base)] * 20 + [" ".join(base + more), " ".join(base[: len(base) - len(more)])]
        base = [f"v{t}_{i}" for i in range(13)]  # 9 shingles beside 12, no copies
        texts += [" ".join(base), " ".join(base + [f"n{t}_{i}" for i in range(3)])]
    rng.shuffle(texts)
    check(spark, texts)


def cut_and_longer(rng, n, m, name):
    """A text of n words and its first m words."""
    words = [f"{name}_{i}" for i in range(n)]
    return [" ".join(words), " ".join(words[:m])]


def test_pairs_of_other_sizes(spark):
    rng, texts = random.Random(11), []
    for i in range(150):
        texts += cut_and_longer(rng, 24, 19, f"a{i}")  # 15 of 20 shingles: just enough
        texts += cut_and_longer(rng, 204, 159, f"b{i}")
        n = rng.randrange(2, 300)
        texts += cut_and_longer(rng, n, max(1, n - rng.randrange(n // 3 + 1)), f"c{i}")
    rng.shuffle(texts)
    check(spark, texts)


def edited(rng, texts, n):
    """Texts made from each other by changed, dropped and repeated stretches, with common passages between."""
    common = [" ".join(f"p{j}_{i}" for i in range(60)) for j in range(3)]
    out = list(texts)
    while len(out) < n:
        words = rng.choice(out).split()
        for _ in range(rng.randrange(1, 4)):
            a = rng.randrange(len(words) + 1)
            b = min(len(words), a + rng.randrange(8))
            words[a:b] = rng.choice([[], [f"n{rng.randrange(50)}"], words[a:b] * 2, rng.choice(common).split()])
        out.append(" ".join(words))
    return out


def test_frequent_shingles_and_small_batches(spark, monkeypatch):
    rng = random.Random(3)
    texts = edited(rng, [" ".join(f"w{t}_{i}" for i in range(rng.randrange(3, 90))) for t in range(12)], 260)
    check(spark, texts)
    monkeypatch.setattr(ngramjoin, "OFTEN", 4)  # most shared shingles are counted before
    monkeypatch.setattr(ngramjoin, "FLUSH", 300)
    check(spark, texts)
    monkeypatch.setattr(ngramjoin, "LEADERS", 0)  # all pairs of a bucket at once
    check(spark, texts)


def test_null_and_repeated_ids(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b, c = " ".join(f"b{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40))
    rows = [(None, a), (7, a + " x"), (None, b), (None, b + " y"), (3, c), (3, a + " z"), (3, c), (9, None), (None, None)]
    frame = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngramjoin.jaccard_components(frame).collect())
    # two documents have the id 3: one by itself and its copy, one linked with a
    assert got == sorted([(-1, 36, 3), (7, 37, 3), (-1, 36, -1), (-1, 37, -1), (3, 36, 3), (3, 37, 3), (3, 36, 3), (9, 0, 9), (-1, 0, -1)])


def test_first_documents(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(None, a), (7, a + " x"), (7, a + " x"), (9, a), (None, b), (None, b), (None, b + " y"), (3, None), (3, None), (3, " "), (5, "other words"), (5, "more words here")]
    frame = spark.createDataFrame([(i, t, "c", 0) for i, t in rows], "doc_id long, text string, h string, n int")
    out = ngramjoin.first_documents(frame)
    assert out.columns == frame.columns
    got = sorted((r.doc_id or -1, r.text or "") for r in out.collect())
    assert [x for x in got if not x[1].startswith("b0")] == sorted([(7, a + " x"), (3, ""), (3, ""), (3, " "), (5, "other words"), (5, "more words here")])
    assert len([x for x in got if x[1].startswith("b0")]) == 1
    assert ngramjoin.first_documents(frame.limit(0)).count() == 0


def test_empty_and_odd(spark, docs):
    assert ngramjoin.jaccard_components(docs.limit(0)).count() == 0
    check(spark, TEXTS)
    check(spark, ["", None, " \t"])
    check(spark, ["one two three four five six " * 3000 + "end", "one two three four five six " * 2999])


def test_components_in_rounds(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300) if i % 50 != 49] + [(500, i) for i in range(501, 700)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    want = brute.union(1300, links)
    for thin in (components.THIN, 3):
        got = {r.node: r.component_id for r in components.components(frame, thin).collect()}
        assert got == {i: want[i] for x in links if x[0] != x[1] for i in x}
