import os
import zlib

import corpus_pipeline
import public_tokenizers

from canongraph.llm import decontam, toxicity
from canongraph.llm.common import shared_dir
from tests.llm import brute
from tests.llm.test_tokens_store_packing import BYTE, check_packing, whole


def test_stages_match_plain_versions(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        ids = sorted(before)
        texts = [before[i].text for i in ids]
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        if name != "packing":
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS) and len({r.doc_id for r in rows}) == len(rows)
        got = {r.doc_id: r for r in rows}
        if name == "near_copies":
            component = brute.jaccard_components(texts)[1]
            assert set(got) == {ids[i] for i in range(len(ids)) if component[i] == i}
        elif name == "repeats":
            for i, d, g in zip(ids, *brute.repeated(texts, 200)):
                assert got[i].text == bytes(b for b, x in zip(d, g) if not x).decode("utf-8", "ignore") and got[i].n_chars == len(got[i].text)
        elif name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert all(not any(x in r.text for x in items) for r in rows)
            assert set(before) - set(got) == {r.doc_id for r in decontam.contaminated(spark.createDataFrame(list(before.values())), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        elif name == "packing":
            by = dict(enumerate(ids))
            back = {v: k for k, v in by.items()}
            from types import SimpleNamespace

            check_packing([SimpleNamespace(**(r.asDict() | {"doc_id": back[r.doc_id]})) for r in rows], whole(BYTE, texts), 1024)


ROWS = [(None, "alpha beta gamma delta epsilon zeta"), (None, "quite another text with other words in it"), (1, None), (1, ""), (2, "same id one two three four"), (2, "same id but other words altogether here"), (3, "twice the very same row"), (3, "twice the very same row"), (4, "long " * 30_000)]


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")


def key(rows):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in rows)


def test_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    stages, rows = dict(corpus_pipeline.STAGES), [(i if i is not None else -1, t or "") for i, t in ROWS]
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    frame = frame_of(spark, ROWS)
    assert key(stages["toxicity"](spark, frame, sf).collect()) == sorted(rows)
    want = list(rows)
    want.remove((3, "twice the very same row"))
    assert key(stages["near_copies"](spark, frame, sf).collect()) == sorted(want)
    assert key(stages["repeats"](spark, frame, sf).collect()) == sorted((i, "" if t.startswith("long") else t) for i, t in rows)
    dirty = frame_of(spark, [*ROWS, (None, "x " + item), (2, item), (2, item)])
    assert key(stages["decontamination"](spark, dirty, sf).collect()) == sorted(rows)
    for name in ("toxicity", "near_copies", "repeats", "decontamination"):
        assert set(stages[name](spark, frame, sf).columns) == set(corpus_pipeline.COLUMNS)
    packed = stages["packing"](spark, frame, sf).collect()
    sizes = sorted(len(x) for x in whole(BYTE, [t for _, t in ROWS]))
    starts = sorted(r.start for r in packed if r.piece == 0)
    assert len(starts) == len(ROWS) and sum(r.length for r in packed) == sum(sizes)


def test_empty_tables(spark):
    empty = frame_of(spark, ROWS).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name


def test_toxicity_is_the_operators(spark):
    """A stage drops what a plain look at the operator's scores drops."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    learned = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    scores = toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), learned)).collect()
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, sf).collect()}
    assert kept == {r.doc_id for r in scores if r.score < 0.7} and 0 < len(kept) < len(scores)


def test_run_leaves_its_result_only(spark):
    top = shared_dir(spark)
    before = {d: set(os.listdir(d)) for d in (top, spark.sparkContext.getCheckpointDir().removeprefix("file:"))}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() >= 60
    new = [x for d, names in before.items() for x in set(os.listdir(d)) - names if not x.startswith(".")]
    assert len(new) == 1 and new[0].startswith("packing-")
