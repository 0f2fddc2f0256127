"""The registered queries: their columns and types, and plain versions of what SQL cannot say."""

import hashlib
import re
import zlib

import pytest
from tokenizers import Tokenizer

from canongraph.llm.common import bound_batches
from canongraph.llm.queries import oracle_sql, queries
from tests.llm import brute
from tests.llm.test_tokens_store_packing import BYTE, WORD, check_packing, whole

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op2": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op3": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6": "page_id bigint, url string, text string, n_chars bigint",
    "op7": "doc_id bigint, license string, coverage double",
    "op8": "doc_id bigint, item_id bigint, score double",
    "op9": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op11": "item_id bigint, rank int, doc_id bigint, score bigint",
    "op12": "query_id bigint, rank int, vec_id bigint, score double",
    "op13": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
}


@pytest.fixture(scope="module")
def results(spark):
    out = {}
    for name, query in queries().items():
        frame = query(spark, SF)
        out[name.split("_")[0]] = (dict(frame.dtypes), frame.collect())
    return out


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_columns(results):
    assert set(results) == set(COLUMNS) and set(oracle_sql()) <= set(queries())
    for name, columns in COLUMNS.items():
        kinds, rows = results[name]
        assert [kinds.get(c.split()[0]) for c in columns.split(", ")] == [c.split()[1] for c in columns.split(", ")], name


def test_a_row_for_each_document(spark, results):
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for name in ("op2", "op3", "op4", "op5", "op9"):
        assert len(results[name][1]) == len(ids) and {r.doc_id for r in results[name][1]} == ids
    assert {r.doc_id for r in results["op10"][1]} == ids
    for r in results["op4"][1]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    for r in results["op5"][1]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_op2_is_brute_force(results, texts):
    got = {r.doc_id: r for r in results["op2"][1]}
    for i, (d, g) in zip(sorted(got), zip(*brute.repeated(texts, 200))):
        kept = bytes(b for b, x in zip(d, g) if not x)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(d), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest())


def test_op9_and_op10_are_the_library(results, texts):
    start = 0
    rows = sorted(results["op9"][1], key=lambda r: r.doc_id)
    for r, ids in zip(rows, whole(WORD, texts)):
        assert (r.start, r.n_tokens, r.ids_crc32, r.verified) == (start, len(ids), zlib.crc32(ids.tobytes()), True)
        start += len(ids)
    place = {r.doc_id: i for i, r in enumerate(rows)}
    pieces = [type("Row", (), r.asDict() | {"doc_id": place[r.doc_id]}) for r in results["op10"][1]]
    want = whole(BYTE, texts)
    assert check_packing(pieces, want, 1024) <= 1.02 * sum(map(len, want)) / 1024 + 1


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    kept = spark.conf.get(key)
    try:
        for before, after in ((str(1 << 30), 1 << 22), ("64m", 1 << 22), ("1000b", 1000)):
            spark.conf.set(key, before)
            bound_batches(spark)
            assert int(spark.conf.get(key).rstrip("b")) == after
    finally:
        spark.conf.set(key, kept)


def test_memo_never_changes_ids():
    from canongraph.llm import tokens

    texts = [f"word{i % 50} other{i} 'll {i}" for i in range(400)]
    want = [x.ids for x in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    encoder, most = tokens.Encoder(BYTE), tokens.MEMO
    try:
        tokens.MEMO = 60
        for i in range(0, 400, 20):
            assert encoder.encode(texts[i : i + 20]) == [b"".join(x.to_bytes(4, "little") for x in ids) for ids in want[i : i + 20]]
    finally:
        tokens.MEMO = most
