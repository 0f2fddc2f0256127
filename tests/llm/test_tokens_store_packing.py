import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from canongraph.llm import chunkstore, packing
from canongraph.llm.common import fresh_dir
from canongraph.llm.tokens import Encoder
from tests.llm.conftest import TEXTS

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def whole(path, texts, end=2):
    t = Tokenizer.from_file(path)
    return [np.array([*x.ids, end], "<u4") for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_parts_give_the_ids_of_the_whole(path, spark):
    odd = ["<|endoftext|> is text", "a<|startoftext|>b <|ENDOFTEXT|>", "'s don't 'LL 're\"'s  't \n's", "a  b\n\n c\t", "1234 x12", "é×÷Ⱥ ŉ", "<| |>", "\x1c\x7f\x85\xa0 x", "e\u0301 İ ſ", "  ", "_a_ 'tis"]
    texts = odd + TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert Encoder(path).encode(texts) == [x[:-1].tobytes() for x in whole(path, texts)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_any_mixture_of_characters(path):
    rng, encoder = random.Random(3), Encoder(path)
    some = ["'s", "'ll", "'RE", "'", "''", " ", "  ", "\n", "\t", "a", "Bc", "é", "É", "×", "÷", "Ⱥ", "ß", "12", "3", "_", "<", "|", "<|endoftext|>", ".", "İ", "漢", "\u0301", "½", "\x85", "\xa0", "ǅ", "\x1c", "ª"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(14))) for _ in range(4000)]
    assert encoder.encode(texts) == [x[:-1].tobytes() for x in whole(path, texts)]


def test_chunks_depend_on_the_document_alone():
    rng = np.random.default_rng(1)
    streams = [rng.integers(0, 40_000, n).astype(np.uint32) for n in (1, 15, 16, 64, 65, 3000, 20_000)]
    streams.append(np.zeros(10_000, np.uint32))
    edges = np.append(0, np.cumsum([len(x) for x in streams]))
    together = chunkstore.chunk_edges(np.concatenate(streams), edges)
    for x, own in zip(streams, together):
        assert own == chunkstore.chunk_edges(x, np.array([0, len(x)]))[0]
        sizes = np.diff([0, *own])
        assert own[-1] == len(x) and sizes.max() <= chunkstore.MOST and (sizes[:-1] >= chunkstore.LEAST).all()


def test_chunks_are_stored_in_two_or_four_bytes():
    ids = np.array([1, 2, 65535, 65536, 3, 4], np.uint32)
    for some in (ids, ids[:3], ids[4:], ids[:0]):
        written = chunkstore._written(some)
        for a in range(len(some) + 1):
            for b in range(a, len(some) + 1):
                raw = written(a, b)
                assert len(raw) == (b - a) * (4 if 65536 in some[a:b] else 2)
                assert chunkstore._read(raw, b - a) == some[a:b].astype("<u4").tobytes()


def test_damage_is_found(spark, docs, monkeypatch):
    path = fresh_dir(spark, "store")
    monkeypatch.setattr(chunkstore, "FANOUT", 4)
    chunkstore.write_store(docs, path, WORD)
    told = spark.read.parquet(f"{path}/manifest")
    assert {(r.level, r.number): r.n_docs for r in told.collect()} == {(0, 0): 4, (0, 1): 4, (0, 2): 3, (1, 0): 11}
    bad = told.withColumn("root", F.when(F.expr("level = 0 and number = 1"), F.unhex(F.lit("00"))).otherwise(F.col("root")))
    monkeypatch.setattr(chunkstore, "_stored_manifest", lambda *_: bad)
    got = {r.doc_id: r.verified for r in chunkstore.read_digests(spark, path).collect()}
    assert got == {i: not 4 <= i < 8 for i in range(11)}


def test_store_gives_back_all_ids(spark, docs):
    path = fresh_dir(spark, "store")
    chunkstore.write_store(docs, path, WORD)
    want, start = whole(WORD, TEXTS), 0
    got = {r.doc_id: r for r in chunkstore.read_digests(spark, path).collect()}
    full = {r.doc_id: r for r in chunkstore.read_documents(spark, path).collect()}
    assert len(got) == len(full) == len(TEXTS)
    for i, ids in enumerate(want):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].verified) == (start, len(ids), zlib.crc32(ids.tobytes()), True)
        assert bytes(full[i].ids) == ids.tobytes()
        start += len(ids)
    assert chunkstore.verify(spark, path)


def test_chunks_are_stored_once_and_no_more(spark):
    text = " ".join(f"word{i * i}" for i in range(3000))
    path = fresh_dir(spark, "store")
    frame = spark.createDataFrame([(i, ("x" * i) + " " + text) for i in range(20)], "doc_id long, text string")
    chunkstore.write_store(frame.repartition(5), path, WORD)
    chunks = spark.read.parquet(f"{path}/objects").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("address").distinct().count()
    assert chunks.agg({"n": "sum"}).first()[0] < 3 * chunkstore.read_digests(spark, path).agg({"n_tokens": "max"}).first()[0]


def test_crc_of_parts():
    parts = [b"abc", b"", bytes(range(200))]
    assert chunkstore.crc_joined([(len(x), zlib.crc32(x)) for x in parts]) == zlib.crc32(b"".join(parts))


def test_empty_store(spark, docs):
    path = fresh_dir(spark, "store")
    chunkstore.write_store(docs.limit(0), path, WORD)
    assert chunkstore.read_digests(spark, path).count() == 0


def check_packing(rows, want, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == dict(enumerate(want)).keys()
    for i, ids in enumerate(want):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(parts):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_packing_is_whole_and_tight(spark, docs):
    want = whole(BYTE, TEXTS)
    check_packing(packing.pack_documents(docs, BYTE).collect(), want, 1024)
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [r.text for r in data.orderBy("doc_id").collect()]
    want = whole(BYTE, texts)
    n = check_packing(packing.pack_documents(data, BYTE, shard_size=256).collect(), want, 1024)
    assert n <= 1.01 * sum(map(len, want)) / 1024 + 1
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_sequences_hold_the_ids(spark, docs):
    rows = packing.sequences(docs, BYTE).collect()
    assert sum(len(r.ids) for r in rows) == 4 * sum(map(len, whole(BYTE, TEXTS)))


def test_sequences_of_null_and_repeated_ids(spark):
    rows = [(None, "one text"), (None, "another, longer text"), (4, "first of four"), (4, "second of four, not the first"), (5, None), (5, None), (6, "word " * 3000)]
    got = packing.sequences(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect()
    enc = Tokenizer.from_file(BYTE)
    want = [np.array(enc.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, t in rows]
    found: dict = {}
    for r in got:
        assert len(r.ids) == 4 * r.n_tokens == 4 * sum(p.length for p in r.parts)
        for p in r.parts:
            found.setdefault((p.doc_id, p.length if p.doc_id != 6 else 0), []).append((p.piece, bytes(r.ids)[4 * p.offset : 4 * (p.offset + p.length)]))
    whole = [b"".join(x for _, x in sorted(found.pop((6, 0))))] + [x for parts in found.values() for _, x in parts]
    assert sorted(whole) == sorted(want)


def test_evolution_beats_best_fit_where_pieces_come_in_threes():
    rng = random.Random(100)
    sizes = []
    for _ in range(100):  # three pieces fill a sequence, which best fit by falling size rarely finds
        a = rng.randint(260, 490)
        b = rng.randint(260, min(490, 1024 - a - 250))
        sizes += [a, b, 1024 - a - b]
    plain = len(packing._Shard(sizes, 1024, 1).start(False))
    for generations, population in ((3, 4), (20, 8)):
        found = packing._Shard(sizes, 1024, 1).evolve([], generations, population)[0]
        assert len(found) < plain  # 111 and 110 to 113 when this was written; 100 is the bound
        assert sorted(x for _, c in found for x in c) == list(range(len(sizes))) and all(sum(sizes[x] for x in c) == f <= 1024 for f, c in found)


def test_shards_need_no_more_sequences_than_the_whole(spark):
    pieces = packing.cut_pieces(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), BYTE).cache()
    sizes = [r.length for r in pieces.filter("length < 1024").select("length").collect()]
    whole = len(packing._Shard(sizes, 1024, 1).start(False)) + pieces.filter("length = 1024").count()
    assert packing.pack(pieces).select("sequence_id").distinct().count() <= whole
    pieces.unpersist()
