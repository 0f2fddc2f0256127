"""Operator 5. Language identification by nearest centroids.

Method: a text is a TF-IDF vector of hashed character trigrams (word edges included), scaled to length 1. Each language
has several centroids (spherical k-means over a sample of its texts). A text gets the language of the centroid with the
largest cosine; it is marked rejected if that cosine is below what the centroid's own members have (distance-based
rejection). Document frequencies come from all learning rows; the clusters from a sample of them that is bounded by the
parameter ``per_language``.

Null texts, and texts without letters, are ``und`` with score 0. A single short word is classified like any text. With
no learning rows every text is ``und``. Texts are read whole however long, in blocks of rows. Repeated rows, equal and null
doc_ids are each learned from and predicted; equal texts get equal predictions, and of centroids that tie the first counts
(languages in alphabetic order). An empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canongraph.llm.common import bound_batches, letter_codes, tidy
from canongraph.llm.tokens import text_groups

DIMS = 4096
ROWS = 256  # rows that are held as dense vectors at a time


def trigram_counts(texts: list[str | None]):
    """(first row, dense counts, letters) for blocks of rows."""
    for a, b in text_groups(texts, 1_000_000):
        codes, row = letter_codes(texts[a:b])
        gram = ((codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) * 2654435761 >> 7) & (DIMS - 1)
        inside = (row[2:] == row[:-2]) & ((codes[1:-1] != 0) | (codes[:-2] != 0) & (codes[2:] != 0))
        letters = np.bincount(row[codes != 0], minlength=b - a)
        for x in range(0, b - a, ROWS):
            y = min(b - a, x + ROWS)
            mine = inside & (row[2:] >= x) & (row[2:] < y)
            dense = np.bincount((row[2:][mine] - x) * DIMS + gram[mine], minlength=(y - x) * DIMS).reshape(y - x, DIMS)
            yield a + x, dense, letters[x:y]


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts.astype(np.float32)) * idf
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=v, where=n > 0)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """How many texts there are, and in how many each trigram bucket occurs: over all rows, summed by Spark."""

    def count(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, dense, letters in trigram_counts(batch.column(0).to_pylist()):
                df += (dense > 0).sum(0)
                n += int((letters > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.r_[n, df])], names=["dim", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(tidy(count), "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in rows:
        out[r.dim + 1] = r.n
    return int(out[0]), out[1:]


def cluster(vectors: np.ndarray, k: int, seed: int = 3, turns: int = 12) -> np.ndarray:
    """Centroids of length 1, by spherical k-means from spread-out starts."""
    rng = np.random.default_rng(seed)
    k = min(k, len(vectors))
    centers = vectors[[int(rng.integers(len(vectors)))]]
    while len(centers) < k:
        far = (vectors @ centers.T).max(1)
        centers = np.vstack([centers, vectors[int(far.argmin())]])
    for _ in range(turns):
        of = (vectors @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, vectors)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(n > 0, sums / np.where(n > 0, n, 1), centers)
    return centers


class Model:
    """Centroids with their languages and the least cosine that is not rejected."""

    def __init__(self, idf, centers, langs, least):
        self.idf, self.centers, self.langs, self.least = idf, centers, langs, least


def fit(docs: DataFrame, clusters: int = 4, per_language: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Learns from all rows with a non-null language; clusters from about ``per_language`` rows of each at most."""
    bound_batches(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    n, df = document_frequencies(known)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1
    share = F.create_map(*[F.lit(x) for lang, size in sizes.items() for x in (lang, per_language / size)])
    chance = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(chance < share[F.col("lang")])

    def sparse(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, dense, letters in trigram_counts(batch.column(0).to_pylist()):
                ok = np.flatnonzero(letters > 0)
                rows = [(langs[first + i], np.flatnonzero(dense[i]).astype("<u2").tobytes(), dense[i][dense[i] > 0].astype("<u4").tobytes()) for i in ok]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "dims", "counts"])

    by_lang: dict[str, list] = {}
    for r in sample.select("text", "lang").mapInArrow(tidy(sparse), "lang string, dims binary, counts binary").collect():
        by_lang.setdefault(r.lang, []).append(r)
    centers, langs, least = [], [], []
    for lang in sorted(by_lang):
        rows = by_lang[lang]
        counts = np.zeros((len(rows), DIMS), np.float32)
        for i, r in enumerate(rows):
            counts[i, np.frombuffer(r.dims, "<u2")] = np.frombuffer(r.counts, "<u4")
        vectors = unit(counts, idf)
        c = cluster(vectors, clusters)
        best = vectors @ c.T
        for j in range(len(c)):
            own = best[best.argmax(1) == j, j]
            centers.append(c[j])
            langs.append(lang)
            least.append(float(np.quantile(own, 0.02)) * 0.6 if len(own) else 0.0)
    return Model(idf, np.stack(centers), langs, np.array(least)) if centers else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected): score is the cosine to the nearest centroid."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids: languages x clusters x DIMS floats

    def run(batches):
        m = shared.value
        for batch in batches:
            pred, score, rejected = [], [], []
            for _, dense, letters in trigram_counts(batch.column(1).to_pylist()):
                if m is None:
                    pred += ["und"] * len(letters)
                    score += [0.0] * len(letters)
                    rejected += [True] * len(letters)
                    continue
                cos = unit(dense, m.idf) @ m.centers.T
                best = cos.argmax(1)
                top = cos[np.arange(len(best)), best]
                none = letters == 0
                pred += ["und" if z else m.langs[b] for z, b in zip(none, best)]
                score += np.where(none, 0.0, np.clip(top, 0, 1)).tolist()
                rejected += (none | (top < m.least[best])).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double, rejected boolean")
