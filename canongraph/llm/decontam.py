"""Operator 8. Benchmark decontamination: documents that hold test items, also edited or paraphrased.

Method: rare seeds. An item's seeds are its rarest words, by frequencies counted over all documents. A document's passage around a seed is aligned with the item by Smith-Waterman over words (match +2,
other -1); the score is the best local alignment over twice the item's words, 1 for a whole copy.

Nothing that reaches the score is passed over. It takes M = ceil(least * L) matches among the item's L words, so of its
L - M + k rarest words k match or more, however the others were edited: passages with fewer seeds are not looked at. The
errors are 2 * L * (1 - least) at most, and passages reach as far on both sides. Passages with less than M words of the item,
repeats counted, are not aligned.

Words are runs of letters and digits (any non-ASCII byte counts as a letter), A-Z lower-cased, compared by 64-bit hash.
Items of one or two words are searched by all their words in a row; items without words match nothing. Null
and empty texts hold nothing; very long texts are searched whole, long passages in overlapping windows. Repeated rows and
doc_ids, null ones too, give rows each, as do items of one item_id or of a null one; of alignments that tie, the first counts. Empty tables
give an empty result. Further columns are ignored, whatever their names. Items go to the tasks in slices of bounded size, so any number
of items works; with more than one slice the documents are read once a slice.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.llm.common import BASE, PUNCTUATION, blocks, bound_batches, mix, raw_bytes, tidy, words_of

#: Items in a slice, and bytes of their texts, at most: bounds what is broadcast.
SLICE, SLICE_BYTES = 100_000, 1 << 25
#: Items up to so many words are searched by all of them in a row; seeds that a passage needs, if the item has as many to spare.
SHORT, SEEDS = 2, 4
#: Aligned together: pairs, and words of their passages with padding.
TOGETHER, CELLS = 512, 1 << 18


def grams(word: np.ndarray, row: np.ndarray, n: int):
    """Hash and first word of each run of n words within a row."""
    if len(word) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    h = np.full(len(at), n, np.uint64)
    for i in range(n):
        h = h * np.uint64(BASE) + word[at + i]
    return mix(h), at


class Among:
    """Finds hashes in a sorted array of distinct ones; a table of low bits turns most others away before they are searched."""

    def __init__(self, known: np.ndarray):
        self.known, self.mask = known, np.uint64((1 << min(22, max(12, (16 * len(known)).bit_length()))) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[(known & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``h`` holds a known hash, and its number."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        same = self.known[k] == h[at]
        return at[same], k[same]


class Seeds:
    """Hashes of seeds, and the items and places of each."""

    def __init__(self, gram: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(gram, kind="stable")
        self.item, self.place = item[order], place[order]
        known, first = np.unique(gram[order], return_index=True)
        self.among, self.edges = Among(known), np.r_[first, len(gram)]

    def __len__(self) -> int:
        return len(self.item)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index in ``h``, item, place) of all seeds."""
        at, k = self.among.find(h)
        lo, n = self.edges[k], self.edges[k + 1] - self.edges[k]
        which = ranges(lo, n)
        return np.repeat(at, n), self.item[which], self.place[which]


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), then those of start[1], and so on."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Items:
    """Word hashes of items, of whose words a share of ``least`` or more must match."""

    def __init__(self, ids: list[int], texts: list[str | None], least: float):
        data, at = raw_bytes(pa.array(texts, pa.string()))
        word, row, _, _ = words_of(data, at, PUNCTUATION)
        edges = np.searchsorted(row, np.arange(len(texts) + 1))
        self.ids, self.words = list(ids), [word[a:b] for a, b in zip(edges, edges[1:])]
        self.lengths = np.diff(edges)
        self.needed = np.array([math.ceil(least * n - 1e-9) for n in self.lengths.tolist()], np.int64)
        # every item's distinct words, under one sorted list of (word, item) keys, and how often it has each
        self.vocabulary = Among(np.unique(word))
        key, times = np.unique(self._keys(np.searchsorted(self.vocabulary.known, word), row), return_counts=True)
        self.bag, self.times = Among(key), times
        lengths = self.lengths.tolist()
        self.least = np.array([max(1, min(SEEDS, m)) if n > SHORT else 1 for n, m in zip(lengths, self.needed.tolist())], np.int64)
        self.rarest = [min(n, n - m + k) if n > SHORT else 0 for n, m, k in zip(lengths, self.needed.tolist(), self.least.tolist())]
        self.sizes = sorted({n if n <= SHORT else 1 for n in lengths if n})

    def singles(self) -> np.ndarray:
        """Hashes, sorted, of all words of the items that have rarest words for seeds."""
        some = [w for w, n in zip(self.words, self.rarest) if n]
        return np.unique(grams(np.concatenate(some), np.zeros(sum(map(len, some)), np.int64), 1)[0]) if some else np.zeros(0, np.uint64)

    def seeds(self, known: np.ndarray, count: np.ndarray) -> Seeds:
        gram, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(self.words):
            row = np.zeros(len(w), np.int64)
            if not len(w):
                continue
            h, a = grams(w, row, len(w) if len(w) <= SHORT else 1)
            if self.rarest[i]:
                few = np.argsort(count[np.searchsorted(known, h)], kind="stable")[: self.rarest[i]]
                h, a = h[few], a[few]
            gram.append(h)
            item.append(np.full(len(h), i))
            place.append(a)
        return Seeds(*(np.concatenate(x) for x in (gram, item, place)))

    def _keys(self, code: np.ndarray, item: np.ndarray) -> np.ndarray:
        """One number for a word of the vocabulary and an item, mixed without collisions."""
        return mix(item.astype(np.uint64) * np.uint64(max(1, len(self.vocabulary.known))) + code.astype(np.uint64))

    def may_hold(self, item: np.ndarray, start: np.ndarray, stop: np.ndarray, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Which passages start:stop have as many words of their item as it takes, each as often as the item at most.

        ``at`` and ``code``: places of all words that any item has, and their numbers in the vocabulary.
        """
        lo, hi = np.searchsorted(at, start), np.searchsorted(at, stop)
        out = hi - lo >= self.needed[item]
        some, first = np.flatnonzero(out), 0
        sums = np.cumsum((hi - lo)[some])
        while first < len(some):  # so many words at a time
            last = max(first + 1, int(np.searchsorted(sums, (sums[first - 1] if first else 0) + CELLS, "right")))
            part = some[first:last]
            n = (hi - lo)[part]
            where, k = self.bag.find(self._keys(code[ranges(lo[part], n)], np.repeat(item[part], n)))
            both, times = np.unique(np.repeat(np.arange(len(part)), n)[where] * len(self.times) + k, return_counts=True)
            found = np.bincount(both // len(self.times), np.minimum(times, self.times[both % len(self.times)]), len(part))
            out[part] = found >= self.needed[item[part]]
            first = last
        return out


def _document_words(column: pa.Array):
    """(first row, word hashes, rows) for blocks of rows."""
    data, at = raw_bytes(column)
    for a, b in blocks(at):
        word, row, _, _ = words_of(data[at[a] : at[b]], at[a : b + 1] - at[a], PUNCTUATION)
        yield a, word, row


def align(pairs: list[tuple[np.ndarray, np.ndarray]]):
    """Smith-Waterman scores of (item words, passage words) pairs, and the passage words after the best end."""
    score, end = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: (-len(pairs[i][1]), len(pairs[i][0])))
    x = 0
    while x < len(order):
        wide = len(pairs[order[x]][1])
        some = order[x : x + max(1, min(TOGETHER, CELLS // max(1, wide)))]
        x += len(some)
        tall = max(len(pairs[i][0]) for i in some)
        # pairs lie side by side, so that every step runs along memory
        passage, item = np.zeros((wide, len(some)), np.uint64), np.full((tall, len(some)), 1, np.uint64)
        for k, i in enumerate(some):
            item[: len(pairs[i][0]), k] = pairs[i][0]
            passage[: len(pairs[i][1]), k] = pairs[i][1]
        kind = np.int16 if wide + 2 * tall < 1 << 15 else np.int32
        before, now, same = np.zeros((wide + 1, len(some)), kind), np.zeros((wide + 1, len(some)), kind), np.zeros((wide, len(some)), kind)
        slope = np.arange(wide + 1, dtype=kind)[:, None]
        best, at = np.zeros(len(some), kind), np.zeros(len(some), np.int64)
        for j in range(tall):
            np.multiply(passage == item[j], kind(3), out=same)
            same -= kind(1)
            same += before[:-1]
            np.subtract(before[1:], kind(1), out=now[1:])
            np.maximum(now[1:], same, out=now[1:])
            now[0] = 0
            np.maximum(now, 0, out=now)
            now += slope
            np.maximum.accumulate(now, axis=0, out=now)  # gaps along the passage
            now -= slope
            value = now.max(axis=0)
            better = np.flatnonzero(value > best)
            best[better], at[better] = value[better], now[:, better].argmax(axis=0)
            before, now = now, before
        score[some], end[some] = best, at
    return score, end


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, matched_end): each document's best alignment with each item it holds, if score >= least.

    ``matched_end`` is the number of document words up to where the alignment ends.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    slices = max(1, -(-n // SLICE), -(-(size or 0) // SLICE_BYTES))
    out = None
    for s in range(slices):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).orderBy("item_id", "text").collect()  # about SLICE rows
        got = _search(docs, Items([r.item_id for r in own], [r.text for r in own], least), least)
        out = got if out is None else out.unionByName(got)
    return out


def rare_seeds(docs: DataFrame, items: Items):
    """The items' seeds, by frequencies of words counted over all ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    known = items.singles()
    if not len(known):
        return items.seeds(known, np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast(known)  # words of one slice of items

    def count(batches):
        among = Among(shared.value)
        n = np.zeros(len(among.known), np.int64)
        for batch in batches:
            for _, word, row in _document_words(batch.column(1)):
                n += np.bincount(among.find(grams(word, row, 1)[0])[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(n[at])], names=["gram", "n"])

    n = np.zeros(len(known), np.int64)
    for r in docs.mapInArrow(tidy(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        n[r.gram] = r.n
    return items.seeds(known, n)


def passages(column: pa.Array, items: Items, seeds: Seeds, reach: np.ndarray):
    """For blocks of rows: lists of (row, item, place of the passage in the row's words) and of the passages' words.

    Passages go ``reach`` words, given for each item, beyond where its seeds place it.
    """
    for first, word, row in _document_words(column):
        if not len(row) or not len(seeds):
            continue
        edges = np.searchsorted(row, np.arange(int(row[-1]) + 2))
        hits = []
        for n in items.sizes:
            h, at = grams(word, row, n)
            k, of, place = seeds.hits(h)
            hits.append((row[at[k]], of, at[k] - place))
        d, i, diagonal = (np.concatenate(c) for c in zip(*hits))
        if not len(d):
            continue
        order = np.lexsort((diagonal, i, d))
        d, i, diagonal = d[order], i[order], diagonal[order]
        slack = reach[i]
        new = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (diagonal[1:] - diagonal[:-1] > slack[1:])]
        start = np.flatnonzero(new)
        stop = np.r_[start[1:], len(d)] - 1
        enough = stop - start + 1 >= items.least[i[start]]
        start, stop = start[enough], stop[enough]
        doc, item = d[start], i[start]
        s, n = slack[start], items.lengths[item]
        x = np.maximum(edges[doc], diagonal[start] - s)
        y = np.minimum(edges[doc + 1], diagonal[stop] + n + s)
        # seeds close together make one passage; a long one is read in windows that overlap by what an item takes
        step = n + 2 * s
        windows = np.maximum(1, -((x - y) // step) - 1)
        of = np.repeat(np.arange(len(x)), windows)
        z = x[of] + ranges(np.zeros(len(x), np.int64), windows) * step[of]
        last = np.minimum(z + 2 * step[of], y[of])
        held = np.flatnonzero(items.may_hold(item[of], z, last, *items.vocabulary.find(word)))
        of, z, last = of[held], z[held], last[held]
        where = list(zip((first + doc[of]).tolist(), item[of].tolist(), (z - edges[doc[of]]).tolist()))
        words = [word[a:b] for a, b in zip(z.tolist(), last.tolist())]
        yield where, words


def _search(docs: DataFrame, items: Items, least: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((items, rare_seeds(docs, items)))

    def search(batches):
        items, seeds = shared.value
        reach = np.array([math.ceil(2 * n * (1 - least)) + 1 for n in items.lengths.tolist()], np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for where, words in passages(batch.column(1), items, seeds, reach):
                score, end = align([(items.words[i], w) for (_, i, _), w in zip(where, words)])
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for (doc, item, x), v, e in zip(where, score.tolist(), end.tolist()):
                    v /= 2 * int(items.lengths[item])
                    if v >= least and v > best.get((doc, item), (0.0, 0))[0]:
                        best[doc, item] = (v, x + e)
                rows += [(ids[doc], items.ids[item], v, e) for (doc, item), (v, e) in best.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["doc_id", "item_id", "score", "matched_end"])

    return docs.mapInArrow(tidy(search), "doc_id long, item_id long, score double, matched_end long")
