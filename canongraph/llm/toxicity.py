"""Operator 4. Toxicity by noisy-channel restoration and learned word evidence.

Method: obfuscated spellings (leetspeak, letters spaced out, letters repeated) are read as the output of a noisy channel.
For each such token a lattice of possible characters is decoded by Viterbi (exactly: the state is the last two characters)
under a character trigram language model that is counted over all texts. The restored words, with the plain ones, are then scored: each word's toxic rate is estimated
from labelled texts, backing off from the whole word over its beginnings to the overall rate, and a logistic regression
over a text's strongest words gives its score.

The language model covers every text and holds every trigram of letters found, with its exact count; it grows with the
letters in use, not with the rows. Labels are learned from a sample of the labelled learning rows that is bounded by
``max_labelled``; its words and the model are bounded with it. Labels that are null are ignored; of repeated labels of
one document the largest counts. Null, empty and wordless texts get the score of a text without evidence. Very long texts and
tokens are read whole, in time that grows with their length. Repeated rows are scored each, and equal texts equally; of readings that tie the first found counts.
With no labelled rows of both kinds, every score is the share of toxic ones (0 if there are none). An empty table gives an
empty result. Further columns are ignored; of those asked for with ``keep``, one called ``score`` gives way.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canongraph.llm.common import bound_batches, cut, letter_codes, tidy
from canongraph.llm.tokens import text_groups

#: What a written character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "¡": "i", "£": "l", "§": "s"}
GAPS = " .-_*·"
_WORD = re.compile(r"[^\W\d_]+")
_SWITCH = re.compile(r"[0-9@$!|+€(<¡£§](?=[^\W\d_])|[^\W\d_](?=[0-9@$€£§])")
_SIGNS, _PARTS = "0123456789@$!|+€(<¡£§", re.compile(r"[\s,;:\"?]")
_RUN, _RUNS = re.compile(r"([^\W\d_])\1\1"), re.compile(r"([^\W\d_])\1{16,}")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[ .\-_*·][\w@$!|+€]){3,}(?!\w)")


#: Letters of a block up to which trigrams are counted in a dense table; lookups that a worker remembers.
DENSE, REMEMBERED = 128, 100_000


class CharModel:
    """log P(character | two before it) from counts; 0 stands for a word's edge."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys: trigrams as (a << 42 | b << 21 | c), sorted."""
        self.keys, self.counts = keys, counts
        first = np.flatnonzero(np.r_[True, keys[1:] >> 21 != keys[:-1] >> 21]) if len(keys) else np.zeros(0, np.int64)
        self.pairs, self.pair_counts = keys[first] >> 21, np.add.reduceat(counts, first) if len(keys) else counts
        self.memo: dict[int, float] = {}

    def __reduce__(self):
        return CharModel, (self.keys, self.counts)

    @staticmethod
    def _count(keys, counts, key: int) -> int:
        i = int(np.searchsorted(keys, key))
        return int(counts[i]) if i < len(keys) and keys[i] == key else 0

    def __call__(self, a: int, b: int, c: int) -> float:
        key = a << 42 | b << 21 | c
        p = self.memo.get(key)
        if p is None:
            if len(self.memo) > REMEMBERED:
                self.memo.clear()
            p = self.memo[key] = math.log((self._count(self.keys, self.counts, key) + 0.05) / (self._count(self.pairs, self.pair_counts, key >> 21) + 5.0))
        return p


def trigrams(c: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram keys and counts of texts as letter_codes gives them; nothing is seen across a word's edge."""
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    c, row = np.insert(c, start, 0), np.insert(row, start, row[start])  # a text's first word begins like the others
    ok = (row[2:] == row[:-2]) & ((c[1:-1] != 0) | (c[2:] != 0))
    present = np.flatnonzero(np.bincount(c))
    if len(present) > DENSE:
        first = np.where(c[1:-1] == 0, 0, c[:-2])
        return np.unique((first << 42 | c[1:-1] << 21 | c[2:])[ok], return_counts=True)
    # few letters: count in a dense table over their ranks; the edge has rank 0
    present = np.union1d(present, [0])
    rank = np.zeros(int(present[-1]) + 1, np.int64)
    rank[present] = np.arange(len(present))
    c, n = rank[c], len(present)
    first = np.where(c[1:-1] == 0, 0, c[:-2])
    table = np.bincount(((first * n + c[1:-1]) * n + c[2:])[ok], minlength=1)
    at = np.flatnonzero(table)
    return present[at // (n * n)] << 42 | present[at // n % n] << 21 | present[at % n], table[at]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    """Counts trigrams over all texts; tasks sum theirs, Spark sums the tasks'. The driver gets a row for each trigram of letters in use."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in text_groups(texts, 1_000_000):
                c, row = letter_codes(texts[a:b])
                held.append(trigrams(c, row))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [_summed(held)]
                    size = 0
                    if len(held[0][0]) > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["key", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(held)], names=["key", "n"])

    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(tidy(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    return CharModel(sums["key"].to_numpy(np.int64), sums["n"].to_numpy(np.int64))


def ways_of(x: str, last: str) -> list[tuple[str, float]]:
    """What a written character may stand for, with log weights; "" if nothing was meant, " " for a word's edge."""
    if x in GAPS:
        return [("", -0.4), (" ", -1.2)]
    ways = [(x, -0.02)] if x.isalpha() else []
    ways += [(c, -0.7) for c in LEET.get(x, "")]
    if x == last:
        ways.append(("", -0.3))
    if not ways or x not in LEET and not x.isalpha():
        ways.append((" ", -3.0))
    elif not x.isalpha():
        ways.append((" ", -4.0))
    return ways


def mixed(token: str) -> list[str]:
    """Parts of a token in which letters and signs take turns: from the letters and digits before the first such place to the
    next mark that parts words. One pass over the token."""
    out, at = [], 0
    while found := _SWITCH.search(token, at):
        first = found.start()
        while first > at and token[found.start()] in _SIGNS and token[first - 1] in _SIGNS:
            first -= 1
        while first > at and token[first - 1].isalnum():
            first -= 1
        end = _PARTS.search(token, found.end())
        at = end.start() if end else len(token)
        out.append(token[first:at])
    return out


def restore(token: str, model) -> str:
    """The likeliest reading of a written token (Viterbi over its lattice); may hold spaces where gaps part words.

    After two letters that can only stand for themselves one state is left. So the stretches between such pairs are decoded by
    themselves, and what lies outside is taken as it is. Copies of a letter that are likelier dropped than kept count up to 16.
    """
    token = _RUNS.sub(lambda m: m[0] if model(*[ord(m[1])] * 3) > -0.28 else m[1] * 16, token)
    sure = [x.isalpha() and x not in LEET and x != last for x, last in zip(token, " " + token)]
    out, at, n = [], 0, len(token)
    while at < n:
        if sure[at]:
            nearest = sure.index(False, at) if False in sure[at : at + 64] else next((i for i in range(at, n) if not sure[i]), n)
            out.append(token[at:nearest])
            at = nearest
            continue
        end = at + 1
        while end < n and not (sure[end - 1] and sure[end - 2] and end - at > 2):
            end += 1
        before = (ord(token[at - 2]) if at > 1 else 0, ord(token[at - 1]) if at else 0)
        out.append(_decode(token[at:end], token[at - 1] if at else "", before, end == n, model))
        at = end
    return "".join(out).strip()


def _decode(token: str, last: str, before: tuple[int, int], ends: bool, model) -> str:
    """A stretch of a token after the character ``last``, read after the two characters ``before``."""
    # state: last two characters; value: log probability, and the characters read as (last, (one before, ...))
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {before: (0.0, None)}
    for x in token:
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for c, q in ways_of(x, last):
            o = ord(c) if c else 0
            for (a, b), (p, read) in states.items():
                if c == "":
                    key, p, read = (a, b), p + q, read
                elif c == " ":
                    key = (0, 0)
                    p, read = (p + q, read) if b == 0 else (p + q + model(a, b, 0), (c, read))
                else:
                    key, p, read = (b, o), p + q + model(a if b else 0, b, o), (c, read)
                if key not in new or new[key][0] < p:
                    new[key] = p, read
        states, last = new, x
    read = max(((p + (model(a, b, 0) if b and ends else 0.0), i, read) for i, ((a, b), (p, read)) in enumerate(states.items())), key=lambda x: (x[0], -x[1]))[2]
    out = []
    while read is not None:
        out.append(read[0])
        read = read[1]
    return "".join(out[::-1])


def words_of_token(token: str, model: CharModel) -> set[str]:
    """Plain words of a lower-case token and, if it looks obfuscated, the restored ones."""
    out = set(_WORD.findall(token))
    if not token.isalpha():
        for m in mixed(token):
            m = m.strip("!|+().*-_'#%&$" if not m.startswith(("$", "!", "|", "(")) else ")*-_'#%&")
            if sum(c.isalpha() for c in m) >= 2 and any(c in LEET for c in m):
                out.update(restore(m, model).split())
    for w in [w for w in out if _RUN.search(w)]:
        out.update(restore(w, model).split())
    return out


class Reader:
    """Words of texts with a memo of tokens; keeps only words that ``of`` gives a value."""

    def __init__(self, model: CharModel, of=None, most: int = 120_000):
        self.model, self.of, self.most, self.memo = model, of, most, {}

    def _token(self, t: str):
        words = words_of_token(t, self.model)
        return tuple(words) if self.of is None else tuple((w, v) for w in words if (v := self.of(w)) > 0)

    def __call__(self, text: str | None) -> tuple[set, int]:
        """(words or (word, value) pairs, number of distinct tokens)."""
        low = (text or "").lower()
        tokens, memo, out = set(low.split()), self.memo, set()
        if len(memo) > self.most:
            memo.clear()
        for t in tokens:
            got = memo.get(t)
            if got is None:
                got = memo[t] = self._token(t)
            if got:
                out.update(got)
        for m in _SPACED.findall(low):
            words = restore(m, self.model).split()
            words.append("".join(words))  # spaced-out letters of one long word may have been parted
            out.update(words if self.of is None else ((w, v) for w in words if (v := self.of(w)) > 0))
        return out, len(tokens)


def parts(word: str) -> list[str]:
    """A word's beginnings from three to eight letters, then the whole word."""
    return [*(word[:k] for k in range(3, min(9, len(word) + 1))), word + "$"]


class Evidence:
    """Toxic rate of words: from the longest known part, each part's rate being drawn to that of the part before."""

    def __init__(self, counts: dict[str, tuple[int, int]], rate: float, pull: float = 3.0):
        self.base = math.log(rate / (1 - rate))
        self.rates: dict[str, float] = {}
        for f in sorted(counts, key=lambda f: (f.endswith("$"), len(f))):
            a, b = counts[f]
            stem, r = f.rstrip("$"), rate
            for k in range(min(8, len(stem) - (not f.endswith("$"))), 2, -1):
                if stem[:k] in self.rates:
                    r = self.rates[stem[:k]]
                    break
            self.rates[f] = min(max((a + pull * r) / (a + b + pull), 1e-6), 1 - 1e-6)

    def __call__(self, word: str) -> float:
        rates = self.rates
        r = rates.get(word + "$")
        if r is None:
            for k in range(min(8, len(word)), 2, -1):
                r = rates.get(word[:k])
                if r is not None:
                    break
            else:
                return 0.0
        return max(0.0, math.log(r / (1 - r)) - self.base)


def features(found: set, n: int) -> list[float]:
    top = sorted((v for _, v in found), reverse=True)[:4]
    return [1.0, *top, *[0.0] * (4 - len(top)), math.log1p(n)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = ridge * np.r_[0, np.ones(x.shape[1] - 1)]
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, chars: CharModel, evidence: Evidence | None, weights, share: float):
        self.chars, self.evidence, self.weights, self.share = chars, evidence, weights, share


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, chars: CharModel | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """docs: all texts (for the language model). labels: the learning rows only."""
    spark = docs.sparkSession
    bound_batches(spark)
    chars = chars or char_model(docs, text_col)
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    n = rows.count()
    if n > max_labelled:
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * max_labelled / n))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int"))
    # at most about max_labelled ids and two small numbers each: bounded by the parameter
    texts = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(rows), "id").select("text", "y", "half"))
    known = {(r.half, r.y): r.n for r in texts.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    total = sum(known.values())
    share = sum(v for (_, y), v in known.items() if y) / total if total else 0.0
    if not 0 < share < 1:
        return Model(chars, None, None, share)
    lm = spark.sparkContext.broadcast(chars)

    def count(batches):
        read = Reader(lm.value)
        sums: dict[str, list[int]] = {}

        def out():
            columns = [pa.array(list(sums), pa.string()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in range(4))]
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, names=["part", "b0", "a0", "b1", "a1"])

        for batch in batches:
            for text, y, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for w in read(text.as_py())[0]:
                    for f in parts(w):
                        sums.setdefault(f, [0, 0, 0, 0])[2 * half + (y > 0)] += 1
                if len(sums) > 100_000:
                    yield out()
        if sums:
            yield out()

    table = cut(texts.mapInArrow(tidy(count), "part string, b0 long, a0 long, b1 long, a1 long").groupBy("part").agg(*[F.sum(c).alias(c) for c in ("b0", "a0", "b1", "a1")]))
    sums = table.filter(F.col("part").endswith("$")).agg(*[F.sum(c).alias(c) for c in ("b0", "a0", "b1", "a1")]).first().asDict()
    models = {"0": ("a0", "b0"), "1": ("a1", "b1"), "all": ("a0 + a1", "b0 + b1")}
    rates = {"0": sums["a0"] / max(1, sums["a0"] + sums["b0"]), "1": sums["a1"] / max(1, sums["a1"] + sums["b1"]), "all": (sums["a0"] + sums["a1"]) / max(1, sum(sums.values()))}
    rates = {k: min(max(r, 1e-6), 1 - 1e-6) for k, r in rates.items()}
    least = "(case when part like '%$' then 2 else 3 end)"
    clear = " or ".join(f"({a} >= {least} and ({a} - ({a} + {b}) * {rates[k]}) / sqrt(({a} + {b}) * {rates[k] * (1 - rates[k])}) > 3)" for k, (a, b) in models.items())
    roots = spark.sparkContext.broadcast({r.part for r in table.filter(clear).select("part").collect()})

    def under(batches):
        for batch in batches:
            keep = [any(p in roots.value for p in (*(f[:k] for k in range(3, len(f) + 1)),)) for f in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    counts = table.mapInArrow(tidy(under), table.schema).toPandas()
    pick = {"0": (counts.a0, counts.b0), "1": (counts.a1, counts.b1), "all": (counts.a0 + counts.a1, counts.b0 + counts.b1)}
    evidence = {k: Evidence(dict(zip(counts.part, zip(a.tolist(), b.tolist()))), rates[k]) for k, (a, b) in pick.items()}
    halves = spark.sparkContext.broadcast((evidence["0"], evidence["1"]))

    def look(batches):
        # each half is judged by what the other half taught
        readers = [Reader(lm.value, halves.value[1 - h]) for h in (0, 1)]
        for batch in batches:
            x = [features(*readers[half](text.as_py())) for text, half in zip(batch.column(0), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    seen = texts.mapInArrow(tidy(look), "x array<double>, y int").toPandas()
    weights = logistic(np.stack(seen["x"].to_numpy()), (seen["y"].to_numpy() > 0).astype(float))
    return Model(chars, evidence["all"], weights, share)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, score) of each text, or the columns ``keep`` with a column ``score`` added."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in keep or [id_col] if c != "score"]
    source = docs.select(*[F.col(c) for c in cols], F.col(text_col).cast("string").alias("__text"))
    schema = docs.select(*cols).schema.add("score", "double")

    def run(batches):
        m = shared.value
        read = Reader(m.chars, m.evidence or (lambda w: 0.0))
        for batch in batches:
            if m.evidence is None:
                s = np.full(batch.num_rows, m.share)
            else:
                x = np.array([features(*read(t.as_py())) for t in batch.column(batch.num_columns - 1)]).reshape(-1, 6)
                s = 1 / (1 + np.exp(-np.clip(x @ m.weights, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(s, pa.float64())], names=[*cols, "score"])

    return source.mapInArrow(tidy(run), schema)
