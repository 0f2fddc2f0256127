"""Token ids of whole texts by the tokenizers library, one call of its model for each distinct pre-token of a block.

Both vocabularies first split a text by a pattern and never merge across the parts, so equal parts have equal ids
wherever they stand. Numpy finds the parts of a block of texts at once, Arrow counts the distinct ones off, and only
those are given to the library. That holds for texts of ASCII and Latin letters (U+00C0 to U+024F); any other text is split by the
file's own pattern, or goes to the library whole where its normal form or an added token's content ("<|...") may matter.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa

from canongraph.llm.common import blocks, raw_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pre-tokens a worker keeps with their ids at most; all are forgotten then. Bytes of text that are looked at together. New
#: pre-tokens whose tokens are held as the library's objects at a time.
MEMO, TOGETHER, LEARNT = 600_000, 1 << 22, 4096
#: The two files' own patterns for pre-tokens.
_BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PATTERN = r"'[sS]|'[tT]|'[rR][eE]|'[vV][eE]|'[mM]|'[lL][lL]|'[dD]|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Classes of bytes; ODD bytes make a text odd, for LOOK bytes that depends on the next one.
SPACE, LETTER, DIGIT, OTHER, LOOK, ODD = 0, 1, 2, 3, 64, 128


def _classes() -> np.ndarray:
    kind = np.full(256, ODD, np.uint8)
    kind[[32, *range(9, 14)]] = SPACE
    for i in range(33, 127):
        kind[i] = LETTER if chr(i).isalpha() else DIGIT if chr(i).isdigit() else OTHER
    kind[0x80:0xC0] = LETTER  # second bytes
    kind[[0xC5, 0xC6, 0xC7, 0xC8]] = LETTER
    kind[[0xC3, 0xC4, 0xC9]] = LETTER | LOOK  # the multiplication signs; the dotted I; the end of the Latin letters
    kind[ord("<")] = OTHER | LOOK
    return kind


_KIND = _classes()
_LOWER = np.array([i + 32 if 65 <= i < 91 else i for i in range(256)], np.uint8)


def _alphabet() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _contractions(d: np.ndarray, c: np.ndarray, at: np.ndarray, folds: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes that begin 's, 't, 'm, 'd, 're, 've or 'll, and where those end."""
    q = np.flatnonzero(d == 39)
    row = np.searchsorted(at, q, "right") - 1
    first = q == at[row]
    before = np.maximum(q - 1, 0)
    free = first | (c[before] != OTHER) & (folds | (d[before] != 32))
    q, stop = q[free], at[row[free] + 1]
    fold = np.uint8(32 if folds else 0)
    one, two = (np.where(q + k < stop, d[np.minimum(q + k, len(d) - 1)] | fold, 0) for k in (1, 2))
    short = np.isin(one, [ord(x) for x in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    some = short | long
    return q[some], q[some] + np.where(short[some], 2, 3)


def segments(d: np.ndarray, c: np.ndarray, at: np.ndarray, folds: bool) -> np.ndarray:
    """Where the pre-tokens of texts d[at[i]:at[i+1]] start; c: the bytes' classes.

    White space that a pattern drops (``folds``) goes with the pre-token after it, or makes the last one.
    """
    edge = np.zeros(len(d) + 1, bool)
    edge[at] = True
    start = edge[:-1].copy()
    start[1:] |= c[1:] != c[:-1]
    if folds:
        start |= c == DIGIT
    space = c == SPACE
    p = np.flatnonzero(space[:-1] & ~space[1:])
    p = p[~edge[p + 1]]  # the last white space before something else
    if folds:
        start[p + 1] = False
    else:
        start[p] = True
        start[p + 1] = d[p] != 32
    q, end = _contractions(d, c, at, folds)
    start[q + 1] = False
    start[end[end < len(d)]] = True
    return np.flatnonzero(start)


def _slices(column: pa.Array) -> list[bytes]:
    """The values of a binary column without nulls; cuts of one bytes object cost a fifth of to_pylist()."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    raw = data.to_pybytes() if data else b""
    return list(map(raw.__getitem__, map(slice, at, at[1:])))


class Encoder:
    """Ids as the library gives them for whole texts, without special tokens of its own."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        with open(path, encoding="utf-8") as f:
            self.folds = json.load(f)["normalizer"] is not None
        self.split = regex.compile(_WORD_PATTERN if self.folds else _BYTE_PATTERN).findall
        self.letters = _alphabet()
        self.forget()

    def forget(self) -> None:
        """Drops the memo; workers call it at the end of a task."""
        self.memo: dict[bytes, int] = {}
        self.ids, self.first, self.size = array("I"), array("q"), array("q")

    def _learn(self, parts: list[bytes]) -> None:
        """Puts new parts into the memo, numbered on."""
        keys = parts
        # byte 0xFF is in no UTF-8 text, and its letter stands for itself
        if self.folds:
            parts = b"\xff".join(parts).decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape").split(b"\xff")
        written = b"\xff".join(parts).decode("latin-1").translate(self.letters).split("\xff")
        size, before = np.zeros(len(written), np.int64), len(self.ids)
        for i in range(0, len(written), LEARNT):
            found = list(map(self.tokenize, written[i : i + LEARNT]))
            size[i : i + LEARNT] = np.fromiter(map(len, found), np.int64, len(found))
            self.ids.extend(map(attrgetter("id"), chain.from_iterable(found)))
        first = np.cumsum(size) - size + before
        self.memo.update(zip(keys, range(len(self.size), len(self.size) + len(keys))))
        self.first.frombytes(first.tobytes())
        self.size.frombytes(size.tobytes())

    def _places(self, parts: list[bytes]) -> np.ndarray:
        """Numbers of distinct parts in the memo."""
        if len(self.memo) + len(parts) > MEMO:
            self.forget()
        found = np.fromiter(map(self.memo.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = np.arange(len(new)) + len(self.size)
            self._learn([parts[i] for i in new.tolist()])
        return found

    def _gather(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a row of parts, and how many each part has."""
        coded = parts.dictionary_encode()
        number, code = self._places(_slices(coded.dictionary)), coded.indices.to_numpy()
        first, size = np.frombuffer(self.first, np.int64)[number][code], np.frombuffer(self.size, np.int64)[number][code]
        ends = np.cumsum(size)
        at = np.repeat(first - ends + size, size)
        at += np.arange(len(at))
        return np.frombuffer(self.ids, np.uint32)[at], size

    def _plain(self, d: np.ndarray, c: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = segments(d, c, at, self.folds)
        if self.folds:  # white space has no ids, and neither has it a part in what is equal
            kept = c != SPACE
            place = np.append(0, np.cumsum(kept))
            d, s, at = _LOWER[d[kept]], place[s], place[at]
            whole = np.append(s[1:], len(d)) > s
            s = s[whole]
            if not len(s):
                return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        offsets = np.append(s, len(d)).astype(np.int32)
        ids, size = self._gather(pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(d))]))
        return ids, np.append(0, np.cumsum(size))[np.searchsorted(s, at)]

    def _odd(self, text: str) -> np.ndarray:
        if "<|" in text or self.folds and ("İ" in text or not unicodedata.is_normalized("NFC", text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = self.split(text)
        return self._gather(pa.array([x.encode() for x in parts], pa.binary()))[0] if parts else np.zeros(0, np.uint32)

    def _block(self, d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = _KIND[d]
        look = np.flatnonzero(c >= LOOK)
        here, next_ = d[look], np.append(d, np.uint8(0))[look + 1]
        odd = (c[look] >= ODD) | (here == 0xC4) & (next_ == 0xB0) | (here == 0xC9) & (next_ > 0x8F) | (here == ord("<")) & (next_ == ord("|"))
        c &= np.uint8(3)
        sign = look[(here == 0xC3) & ((next_ == 0x97) | (next_ == 0xB7))]
        c[sign] = c[sign + 1] = OTHER
        rows = np.unique(np.searchsorted(at, look[odd], "right") - 1)
        if not len(rows):
            return self._plain(d, c, at)
        out: list[np.ndarray] = []
        size = np.zeros(len(at) - 1, np.int64)
        last = 0
        for r in [*rows.tolist(), len(at) - 1]:
            if at[r] > at[last]:
                ids, edges = self._plain(d[at[last] : at[r]], c[at[last] : at[r]], at[last : r + 1] - at[last])
                out.append(ids)
                size[last:r] = np.diff(edges)
            if r < len(at) - 1:
                out.append(self._odd(d[at[r] : at[r + 1]].tobytes().decode()))
                size[r] = len(out[-1])
            last = r + 1
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.append(0, np.cumsum(size))

    def encode_column(self, column: pa.Array, end_id: int | None = None):
        """(row range, ids, edges) of blocks of rows: ids[edges[i]:edges[i+1]] are a row's, with ``end_id`` after them."""
        data, at = raw_bytes(column)
        for a, b in blocks(at, TOGETHER):
            if at[b] > at[a]:
                ids, edges = self._block(data[at[a] : at[b]], at[a : b + 1] - at[a])
            else:
                ids, edges = np.zeros(0, np.uint32), np.zeros(b - a + 1, np.int64)
            if end_id is not None:
                n = np.diff(edges)
                more = np.full(len(ids) + b - a, end_id, "<u4")
                more[np.arange(len(ids)) + np.repeat(np.arange(b - a), n)] = ids
                ids, edges = more, edges + np.arange(b - a + 1)
            yield (a, b), ids, edges

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian uint32 bytes."""
        out = []
        for _, ids, edges in self.encode_column(pa.array(texts, pa.string())):
            out += [ids[x:y].astype("<u4").tobytes() for x, y in zip(edges, edges[1:])]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_groups(texts: list[str | None], most: int = 4_000_000):
    """(first, last) index ranges of about ``most`` characters."""
    first = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
