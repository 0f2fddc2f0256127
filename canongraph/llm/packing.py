"""Operator 10. Best-fit packing: pieces of token streams into as few fixed-length sequences as can be found.

Method: a grouping genetic algorithm. An individual is a packing. Crossover injects whole well-filled bins of one
packing into another, removes the bins that would hold a piece twice, and best-fits the displaced pieces. Pieces are
dealt by a hash of their id into shards of bounded size; each shard evolves on several islands, and after each round
every island sends its elite to the next one. The worst-filled bins of all shards then meet in fewer, new shards.

Nulls and empty texts are documents of the end id alone; a very long text becomes many full pieces. Every row is packed:
repeated rows, equal and null doc_ids get places of their own, as pieces carry a row number. Ties between packings go by
island and rank, so equal input packs equally. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canongraph.llm.common import bound_batches, cut, stored, tidy
from canongraph.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: full ones of ``capacity`` ids, and before them one of what is left over.

    ``with_ids`` adds each piece's ids as little-endian uint32 bytes.
    """
    bound_batches(docs.sparkSession)
    schema = PIECES + (", ids binary" if with_ids else "")
    arrow = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else []))

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            docs = batch.column(0)
            for (a, _), ids, edges in enc.encode_column(batch.column(1), end_id):
                n = np.diff(edges)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = (n - (pieces - 1) * capacity)[row]  # the first piece may be shorter
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                length = np.where(piece == 0, first, capacity)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 4 * (edges[row] + start)
                parts = [raw[x : x + y] for x, y in zip(at.tolist(), (4 * length).tolist())]
                columns = [docs.take(pa.array(a + row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([bytes(x) for x in parts], pa.binary())] if with_ids else []), schema=arrow)
        enc.forget()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), schema)


# -- one shard: plain Python on a bounded list of lengths ------------------------------------------------------------


class _Shard:
    """The packings of one shard: lists of (fill, pieces) bins."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes, capacity, random.Random(seed)
        self.bound = -(-sum(sizes) // capacity)

    def place(self, items, bins):
        """Best fit: pieces, largest first, each into the bin with the least room that it fits."""
        sizes, capacity = self.sizes, self.capacity
        # bins by the room they have left; a bit is set for each room that some bin has
        by_room: dict[int, list] = {}
        mask = 0
        done = []
        for fill, c in bins:
            if fill < capacity:
                by_room.setdefault(capacity - fill, []).append(c)
                mask |= 1 << (capacity - fill)
            else:
                done.append((fill, c))
        for x in sorted(items, key=sizes.__getitem__, reverse=True):
            size = sizes[x]
            fits = mask >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                own = by_room[room]
                c = own.pop()
                if not own:
                    mask ^= 1 << room
            else:
                room, c = capacity, []
            c.append(x)
            room -= size
            if room:
                own = by_room.setdefault(room, [])
                if not own:
                    mask |= 1 << room
                own.append(c)
            else:
                done.append((capacity, c))
        return done + [(capacity - room, c) for room, own in by_room.items() for c in own]

    def start(self, shuffled: bool):
        """A first packing: best fit by falling size, or over bins seeded with random pieces."""
        bins, rest = [], list(range(len(self.sizes)))
        if shuffled and len(rest) > 4:
            seeds = set(self.rng.sample(rest, len(rest) // 8))
            bins = [(self.sizes[x], [x]) for x in sorted(seeds)]
            rest = [x for x in rest if x not in seeds]
        return self.place(rest, bins)

    def fitness(self, bins) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: the sum of squared fills."""
        return len(bins), -sum(f * f for f, _ in bins) / self.capacity**2

    def cross(self, a, b):
        """A child of ``a`` into which well-filled bins of ``b`` are injected whole."""
        good = sorted(b, key=lambda c: c[0], reverse=True)[: max(1, len(b) // 2)]
        injected = self.rng.sample(good, max(1, len(good) // 2))
        taken = {x for _, c in injected for x in c}
        bins, loose = [(f, list(c)) for f, c in injected], []
        # bins of a that would hold a piece twice go; so do some of its worst-filled ones (mutation)
        worst = sorted(f for f, _ in a)[max(1, len(a) // 20) - 1]
        for f, c in a:
            if f <= worst or not taken.isdisjoint(c):
                loose += [x for x in c if x not in taken]
            else:
                bins.append((f, list(c)))
        return self.place(loose, bins)

    def evolve(self, population, generations: int, size: int):
        ranked = sorted(((self.fitness(p), i, p) for i, p in enumerate(population)))[:size]
        n = len(population)
        while len(ranked) < size and (not ranked or ranked[0][0][0] > self.bound):
            p = self.start(shuffled=bool(ranked))
            ranked.append((self.fitness(p), n, p))
            n += 1
        ranked.sort()
        for _ in range(generations):
            if ranked[0][0][0] <= self.bound or len(ranked) < 2:
                break
            children = []
            for _ in range(size):
                a, b = sorted(self.rng.sample(range(len(ranked)), 2))
                p = self.cross(ranked[a][2], ranked[b][2])
                children.append((self.fitness(p), n, p))
                n += 1
            ranked = sorted(ranked + children)[:size]
        return [p for _, _, p in ranked]


def _flat(bins, n: int) -> bytes:
    out = np.empty(n, "<i4")
    for i, (_, c) in enumerate(bins):
        out[c] = i
    return out.tobytes()


def _bins(raw: bytes, sizes: list[int]) -> list[tuple[int, list[int]]]:
    bins: dict[int, list[int]] = {}
    for x, i in enumerate(np.frombuffer(raw, "<i4").tolist()):
        bins.setdefault(i, []).append(x)
    return [(sum(sizes[x] for x in c), c) for c in bins.values()]


def _evolve_islands(shards: DataFrame, capacity: int, islands: int, rounds: int, generations: int, population: int, seed: int) -> DataFrame:
    """shards: (shard, sizes). Returns (shard, packing) with each piece's bin number."""
    schema = "shard long, island int, rank int, packing binary, n_bins int, fit double, sizes array<int>"

    def evolve(frames):
        for f in frames:
            out = []
            for shard, island, sizes, guests, turn in zip(f["shard"], f["island"], f["sizes"], f["guests"], f["turn"]):
                s = _Shard([int(x) for x in sizes], capacity, hash((seed, int(shard), int(island), int(turn))))
                known = [_bins(g, s.sizes) for g in guests]
                for rank, p in enumerate(s.evolve(known, generations, population)):
                    n, fit = s.fitness(p)
                    out.append((shard, island, rank, _flat(p, len(s.sizes)), n, fit, sizes))
            yield pd.DataFrame(out, columns=["shard", "island", "rank", "packing", "n_bins", "fit", "sizes"])

    now = shards.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)]))).withColumn("guests", F.array().cast("array<binary>"))
    for turn in range(rounds):
        done = now.select("shard", "island", "sizes", "guests", F.lit(turn).alias("turn")).mapInPandas(tidy(evolve), schema)
        # the elite of island i also joins island i + 1; each island keeps its own population
        elite = F.when(F.col("rank") == 0, F.array("island", (F.col("island") + 1) % islands)).otherwise(F.array("island"))
        if turn + 1 < rounds:
            now = cut(done.withColumn("island", F.explode(F.array_distinct(elite))).groupBy("shard", "island").agg(F.first("sizes").alias("sizes"), F.collect_list("packing").alias("guests")))
    best = F.min_by("packing", F.struct("n_bins", "fit", "island", "rank"))
    return done.groupBy("shard").agg(best.alias("packing"))


def pack(pieces: DataFrame, capacity: int = 1024, shard_size: int = 4096, islands: int = 2, rounds: int = 2, generations: int = 3, population: int = 4, seed: int = 7, reopen: int = 4, row_col: str | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (as cut_pieces returns them); further columns are left out but ``row_col``,
    numbers that tell rows apart where ids are null or repeat.

    ``shard_size``: pieces a shard holds on average; it bounds what one task sees. Full pieces make sequences of their
    own; all others are packed. The sequences with most room left in each shard (one in ``reopen``, one at least) are opened
    and packed again together with those of other shards.
    """
    pieces = cut(pieces.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("row_id", F.monotonically_increasing_id())) if row_col is None else pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col(row_col).alias("row_id"))
    shown = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ([] if row_col is None else ["row_id"])
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row_id")).withColumn("offset", F.lit(0).cast("long"))
    loose = pieces.filter(F.col("length") < capacity)
    n = loose.count()
    if not n:
        return full.select(*shown)

    def solve(items: DataFrame, n_shards: int, salt: int) -> DataFrame:
        """items: pieces with row_id. Returns (shard, bin, fill, members)."""
        member = F.struct(*[F.col(c) for c in ("length", "row_id", "doc_id", "piece", "start", "ids_crc32")])
        dealt = items.withColumn("shard", F.pmod(F.xxhash64("row_id", F.lit(salt)), F.lit(n_shards)))
        shards = cut(dealt.groupBy("shard").agg(F.sort_array(F.collect_list(member)).alias("members")).withColumn("sizes", F.expr("transform(members, x -> cast(x.length as int))")))
        packed = _evolve_islands(shards.select("shard", "sizes"), capacity, islands, rounds, generations, population, seed + salt)

        def spread(frames):
            for f in frames:
                for shard, raw in zip(f["shard"], f["packing"]):
                    of = np.frombuffer(raw, "<i4")
                    yield pd.DataFrame({"shard": shard, "place": np.arange(len(of)), "bin": of})

        where = packed.mapInPandas(tidy(spread), "shard long, place int, bin int")
        flat = shards.select("shard", F.posexplode("members").alias("place", "m")).join(where, ["shard", "place"])
        return cut(flat.groupBy("shard", "bin").agg(F.sum("m.length").alias("fill"), F.sort_array(F.collect_list("m")).alias("members")))

    n_shards = -(-n // shard_size)
    bins = solve(loose, n_shards, 0)
    level = 1
    result = None
    while True:
        ranked = bins.withColumn("rank", F.row_number().over(Window.partitionBy("shard").orderBy("fill", "bin"))).withColumn("of", F.count("*").over(Window.partitionBy("shard")))
        again = (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("of") / reopen))) if n_shards > 1 else F.lit(False)
        ranked = cut(ranked.withColumn("again", again).withColumn("level", F.lit(level).cast("long")).drop("rank", "of"))
        kept = ranked.filter(~F.col("again")).drop("again")
        result = kept if result is None else result.unionByName(kept)
        if n_shards == 1:
            break
        opened = ranked.filter("again").select(F.explode("members").alias("m")).select("m.*")
        n_shards = -(-opened.count() // shard_size)
        level += 1
        bins = solve(opened, n_shards, level)
    # numbers of sequences: level, shard and bin side by side
    number = F.col("level") * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 20) + F.col("bin")
    placed = result.select(number.alias("sequence_id"), F.posexplode("members").alias("at", "m"), "members")
    offset = F.aggregate(F.slice("members", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda s, x: s + x["length"])
    placed = placed.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "m.row_id", "sequence_id", offset.alias("offset"))
    return placed.select(*shown).unionByName(full.select(*shown))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, **how) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(cut_pieces(docs, tokenizer, capacity, end_id), capacity, **how)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, **how) -> DataFrame:
    """The packed sequences themselves: (sequence_id, n_tokens, ids as little-endian uint32 bytes, parts).

    Rows whose ids are null or repeat are packed each with its own text.
    """
    pieces = stored(cut_pieces(docs, tokenizer, capacity, end_id, with_ids=True).withColumn("row_id", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces, capacity, row_col="row_id", **how)
    rows = placed.join(pieces.select("row_id", "ids"), "row_id").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("n_tokens"), joined.alias("ids"), F.transform("parts", lambda x: x.dropFields("ids")).alias("parts"))
