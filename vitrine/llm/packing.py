"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are tokenised, closed with an end id and cut into pieces only where
longer than a sequence. Full pieces are sequences of their own. The others are
dealt at random into cells of a bounded number of pieces. For every cell a few
islands evolve packings: crossover injects whole well-filled bins of one
parent into the other, bins that then hold a piece twice are dissolved, and
the displaced pieces are put back by best fit in decreasing order. After each
epoch the best packing of an island migrates to the next island of its cell.
The best island decides the cell; its well-filled bins are final, and what the
other bins hold is dealt again into fewer cells, until one cell is left.

Defined results: a null or empty text is one piece with the end id only;
repeated rows are packed each for itself; an empty table gives an empty
result; texts of any length are tokenised whole; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import os
import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import stash, texts

CAPACITY, END_ID = 2048, 0
CELL, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 1024, 2, 2, 8, 6
WELL_FILLED, ROUNDS, CACHE, TOGETHER = 0.995, 6, 1_500_000, 256
#: From the last of ROUNDS on, the share of a cell's bins that is dealt again.
EMPTIEST = 1 / 16


class CachedTokenizer:
    """Token ids of a text, as bytes. The vocabulary's pre-tokenizer never
    joins what an ASCII blank separates and lower-cases all, so each distinct
    word is encoded once; the words known are kept up to a bound."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._known: dict[bytes, bytes] = {}

    def encode(self, batch: list[str]) -> list[bytes]:
        known = self._known
        if len(known) > CACHE:
            known.clear()
        raws = [t.encode("utf-8", "replace") for t in batch]
        # the strings of special tokens are the only place where case counts
        split = [(r if b"<|" in r else r.lower()).split() for r in raws]
        found = [list(map(known.get, ws)) for ws in split]
        holes = [[i for i, v in enumerate(vs) if v is None] if None in vs else [] for vs in found]
        new = list({ws[i] for ws, at in zip(split, holes) for i in at})
        encode = getattr(self._tok, "encode_batch_fast", self._tok.encode_batch)
        for a in range(0, len(new), 2_000):
            part = new[a : a + 2_000]
            for w, e in zip(part, encode([w.decode("utf-8") for w in part], add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()
        for ws, vs, at in zip(split, found, holes):
            for i in at:
                vs[i] = known[ws[i]]
        return [b"".join(vs) for vs in found]


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One per Python worker: the words it knows serve its later tasks too."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's pieces."""
    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = tokenizer(path)
        for b in batches:
            for a in range(0, len(b), TOGETHER):
                part = b.iloc[a : a + TOGETHER]
                out = []
                for d, ids in zip(part["doc_id"], tok.encode(part["text"].tolist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        cut = ids[at : at + step]
                        out.append((d, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts the items, largest first, each into the fullest bin that has room
    for it; opens bins as needed. ``bins`` and ``room`` grow in place."""
    open_bins = sorted((r, i) for i, r in enumerate(room) if r)
    for x in sorted(items, key=lambda x: -sizes[x]):
        at = bisect_left(open_bins, (sizes[x], -1))
        if at < len(open_bins):
            r, i = open_bins.pop(at)
        else:
            r, i = capacity, len(bins)
            bins.append([])
            room.append(capacity)
        bins[i].append(x)
        room[i] = r - sizes[x]
        if room[i]:
            insort(open_bins, (room[i], i))


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones (mean squared fill)."""
    return -len(bins), sum((sum(sizes[x] for x in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def crossover(into: list[list[int]], donor: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    fills = sorted(((sum(sizes[x] for x in b), i) for i, b in enumerate(donor)), reverse=True)
    best = [i for f, i in fills if f >= WELL_FILLED * capacity] or [fills[0][1]]
    chosen = rng.sample(best, max(1, len(best) // 2))
    taken = {x for i in chosen for x in donor[i]}
    bins, displaced = [list(donor[i]) for i in chosen], []
    for b in into:
        if taken.isdisjoint(b):
            bins.append(list(b))
        else:
            displaced += [x for x in b if x not in taken]
    # a few badly filled bins are dissolved as well
    loose = [i for i, b in enumerate(bins) if sum(sizes[x] for x in b) < WELL_FILLED * capacity]
    gone = set(rng.sample(loose, min(len(loose), 2)))
    displaced += [x for i in gone for x in bins[i]]
    bins = [b for i, b in enumerate(bins) if i not in gone]
    best_fit(displaced, sizes, bins, [capacity - sum(sizes[x] for x in b) for b in bins], capacity)
    return bins


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing an island finds; stops at the lower bound."""
    rng = random.Random(seed)
    bound = math.ceil(sum(sizes) / capacity)
    people = [[list(b) for b in e] for e in elites]
    for k in range(POPULATION - len(people)):
        bins: list[list[int]] = []
        if k == 0:
            best_fit(list(range(len(sizes))), sizes, bins, [], capacity)
        else:
            # random whole bins first, the rest by best fit
            order = list(range(len(sizes)))
            rng.shuffle(order)
            head = order[: len(order) // (k + 1)]
            room: list[int] = []
            best_fit(head, sizes, bins, room, capacity)
            best_fit(order[len(head):], sizes, bins, room, capacity)
        people.append(bins)
        if len(bins) == bound:
            return bins
    score = lambda b: fitness(b, sizes, capacity)
    people.sort(key=score, reverse=True)
    for _ in range(generations):
        if -score(people[0])[0] <= bound:
            break
        a, b = sorted(rng.sample(range(len(people)), 2))
        child = crossover(people[b], people[a], sizes, capacity, rng)
        if score(child) > score(people[-1]):
            people[-1] = child
            people.sort(key=score, reverse=True)
    return people[0]


_GENOME = "cell long, island int, n_bins int, bins array<array<long>>"


def _island(cell: int, island: int, epoch: int, items: pd.DataFrame, genomes: list, capacity: int) -> pd.DataFrame:
    items = items.sort_values("_r", ignore_index=True)
    ids, sizes = items["_r"].tolist(), items["length"].tolist()
    place = {r: i for i, r in enumerate(ids)}
    elites = [[[place[r] for r in b] for b in g] for g in genomes]
    best = evolve(sizes, capacity, hash((cell, island, epoch)) & 0x7FFFFFFF, elites)
    return pd.DataFrame({"cell": [cell], "island": [island], "n_bins": [len(best)], "bins": [[[ids[x] for x in b] for b in best]]})


def _pack_cells(items: DataFrame, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(cell, bin, _r) of one round; ``items`` has (cell, _r, length)."""
    spread = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    grouped = spread.groupBy("cell", "island")
    now = grouped.applyInPandas(lambda key, x: _island(int(key[0]), int(key[1]), 0, x, [], capacity), _GENOME)
    for epoch in range(1, epochs):
        now = stash(now, "packing-elites")
        # the elite moves on to the next island; its own stays as well
        moved = now.withColumn("island", ((F.col("island") + 1) % islands).cast("int")).unionByName(now)

        def again(key: tuple, x: pd.DataFrame, g: pd.DataFrame, epoch: int = epoch) -> pd.DataFrame:
            genomes = [[list(b) for b in bins] for _, bins in sorted(zip(g["n_bins"], g["bins"]), key=lambda e: e[0])]
            return _island(int(key[0]), int(key[1]), epoch, x, genomes, capacity)

        now = grouped.cogroup(moved.groupBy("cell", "island")).applyInPandas(lambda key, x, g: again(key, x, g), _GENOME)
    now = stash(now, "packing-genomes")
    best = now.groupBy("cell").agg(F.min(F.struct("n_bins", "island")).alias("b")).select("cell", F.col("b.island").alias("island"))
    return now.join(best, ["cell", "island"]).select("cell", F.posexplode("bins").alias("bin", "rs")).select("cell", "bin", F.posexplode("rs").alias("at", "_r"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, cell: int = CELL, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    cut = stash(pieces(docs, path, capacity, end_id).withColumn("_r", F.monotonically_increasing_id()), "packing-pieces")
    whole = cut.where(F.col("length") == capacity).select("_r", (-1 - F.col("_r")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left, placed = cut.where(F.col("length") < capacity).select("_r", "length"), [whole]
    before = None
    for r in itertools.count():
        n = left.count()
        if not n:
            break
        cells = max(1, math.ceil(n / cell))
        # one cell is left, or dealing again no longer helps
        last = cells == 1 or (r >= ROUNDS and n > 0.75 * before)
        before = n
        dealt = left.withColumn("cell", F.pmod(F.xxhash64("_r", F.lit(r)), F.lit(cells)))
        got = _pack_cells(dealt, capacity, islands, epochs).join(dealt.select("_r", "length"), "_r")
        got = stash(got, "packing-round")
        bins = got.groupBy("cell", "bin").agg(F.sort_array(F.collect_list(F.struct("at", "_r", "length"))).alias("x"), F.sum("length").alias("fill"))
        # well-filled bins are final; where lengths don't fill so well, all but
        # the emptiest of each cell are, so that the rest falls every round
        if r >= ROUNDS - 1:
            place = F.row_number().over(Window.partitionBy("cell").orderBy("fill", "bin"))
            bins = bins.withColumn("final", place > F.ceil(F.count(F.lit(1)).over(Window.partitionBy("cell")) * EMPTIEST))
        else:
            bins = bins.withColumn("final", F.col("fill") >= WELL_FILLED * capacity)
        final = bins if last else bins.where("final")
        start = F.transform("x", lambda e, i: F.struct(e["_r"].alias("_r"), F.aggregate(F.slice("x", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["length"]).alias("offset")))
        number = (F.lit(r).cast("long") * F.lit(1 << 58)) + F.col("cell") * F.lit(1 << 20) + F.col("bin")
        placed.append(final.select(number.alias("sequence_id"), F.explode(start).alias("p")).select("p._r", "sequence_id", "p.offset"))
        if last:
            break
        left = stash(bins.where("not final").select(F.explode("x").alias("p")).select("p._r", "p.length"), "packing-left")
    where = placed[0]
    for p in placed[1:]:
        where = where.unionByName(p)
    return cut.join(where, "_r").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
