"""Benchmark decontamination by latent semantic retrieval.

Texts are words (lower case, runs of ASCII letters, digits and any other
script's characters). Documents are read as passages: overlapping windows of
``WINDOW`` words. TF-IDF weights over hashed words use document frequencies of
all documents. A randomised SVD of passages (all of the benchmark and all of
the corpus, each distinct text once) gives the latent axes; its products are
summed over partitions of the passages. Each document passage is
projected and compared by cosine with every benchmark item, in blocks of
items. The axes are few however many items there are, so places that share
enough of an item's runs of ``RUN`` words, rare ones among the items, are
candidates too: a copy word for word is one whatever its length and the size
of the benchmark. Candidates are verified in the passage and its surroundings by the
longest common subsequence of words: an item counts as leaked if it holds
``SAME`` of the item, or ``REWORDED`` of it together with the item's answer
(its last sentence), which a paraphrase has to keep.

Defined results: null, empty or blank texts on either side match nothing;
repeated rows match alike, each for itself; empty tables give an empty result;
texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import stash, texts, vector_total

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
WINDOW = 48
STEP = WINDOW // 2
AXES, EXTRA, ITEM_BLOCK = 96, 8, 4000
#: Weight of the corpus in the fit of the axes, in items, shared among its texts (0.05 each at most); rows of a band of their sums.
CORPUS_WEIGHT, BAND = 50.0, 64
COSINE, SAME, REWORDED, ANSWER = 0.24, 0.8, 0.6, 0.8
BYTES_TOGETHER = 1 << 18
#: Words of a run; the share of an item's runs a place must hold; items that may share a run; rarest runs of an item that count all the same.
RUN, RUN_SHARE, RUN_ITEMS, RUN_LEAST = 3, 0.1, 16, 8
#: Blocks of words projected and compared at a time: bounds a task's matrices for texts of any length.
BLOCKS_TOGETHER = 1024
#: The same in the fit of the axes (more blocks share more words), and the bits that number a block there.
BLOCKS_FITTED, BLOCK_BITS = 8000, 13
#: Rows of a run that are added at a time, rows looked up at a time, and those gathered at a time, which stay in a core's cache.
WIDTHS, ROWS_TOGETHER, ROWS_CACHED = (1, 2, 4, 8, 16, STEP), 16384, 1536
#: Words around candidates that are looked through at a time; table entries for each word of an item (2^24 in all at most).
AROUND_TOGETHER, MARKS = 1 << 17, 64
#: Bytes of a word that are hashed place by place for all words at once.
SHORT = 32
_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEY_SUMS = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_KEYS[: SHORT + 1])))
_IS_WORD = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])
_SENTENCE = re.compile(r"[.!?]\s+|[\u3002\uff01\uff1f]\s*")
#: Beyond ASCII: what is no letter or digit, and letters of scripts that put no blanks between words (Thai, Lao,
#: Tibetan, Burmese, Khmer, Chinese, Japanese): each is a word.
_NO_WORD = re.compile(r"[^\w\x00-\x7f]")
_UNSPACED = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_LATIN = _NO_WORD.sub(" ", bytes(range(256)).decode("latin-1").lower()).encode("latin-1")


def encoded(text: str) -> bytes:
    """The bytes that words are taken from: letters beyond ASCII composed and
    lower-cased, typographic signs as blanks, scripts without blanks letter by
    letter. ASCII letters are lower-cased with the bytes."""
    if text.isascii():
        return text.encode()
    try:  # Latin-1 letters are composed and have spaces: one table does all
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").encode()
    except UnicodeEncodeError:
        text = _NO_WORD.sub(" ", unicodedata.normalize("NFC", text).lower())
        return _UNSPACED.sub(lambda m: f" {m[0]} ", text).encode("utf-8", "replace")


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words, byte place where each begins)."""
    b = np.frombuffer(raw.lower(), dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(begins):
        return np.zeros(0, dtype=np.uint64), begins
    # the longest first, so that those with a byte at a place are the first ones
    size = np.minimum(lengths, SHORT + 1).astype(np.uint8)
    order = np.argsort(SHORT + 1 - size, kind="stable")
    upto = np.searchsorted(-size[order].astype(np.int64), -np.arange(SHORT + 1))
    at, sums = begins[order], _KEY_SUMS[size[order]]
    for k in range(SHORT):
        n = upto[k]
        if not n:
            break
        sums[:n] += b[at[:n] + k].astype(np.uint64) * _KEYS[k]
    long = order[: upto[SHORT]]
    if len(long):
        first = np.cumsum(lengths[long]) - lengths[long]
        pos = np.arange(lengths[long].sum()) - np.repeat(first, lengths[long])
        sums[: len(long)] = np.add.reduceat((b[np.repeat(begins[long], lengths[long]) + pos].astype(np.uint64) + np.uint64(1)) * _KEYS[pos & 255], first)
    h = np.empty_like(sums)
    h[order] = sums
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32)), begins


def buckets(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def batched(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Parts of about BYTES_TOGETHER: (rows, word hashes, first word of each
    row and the end), the words of all its rows hashed in one go."""
    for b in batches:
        raws, size = [], 0
        for z, t in enumerate(b[column], 1):
            raws.append(encoded(t))
            size += len(raws[-1]) + 1
            if size >= BYTES_TOGETHER or z == len(b):
                h, at = word_hashes(b"\n".join(raws))
                ends = np.cumsum([len(r) + 1 for r in raws])
                yield b.iloc[z - len(raws) : z], h, np.concatenate(([0], np.searchsorted(at, ends)))
                raws, size = [], 0


def passage_blocks(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of STEP words within rows: (first word, row, whether the next
    block belongs to the same row). A passage is a block and the next one."""
    many = -(-np.diff(firsts) // STEP)
    rows = np.repeat(np.arange(len(many)), many)
    starts = np.asarray(firsts)[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)) * STEP
    return starts.astype(np.int64), rows, np.append(rows[1:] == rows[:-1], False)[: len(rows)]


def bucketed(rows: DataFrame) -> DataFrame:
    """(sha, b, copies): the distinct texts of ``rows`` as the buckets of their
    words, two bytes each, and how many rows hold the text. The texts are taken
    apart once; weights and axes are learned from these."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, h, firsts in batched(batches):
            b = buckets(h).astype(np.uint16)
            yield pd.DataFrame({"sha": part["sha"], "b": [b[a:z].tobytes() for a, z in zip(firsts[:-1], firsts[1:])]})

    keyed = rows.select(F.sha2("text", 256).alias("sha"), "text")
    return keyed.mapInPandas(run, "sha string, b binary").groupBy("sha").agg(F.first("b").alias("b"), F.count(F.lit(1)).alias("copies"))


def joined(values: pd.Series, size: int) -> Iterator[slice]:
    """Neighbouring rows of together about ``size`` bytes."""
    first = total = 0
    for z, x in enumerate(values, 1):
        total += len(x)
        if total >= size or z == len(values):
            yield slice(first, z)
            first, total = z, 0


def document_frequencies(coded: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(BUCKETS + 1)
        for part in batches:
            df[-1] += part["copies"].sum()
            for some in joined(part["b"], BYTES_TOGETHER):
                b, copies = np.frombuffer(b"".join(part["b"].iloc[some]), dtype=np.uint16), part["copies"].to_numpy()[some]
                row = np.repeat(np.arange(len(copies)), [len(x) // 2 for x in part["b"].iloc[some]])
                key = np.sort(row << BUCKET_BITS | b)
                key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
                df[:-1] += np.bincount(key & (BUCKETS - 1), copies[key >> BUCKET_BITS], BUCKETS)
        yield pd.DataFrame({"k": ["df"], "v": [df.tolist()]})

    got = vector_total(coded.select("b", "copies").mapInPandas(run, "k string, v array<double>"), "k", "v", BUCKETS + 1)
    v = got.get("df", np.zeros(BUCKETS + 1))
    return v[:-1], int(v[-1])


def _whole(h: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, unit TF-IDF values) of a text taken as one passage."""
    u, n = np.unique(h, return_counts=True)
    v = n * idf[u]
    return u, v / max(np.linalg.norm(v), 1e-12)


def _run_sums(x: np.ndarray, at: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows ``x[at[begin:end]]`` for all runs, those of about one
    length together: many times faster than ``add.reduceat`` on wide rows. The
    last row of ``x`` is zero."""
    length = ends - begins
    out = np.zeros((len(begins), x.shape[1]), dtype=x.dtype)
    for less, width in zip((0, *WIDTHS), WIDTHS):
        runs = np.flatnonzero((length > less) & (length <= width))
        for lo in range(0, len(runs), ROWS_TOGETHER // width):
            some = runs[lo : lo + ROWS_TOGETHER // width]
            place = begins[some, None] + np.arange(width)
            taken = np.where(place < ends[some, None], at[np.minimum(place, len(at) - 1)], len(x) - 1)
            for k in range(0, len(some), ROWS_CACHED // width):
                some_, taken_ = some[k : k + ROWS_CACHED // width], taken[k : k + ROWS_CACHED // width]
                if width > 4:
                    out[some_] = (np.ones((1, width), dtype=x.dtype) @ x.take(taken_, axis=0))[:, 0]
                    continue
                sums = x.take(taken_[:, 0], axis=0)
                for c in range(1, width):
                    sums += x.take(taken_[:, c], axis=0)
                out[some_] = sums
    runs = np.flatnonzero(length > WIDTHS[-1])
    if len(runs):
        pieces = -(-length[runs] // WIDTHS[-1])
        first = np.cumsum(pieces) - pieces
        starts = np.repeat(begins[runs] - first * WIDTHS[-1], pieces) + np.arange(pieces.sum()) * WIDTHS[-1]
        sums = _run_sums(x, at, starts, np.minimum(starts + WIDTHS[-1], np.repeat(ends[runs], pieces)))
        out[runs] = _run_sums(np.vstack([sums, np.zeros((1, x.shape[1]), dtype=x.dtype)]), np.arange(len(sums)), first, first + pieces)
    return out


def _add_passages(y: np.ndarray, b: np.ndarray, firsts: np.ndarray, idf: np.ndarray, weighted: np.ndarray, weight: float) -> None:
    """Adds ``weight`` v (v'Q) of all passages v of the texts in ``b`` to
    ``y``, before the last weighting by ``idf``: a passage is the sum of two
    blocks, so both products are sums over blocks. ``weighted`` is idf Q and a
    row of zeros."""
    starts, row, goes_on = passage_blocks(firsts)
    ends = np.append(starts[1:], len(b))
    passage = goes_on | np.append(True, row[1:] != row[:-1])
    for lo in range(0, len(starts), BLOCKS_FITTED):
        hi = min(len(starts), lo + BLOCKS_FITTED)
        reach = min(len(starts), hi + 1)  # the last passage takes in the next block
        first, last = starts[lo], ends[reach - 1]
        latent = _run_sums(weighted, b[first:last], starts[lo:reach] - first, ends[lo:reach] - first)
        more = np.flatnonzero(goes_on[lo:hi])
        both = latent[: hi - lo].copy()
        both[more] += latent[more + 1]
        # words by bucket, then block: a word's places, its repeats and its meetings in two neighbouring blocks
        key = np.sort(b[first:last].astype(np.int32) << BLOCK_BITS | np.repeat(np.arange(reach - lo, dtype=np.int32), ends[lo:reach] - starts[lo:reach]))
        bucket, block = key >> BLOCK_BITS, key & ((1 << BLOCK_BITS) - 1)
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        value, holder = np.diff(np.append(new, len(key))) * idf[bucket[new]].astype(np.float64), block[new]
        meet = np.flatnonzero(np.diff(key[new]) == 1)
        own = np.bincount(holder, value**2, reach - lo)
        shared = np.bincount(holder[meet], value[meet] * value[meet + 1], reach - lo)
        square = own[: hi - lo].copy()
        square[more] += own[more + 1] + 2 * shared[more]
        both *= np.where(passage[lo:hi], weight / np.maximum(square, 1e-24), 0.0).astype(np.float32)[:, None]
        back = np.zeros((reach - lo + 1, y.shape[1]), dtype=np.float32)
        back[: hi - lo] = both
        back[more + 1] += both[more]
        runs = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        y[bucket[runs]] += _run_sums(back, block, runs, np.append(runs[1:], len(key)))


def latent_axes(passages: DataFrame, idf: np.ndarray, axes: int = AXES, rounds: int = 2) -> np.ndarray:
    """BUCKETS x axes basis of the main right singular directions of the
    TF-IDF rows of all passages (b, whole, weight). Each round sums A'(A Q)
    over the tasks, in bands of rows that Spark adds up."""
    wide = axes + EXTRA
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((BUCKETS, wide)))[0].astype(np.float32)
    for _ in range(rounds):

        def run(batches: Iterator[pd.DataFrame], q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            y, items = np.zeros((BUCKETS, wide), dtype=np.float32), None
            weighted = np.zeros((BUCKETS + 1, wide), dtype=np.float32)
            np.multiply(q, idf[:, None], out=weighted[:-1])
            for p in batches:
                p = p[p["b"].map(len) > 0]
                for b, weight in p.loc[p["whole"], ["b", "weight"]].itertuples(index=False):
                    u, v = _whole(np.frombuffer(b, dtype=np.uint16), idf)
                    items = np.zeros((BUCKETS, wide), dtype=np.float32) if items is None else items
                    items[u] += weight * np.outer(v, v @ q[u]).astype(np.float32)
                p = p[~p["whole"]]
                for some in joined(p["b"], 2 * BLOCKS_FITTED * STEP):
                    part = p["b"].iloc[some]
                    b = np.frombuffer(b"".join(part), dtype=np.uint16)
                    _add_passages(y, b, np.cumsum([0, *(len(x) // 2 for x in part)]), idf, weighted, p["weight"].iloc[0])
            y *= idf[:, None]
            y = y if items is None else y + items
            task = TaskContext.get().partitionId()
            bands = [(k, y[k * BAND : (k + 1) * BAND]) for k in range(BUCKETS // BAND)]
            yield pd.DataFrame([(k, task, x.astype(np.float32).tobytes()) for k, x in bands if x.any()], columns=["k", "task", "y"])

        def add(band: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(BAND * wide)
            for x in band.sort_values("task")["y"]:
                total += np.frombuffer(x, dtype=np.float32)
            return pd.DataFrame({"k": band["k"].iloc[:1], "y": [total.astype(np.float32).tobytes()]})

        y = np.zeros((BUCKETS, wide), dtype=np.float32)
        for r in passages.mapInPandas(run, "k int, task int, y binary").groupBy("k").applyInPandas(add, "k int, y binary").collect():
            y[r["k"] * BAND : (r["k"] + 1) * BAND] = np.frombuffer(r["y"], dtype=np.float32).reshape(BAND, wide)
        # left singular vectors of y through the small matrix y'y
        power, turn = np.linalg.eigh((y.T @ y).astype(np.float64))
        power, turn = power[::-1], turn[:, ::-1]
        q = y @ (turn / np.sqrt(np.maximum(power, 1e-12))).astype(np.float32)
        q[:, power < 1e-10 * power[0]] = 0
    return np.ascontiguousarray(q[:, :axes])


def lcs_length(item: list[int], region: list[int]) -> int:
    """Longest common subsequence, a machine word of the item at a time."""
    where: dict[int, int] = {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    s = full
    for x in region:
        m = where.get(x)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return len(item) - s.bit_count()


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbouring words."""
    out = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + len(out)]) * _KEYS[k]
        out ^= out >> np.uint64(29)
    return out


class Runs:
    """The runs of a block of items: sorted hashes, each with its item and its
    place in it. Items shorter than a run count as one."""

    BITS = 20

    def __init__(self, words: list[list[int]], width: int) -> None:
        self.width = width
        keys, owner, place = [], [], []
        for j, w in enumerate(words):
            if min(RUN, len(w)) == width:
                k, at = np.unique(run_hashes(np.array(w, dtype=np.uint64), width), return_index=True)
                keys.append(k)
                owner.append(np.full(len(k), j))
                place.append(at)
        keys, owner, place = (np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (keys, owner, place))
        _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
        holders = counts[which] if len(keys) else np.zeros(0, dtype=np.int64)
        order = np.lexsort((holders, owner))
        firsts = np.searchsorted(owner[order], owner[order]) if len(order) else order
        kept = order[(holders[order] <= RUN_ITEMS) | (np.arange(len(order)) - firsts < RUN_LEAST)]
        kept = kept[np.argsort(keys[kept], kind="stable")]
        self.keys, self.owner, self.place = keys[kept], owner[kept].astype(np.int64), place[kept].astype(np.int64)
        self.needed = np.maximum(1, np.ceil(RUN_SHARE * np.bincount(self.owner, minlength=len(words)))).astype(np.int64)
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def places(self, h: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, place where the item would begin), where a row holds
        enough of the item's runs close together."""
        k = run_hashes(h, self.width)
        at = np.flatnonzero(self.maybe[(k >> np.uint64(64 - self.BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, k[at]), np.searchsorted(self.keys, k[at], side="right")
        row = np.searchsorted(firsts, at, side="right") - 1
        many = np.where(at + self.width <= firsts[row + 1], hi - lo, 0) if len(at) else hi - lo
        if not many.sum():
            return
        entry = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, row, item = np.repeat(at, many), np.repeat(row, many), self.owner[entry]
        begin = at - self.place[entry]
        order = np.lexsort((at, item, row))
        at, row, item, begin = at[order], row[order], item[order], begin[order]
        end = np.arange(len(at)) + self.needed[item] - 1
        last = np.minimum(end, len(at) - 1)
        # the n-th hit from here belongs to the same item and row, at most two lengths on
        close = (end < len(at)) & (row[last] == row) & (item[last] == item) & (at[last] - at <= 2 * self.length[item])
        step = np.maximum(STEP, self.length[item] // 2)
        cells = np.stack([row, item, begin // step], axis=1)[close]
        for (r, j, _), b in zip(*(lambda u, i: (u.tolist(), begin[close][i].tolist()))(*np.unique(cells, axis=0, return_index=True))):
            yield r, j, b


class Items:
    """A block of benchmark items, ready for comparison."""

    def __init__(self, ids: list, texts_: list[str], idf: np.ndarray, axes: np.ndarray) -> None:
        self.ids, self.words, self.held, self.answers, rows = [], [], [], [], []
        for i, t in zip(ids, texts_):
            h, _ = word_hashes(encoded(t))
            if not len(h):
                continue
            tail = [x for x in _SENTENCE.split(t.strip()) if x][-1]
            answer = word_hashes(encoded(tail))[0].tolist()
            u, v = _whole(buckets(h), idf)
            self.ids.append(i)
            self.words.append(h.tolist())
            self.held.append(Counter(self.words[-1]))
            self.answers.append(answer if len(answer) >= 3 else h.tolist()[-5:])
            rows.append(v @ axes[u])
        self.runs = [Runs(self.words, width) for width in sorted({min(RUN, len(w)) for w in self.words})]
        x = np.array(rows, dtype=np.float32).reshape(len(rows), axes.shape[1])
        self.latent = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).T
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        #: distinct words of the item that a region must hold, if all repeats belong to them
        self.least = np.array([REWORDED * len(w) - len(w) + len(c) for w, c in zip(self.words, self.held)])
        size = sum(map(len, self.held))
        self.bits = int(np.clip(np.ceil(np.log2(MARKS * size + 1)), 10, 24))
        self.marks = np.zeros(1 << self.bits, dtype=bool)
        self.marks[self._mark(np.fromiter((x for c in self.held for x in c), np.uint64, size), np.repeat(np.arange(len(self.held)), list(map(len, self.held))))] = True

    def _mark(self, h: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Table entries of words of items."""
        m = (h ^ (item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return (m >> np.uint64(64 - self.bits)).astype(np.int64)

    def may_hold(self, h: np.ndarray, a: np.ndarray, z: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether the words of ``h[a:z]`` may be enough of the item's for
        :meth:`verify`: all of its words are marked, few others are."""
        out, before = np.zeros(len(a), dtype=bool), np.append(0, np.cumsum(z - a))
        lo = 0
        while lo < len(a):
            # at most 4,096, numbered in the upper 12 bits; the lower 52 tell words apart
            hi = max(lo + 1, min(lo + 4096, int(np.searchsorted(before, before[lo] + AROUND_TOGETHER, side="right")) - 1))
            pair = np.repeat(np.arange(hi - lo), z[lo:hi] - a[lo:hi])
            around = h[np.arange(before[hi] - before[lo]) + np.repeat(a[lo:hi] - before[lo:hi] + before[lo], z[lo:hi] - a[lo:hi])]
            held = self.marks[self._mark(around, which[lo:hi][pair])]
            key = np.sort(pair[held].astype(np.uint64) << np.uint64(52) | around[held] >> np.uint64(12))
            new = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
            out[lo:hi] = np.bincount((new >> np.uint64(52)).astype(np.int64), minlength=hi - lo) >= self.least[which[lo:hi]]
            lo = hi
        return out

    def verify(self, j: int, region: list[int]) -> tuple[float, bool] | None:
        item, held = self.words[j], self.held[j]
        found = held.keys() & region
        # all repeats of words at first, then those of the words found
        if len(found) + len(item) - len(held) < REWORDED * len(item) or sum(map(held.__getitem__, found)) < REWORDED * len(item):
            return None
        share = lcs_length(item, region) / len(item)
        answer = self.answers[j]
        found = lcs_length(answer, region) >= ANSWER * len(answer)
        return (share, found) if share >= SAME or share >= REWORDED and found else None


class Search:
    """A block of items and what passages are compared by; goes to the tasks."""

    def __init__(self, ids: list, item_texts: list[str], idf: np.ndarray, axes: np.ndarray) -> None:
        self.given = (ids, item_texts, idf, axes)

    def ready(self) -> Search:
        ids, item_texts, idf, axes = self.given
        self.items = Items(ids, item_texts, idf, axes)
        self.weighted = np.vstack([axes * idf[:, None], np.zeros((1, axes.shape[1]))]).astype(np.float32)
        self.square = (idf**2).astype(np.float32)
        return self

    def found(self, h: np.ndarray, firsts: np.ndarray) -> dict[tuple[int, int], tuple[float, float, bool]]:
        """(row, item): (cosine, share, whether the answer is there) of the
        items that rows of hashed words hold."""
        items, weighted, square = self.items, self.weighted, self.square
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        if not len(h) or not items.ids:
            return best
        b, words = buckets(h), h.tolist()
        starts, row, goes_on = passage_blocks(firsts)
        ends = np.append(starts[1:], len(h))
        for first in range(0, len(starts), BLOCKS_TOGETHER):
            last = min(len(starts), first + BLOCKS_TOGETHER)
            reach = min(len(starts), last + 1)  # the last passage takes in the next block
            lo, hi = starts[first], ends[reach - 1]
            latent = _run_sums(weighted, b[lo:hi], starts[first:reach] - lo, ends[first:reach] - lo)
            norm = np.add.reduceat(square[b[lo:hi]], starts[first:reach] - lo)
            more = np.flatnonzero(goes_on[first:last])
            latent[more] += latent[more + 1].copy()
            norm[more] += norm[more + 1].copy()
            latent, norm = latent[: last - first], norm[: last - first]
            # by the whole passage's weight: what the axes don't see counts against it
            cos = latent @ items.latent
            cos /= np.maximum(np.sqrt(norm), 1e-9)[:, None]
            near, which = np.nonzero(cos >= COSINE)
            p, n = first + near, items.length[which]
            a = np.maximum(firsts[row[p]], starts[p] - n)
            z = np.minimum(firsts[row[p] + 1], ends[np.where(goes_on[p], p + 1, p)] + n)
            kept = np.flatnonzero(items.may_hold(h, a, z, which))
            for k, j, r, a_, z_ in zip(*(x[kept].tolist() for x in (near, which, row[p], a, z))):
                got = items.verify(j, words[a_:z_])
                if got and got > best.get((r, j), (0.0, 0.0, False))[1:]:
                    best[(r, j)] = (float(cos[k, j]), *got)
        for runs in items.runs:
            for r, j, begin in runs.places(h, firsts):
                had, n = best.get((r, j), (0.0, 0.0, False)), len(items.words[j])
                if had[1:] == (1.0, True):
                    continue
                # as far around as the cells of places reach
                more = 2 * max(STEP, n // 2)
                got = items.verify(j, words[max(firsts[r], begin - more) : min(firsts[r + 1], begin + n + more)])
                if got and got > had[1:]:
                    p = np.searchsorted(starts, max(begin, firsts[r]), side="right") - 1
                    near = slice(starts[p], ends[p + 1] if goes_on[p] else ends[p])
                    cosine = weighted[b[near]].sum(axis=0) @ items.latent[:, j] / max(float(np.sqrt(square[b[near]].sum())), 1e-9)
                    best[(r, j)] = (float(cosine), *got)
        return best


def _pairs(rows: DataFrame, search: Search, item_type: str) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found) of a block of items."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = search.ready().items.ids
        for part, h, firsts in batched(batches):
            best = search.found(h, firsts)
            if best:
                yield pd.DataFrame({
                    "doc_id": [part["doc_id"].iloc[r] for r, _ in best], "item_id": [ids[j] for _, j in best],
                    "cosine": [v[0] for v in best.values()], "lcs_share": [v[1] for v in best.values()], "answer_found": [v[2] for v in best.values()],
                })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, item_id {item_type}, cosine double, lcs_share double, answer_found boolean")


def _holds(text: Column, search: Search) -> Column:
    """Whether a text holds an item of the block."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search.ready()
        for b in batches:
            out, done = np.zeros(len(b), dtype=bool), 0
            for part, h, firsts in batched(iter([b.to_frame("text")])):
                out[[done + r for r, _ in search.found(h, firsts)]] = True
                done += len(part)
            yield pd.Series(out)

    return F.pandas_udf(run, "boolean")(text)


def searches(rows: DataFrame, items: DataFrame, axes: int = AXES, corpus_weight: float = CORPUS_WEIGHT) -> Iterator[Search]:
    """The query set, in blocks, each to meet all passages of ``rows``."""
    coded = stash(bucketed(rows), "decontamination-words")
    df, n = document_frequencies(coded)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.05)
    # all passages together weigh as much whatever the corpus's size
    weight = min(0.05, corpus_weight / max(1, n))
    fit_on = (coded.select("b", F.lit(False).alias("whole"), F.lit(weight).alias("weight"))
              .unionByName(bucketed(items).select("b", F.lit(True).alias("whole"), F.col("copies").cast("double").alias("weight"))))
    basis = latent_axes(fit_on, idf, axes)
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield Search([r["item_id"] for r in block], [r["text"] for r in block], idf, basis)


def _items(benchmark: DataFrame) -> DataFrame:
    return stash(texts(benchmark, "item_id").select(F.col("doc_id").alias("item_id"), "text"), "decontamination-items")


def leaks(docs: DataFrame, benchmark: DataFrame, axes: int = AXES, corpus_weight: float = CORPUS_WEIGHT) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found): the benchmark items
    that a document's row holds, word for word or reworded."""
    rows, items = texts(docs), _items(benchmark)
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for search in searches(rows, items, axes, corpus_weight):
        part = _pairs(rows, search, kind)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item. Each row is judged
    by its own text where it lies, so that no text is shuffled and ids may be
    null or repeat."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs
    for search in searches(docs.select(text.alias("text")), _items(benchmark)):
        out = out.where(~_holds(text, search))
    return out
