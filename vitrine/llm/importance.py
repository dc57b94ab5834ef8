"""Importance resampling towards a target distribution, on Arrow kernels.

Hashed n-gram counts of the raw corpus (s of S features in a bucket) and of
the target texts (t of T) give every bucket a gain, ``floor(1000 * ln((t + 1)
(S + buckets) / ((s + 1) (T + buckets))))``. A document's weight is the mean of
its features' gains, rounded down; a Gumbel draw from the digest of its id is
added, and the documents with the highest sums are drawn without replacement.

Texts go through Arrow a few megabytes at a time: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` leave one
index per word. Shifted indices form pairs (gram, next word); a distinct pair
extends the CRC of its gram by the word, so that no n-gram string is ever
built. ``take`` looks the gains up and running sums reduce them per document.
Texts longer than a slice are cut between words, with as many words carried
over as n-grams need.

What grows with the corpus stays distributed: a task returns at most one count
per bucket, the driver holds ``buckets`` gains and the number of documents per
integer score. Only documents at or above the lowest score drawn are sorted.

Defined results: a null, empty or blank text has no features, weight 0 and is
never drawn (it has fewer than ``least_words`` words); ties in the score go to
the smaller id, a null id last; rows that repeat an id are weighed and drawn
each for itself and follow each other in any order; no target texts leave all
t at 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import stash, texts
from vitrine.plans.ranking import global_rank

NGRAM, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: What stands between words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLICE = 4 << 20


def _slices(text: pa.Array, ngram: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, texts, words of each that were counted before): runs of
    whole texts of about SLICE bytes; a longer text alone, cut between words."""
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate([*size, None]):
        if n is None or n > SLICE or held + n > SLICE:
            if i > start:
                yield start, text.slice(start, i - start), np.zeros(i - start, dtype=np.int64)
            start, held = i, 0
        if n is not None and n > SLICE:
            for piece, skip in _cut(text[i].as_py(), ngram):
                yield i, pa.array([piece], pa.string()), np.array([skip])
            start, held = i + 1, 0
        else:
            held += n or 0


def _cut(text: str, ngram: int) -> Iterator[tuple[str, int]]:
    """Pieces of a long text that end between words, each opened by the last
    words before it; with their number."""
    between, at, carry = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 0, []
    while at < len(text):
        m = between.search(text, min(len(text), at + SLICE // 4))
        end = m.end() if m else len(text)
        piece = text[at:end]
        yield (" ".join([*carry, piece]) if carry else piece), len(carry)
        if ngram > 1:
            carry = [w for w in between.split(" ".join([*carry, piece[-SLICE // 4 :]])) if w][-(ngram - 1) :]
        at = end


def _grams(text: pa.Array, skip: np.ndarray, ngram: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and per n-gram size (text of each gram, its bucket).
    Grams that end within the first ``skip`` words of a text are left out."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(text, "")), pattern=BETWEEN)
    flat = pc.list_flatten(split)
    full = pc.not_equal(flat, "")
    row = pc.filter(pc.list_parent_indices(split), full).to_numpy().astype(np.int64)
    coded = pc.filter(flat, full).dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    spelt = coded.dictionary.cast(pa.binary()).to_pylist()
    n_words = np.bincount(row, minlength=len(text))
    place = np.arange(len(row)) - (np.cumsum(n_words) - n_words)[row]
    gram, crc, out = word, np.fromiter(map(zlib.crc32, spelt), np.uint32, len(spelt)), []
    for k in range(1, ngram + 1):
        n = max(0, len(row) - k + 1)
        whole = row[:n] == row[k - 1 :]
        if k > 1:
            pairs, gram = np.unique(np.where(whole, gram[:n] * len(spelt) + word[k - 1 :], -1), return_inverse=True)
            first, last = (x.tolist() for x in np.divmod(np.maximum(pairs, 0), max(1, len(spelt))))
            crc = np.fromiter((zlib.crc32(b" " + spelt[j], int(crc[i])) for i, j in zip(first, last)), np.uint32, len(pairs)) if spelt else crc
        whole &= place[:n] + k > skip[row[:n]]
        out.append((row[:n][whole], (crc.astype(np.int64) % buckets)[gram[:n][whole]]))
    return n_words - skip, out


def _text_column(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def bucket_counts(docs: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, piece, skip in _slices(b.column("text"), ngram):
                for _, bucket in _grams(piece, skip, ngram, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["bucket", "n"])

    rows = _text_column(docs).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """The gain of every bucket."""
    s_all, t_all, b = float(raw.sum()), float(target.sum()), len(raw)
    return [math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(raw.tolist(), target.tolist())]


def weights(docs: DataFrame, gains: list[int], ngram: int = NGRAM) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = pa.array(gains, pa.int64())
        for b in batches:
            words, features, total = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
            for at, piece, skip in _slices(b.column("text"), ngram):
                n_words, grams = _grams(piece, skip, ngram, len(gains))
                here = slice(at, at + len(piece))
                words[here] += n_words
                for row, bucket in grams:
                    ends = np.cumsum(np.bincount(row, minlength=len(piece)))
                    sums = np.concatenate([[0], np.cumsum(pc.take(gain, pa.array(bucket)).to_numpy())])[np.concatenate([[0], ends])]
                    features[here] += np.diff(np.concatenate([[0], ends]))
                    total[here] += np.diff(sums)
            weight = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    rows = texts(docs).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel draw, rounded down, from the first 32 bits of the
    digest of ``seed:doc_id`` (a null id counts as an empty one)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row; rank
    counts the drawn documents from 1 by falling score and is null elsewhere.
    Drawn are ``percent`` % of those with at least ``least_words`` words."""
    gains = bucket_gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets))
    scored = weights(docs, gains, ngram).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stash(scored, "importance-scores")
    able = F.col("n_words") >= least_words
    # one row per integer score: bounded by the range of gains and draws
    by_score = sorted(((r["score"], r["count"]) for r in scored.where(able).groupBy("score").count().collect()), reverse=True)
    wanted, seen, lowest = percent * sum(n for _, n in by_score) // 100, 0, None
    for score, n in by_score:
        if seen >= wanted:
            break
        seen, lowest = seen + n, score
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if lowest is None:
        return none
    near = able & (F.col("score") >= lowest)
    ranked = global_rank(scored.where(near), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(none.where(~near))
