"""Language by nearest centroid of TF-IDF n-gram vectors.

A text becomes counts of hashed letter 1- to 3-grams (lower case, anything but
letters is a blank), damped by log, weighted by inverse document frequency and
scaled to length one. Each language has several centroids, found by spherical
k-means, since one language may hold several kinds of text. The nearest
centroid by cosine decides; a text farther from it than nearly all the texts
it was learned from is flagged as rejected.

Document frequencies are counted over all rows that may be learned from;
clustering uses at most about ``max_fit`` texts per language (a documented
bound; chosen by a hash of the text, copies once).

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if there is nothing to learn from; rows with a null language
teach nothing; repeated rows get equal results; texts of any length are read
whole, in chunks; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import stash, vector_total

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
CENTROIDS, MAX_FIT, BLOCK, CHUNK = 4, 1500, 256, 1 << 20
SHARPNESS = 25.0
REJECT_QUANTILE = 0.005
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts per bucket, or None if the text has no letter."""
    if not text:
        return None
    counts = np.zeros(BUCKETS, dtype=np.int64)
    some = False
    for a in range(0, len(text), CHUNK):
        x = np.frombuffer(text[a : a + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[x]
        if not letter.any():
            continue
        some = True
        x = np.where(letter, x, 32).astype(np.uint32)
        x = np.concatenate(([32], x[np.concatenate(([True], letter[1:] | letter[:-1]))], [32])).astype(np.uint32)
        mixed = x * np.uint32(2654435761)
        two = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(2246822519) + mixed[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + mixed[2:]
        for h in (mixed[x != 32], two, three):
            h = (h ^ (h >> np.uint32(16))) * np.uint32(2654435769)
            counts += np.bincount(h >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    return counts if some else None


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit rows, whether the text has a letter)."""
    x, ok = np.zeros((len(texts), BUCKETS), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    for i, t in enumerate(texts):
        c = ngram_counts(t)
        if c is not None:
            v = np.log1p(c) * idf
            x[i], ok[i] = v / max(np.linalg.norm(v), 1e-12), True
    return x, ok


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit rows; starts from the mean and the rows farthest
    from what is there, so it needs no chance."""
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-12)
    c = [unit(x.mean(axis=0))]
    while len(c) < min(k, len(x)):
        c.append(x[np.argmin((x @ np.array(c).T).max(axis=1))])
    c = np.array(c)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        new = np.array([unit(x[own == j].mean(axis=0)) if (own == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(BUCKETS + 1)
        for b in batches:
            for t in b["text"]:
                c = ngram_counts(t)
                if c is not None:
                    df[:-1] += c > 0
                    df[-1] += 1
        yield pd.DataFrame({"k": ["df"], "v": [df.tolist()]})

    total = vector_total(rows.select("text").mapInPandas(run, "k string, v array<double>"), "k", "v", BUCKETS + 1)
    v = total.get("df", np.zeros(BUCKETS + 1))
    return v[:-1], int(v[-1])


def fit(docs: DataFrame, centroids: int = CENTROIDS, max_fit: int = MAX_FIT) -> dict | None:
    """idf, labels, centroids and rejection bounds; ``docs`` are the rows to
    learn from, with text and lang."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    df, n = _document_frequencies(rows)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    draw = F.pmod(F.xxhash64("text", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, min(1.0, max_fit / c))])
    some = rows.where(draw < F.element_at(share, F.col("lang"))).groupBy("lang", F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"))
    some = stash(some.select("lang", "text"), "language-rows")

    def cluster(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, ok = vectors(part["text"].sort_values().tolist(), idf)
        x = x[ok]
        if not len(x):
            return pd.DataFrame({"lang": [], "c": [], "least": []})
        c = spherical_kmeans(x, centroids)
        least = float(np.quantile((x @ c.T).max(axis=1), REJECT_QUANTILE))
        return pd.DataFrame({"lang": [key[0]] * len(c), "c": [r.tolist() for r in c], "least": [least] * len(c)})

    got = some.groupBy("lang").applyInPandas(cluster, "lang string, c array<float>, least double").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["lang"], list(r["c"])))
    return {"idf": idf, "lang": [r["lang"] for r in got], "c": np.array([r["c"] for r in got], dtype=np.float32), "least": np.array([r["least"] for r in got])}


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score, cosine, rejected) of every row, from its text alone."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, cosine double, rejected boolean"
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cosine"), F.lit(True).alias("rejected"))
    langs = sorted(set(model["lang"]))
    column = np.array([langs.index(x) for x in model["lang"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for a in range(0, len(b), BLOCK):
                part = b.iloc[a : a + BLOCK]
                x, ok = vectors(part["text"].tolist(), model["idf"])
                cos = x @ model["c"].T
                best = np.stack([cos[:, column == j].max(axis=1) for j in range(len(langs))], axis=1)
                p = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
                p /= p.sum(axis=1, keepdims=True)
                at, near = best.argmax(axis=1), cos.argmax(axis=1)
                top = cos.max(axis=1).astype(float)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"],
                    "lang_pred": [langs[j] if o else "und" for j, o in zip(at, ok)],
                    "score": np.where(ok, p.max(axis=1), 0.0).astype(float),
                    "cosine": np.where(ok, top, 0.0),
                    "rejected": ~ok | (top < model["least"][near]),
                })

    return rows.mapInPandas(run, schema)

