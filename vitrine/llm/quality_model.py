"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document; expectation-
maximisation over the counts of their vote patterns (all documents) estimates
their accuracies, without any labelled row. The posterior labels then train a
linear scorer over hashed features: byte 3-grams of the text and binned
measures of it. The scorer is fitted on at most about ``max_fit`` documents (a
documented bound; chosen by a hash of the text, copies once) and scores all.

Defined results: a null or empty text has no words and gets the labellers'
and the scorer's verdict on that, no null; repeated rows get equal scores; an
empty table gives an empty result; long texts are read whole, in chunks; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import stash, texts
from vitrine.llm.weak import LabelModel, fit_label_model

BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
MAX_FIT, CHUNK, EPOCHS, BATCH = 6000, 1 << 20, 6, 64
LABELLERS = ["short", "symbols", "odd_words", "upper", "capitals", "shouts", "one_word", "top_word", "variety", "digits", "lines", "word_length", "prose"]
_SYMBOLS = re.compile(r"[#*$%&|<>{}\\^~]")
_ODD = re.compile(r"[^\w\s.,;:'\"!?()-]{2,}")
_SHOUTS = re.compile(r"[!?]{2,}")
_UPPER = re.compile(r"[A-ZÀ-Þ]")
_DIGITS = re.compile(r"[0-9]")


def shares(text: str) -> dict[str, float]:
    """What the labellers look at."""
    w = text.split()
    n, chars = len(w), max(1, len(text))
    top = Counter(w).most_common(1)[0][1] if w else 0
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "words": n,
        "symbols": len(_SYMBOLS.findall(text)) / max(1, n),
        "odd": len(_ODD.findall(text)) / max(1, n),
        "upper": len(_UPPER.findall(text)) / chars,
        "capitals": sum(map(str.isupper, w)) / max(1, n),
        "shouts": len(_SHOUTS.findall(text)) / max(1, n),
        "top": top / max(1, n),
        "variety": len(set(w)) / max(1, n),
        "same": sum(map(str.__eq__, w, w[1:])) / max(1, n),
        "digits": len(_DIGITS.findall(text)) / chars,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "word_length": sum(map(len, w)) / max(1, n),
    }


def votes(s: dict[str, float]) -> tuple[int, ...]:
    """One vote per labeller: -1 bad, 1 good, 0 abstain. Most labellers only
    speak up against a text; several look at one fault in different ways."""
    n = s["words"]
    some = n >= 10
    against = (
        n < 2,
        s["symbols"] > 0.1,
        some and s["odd"] > 0.3,
        some and s["upper"] > 0.3,
        some and s["capitals"] > 0.4,
        some and s["shouts"] > 0.1,
        some and s["same"] > 0.2,
        some and s["top"] > 0.4,
        n >= 40 and s["variety"] < 0.2 and s["variety"] * s["variety"] * n < 16,
        s["digits"] > 0.3,
        s["lines"] > 0.3,
        n > 0 and not 2 <= s["word_length"] <= 15,
    )
    prose = some and s["symbols"] <= 0.02 and s["upper"] <= 0.1 and s["shouts"] <= 0.02 and s["same"] <= 0.05 and s["digits"] <= 0.1
    return (*(-int(x) for x in against), int(prose))


def features(text: str, s: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): byte 3-gram rates scaled to length one, and one
    bucket for each binned measure."""
    counts = np.zeros(BUCKETS)
    raw = text.encode("utf-8", "replace")
    for a in range(0, max(1, len(raw)), CHUNK):
        x = np.frombuffer(raw[a : a + CHUNK + 2], dtype=np.uint8).astype(np.uint32)
        if len(x) >= 3:
            h = (x[:-2] * np.uint32(65537) ^ x[1:-1] * np.uint32(257) ^ x[2:]) * np.uint32(2654435769)
            counts += np.bincount(h >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)
    counts = np.sqrt(counts)
    length = np.linalg.norm(counts)
    at = np.flatnonzero(counts)
    value = counts[at] / length if length else counts[at]
    bins = [f"{k}:{int(np.log1p(v) * 2) if k == 'words' else int(v) if k == 'word_length' else int(min(v, 2.0) * 20)}" for k, v in s.items()]
    own = np.array([_bucket(b) for b in bins])
    return np.concatenate([at, own]), np.concatenate([value, np.full(len(own), 0.3)])


def _bucket(name: str) -> int:
    h = 2166136261
    for c in name.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h * 2654435769 & 0xFFFFFFFF) >> (32 - BUCKET_BITS)


def posterior(vote: tuple[int, ...], model: LabelModel) -> float:
    odds = np.log(model.prior) - np.log1p(-model.prior) + sum(model.log_odds()[j, v + 1] for j, v in enumerate(vote))
    return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def label_model(rows: DataFrame) -> LabelModel:
    """EM over the vote patterns of all texts; what leaves a task is a count
    per pattern."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            seen.update(votes(shares(t)) for t in b["text"])
        yield pd.DataFrame([(*k, c) for k, c in seen.items()], columns=[*LABELLERS, "n"])

    schema = ", ".join(f"`{n}` int" for n in LABELLERS) + ", n long"
    counted = rows.select("text").mapInPandas(run, schema).groupBy(*LABELLERS).agg(F.sum("n").alias("count"))
    return fit_label_model(counted, LABELLERS, counted=True)


def fit(rows: DataFrame, model: LabelModel, total: int, max_fit: int = MAX_FIT) -> list[float]:
    """Weights per bucket and a constant, by AdaGrad on the posterior labels."""
    draw = F.pmod(F.xxhash64("text", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(draw < min(1.0, max_fit / max(1, total))).groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = []
        for b in batches:
            for sha, t in zip(b["sha"], b["text"]):
                s = shares(t)
                made.append((sha, *features(t, s), posterior(votes(s), model)))
        made.sort(key=lambda x: x[0])
        w, g, c, cg = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0, 1e-6
        for epoch in range(EPOCHS):
            order = np.random.default_rng(epoch).permutation(len(made))
            for a in range(0, len(order), BATCH):
                grad, gc = 1e-5 * w, 0.0
                part = order[a : a + BATCH]
                for i in part:
                    _, at, v, y = made[i]
                    e = y - 1 / (1 + np.exp(-np.clip(c + w[at] @ v, -30, 30)))
                    np.subtract.at(grad, at, e * v / len(part))
                    gc -= e / len(part)
                g += grad**2
                cg += gc**2
                w -= 0.3 * grad / np.sqrt(g)
                c -= 0.3 * gc / np.sqrt(cg)
        yield pd.DataFrame({"w": [[c, *w]]})

    got = some.repartition(1).mapInPandas(run, "w array<double>").collect()
    return list(got[0]["w"]) if got else [0.0] * (BUCKETS + 1)


def quality(docs: DataFrame, threshold: float = 0.5, max_fit: int = MAX_FIT) -> DataFrame:
    """(doc_id, weak_label, score, kept) of every row."""
    rows = texts(docs)
    model = label_model(rows)
    weights = fit(rows, model, rows.count(), max_fit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, w = weights[0], np.array(weights[1:])
        for b in batches:
            weak, score = [], []
            for t in b["text"]:
                s = shares(t)
                at, v = features(t, s)
                weak.append(posterior(votes(s), model))
                score.append(float(1 / (1 + np.exp(-np.clip(c + w[at] @ v, -30, 30)))))
            yield pd.DataFrame({"doc_id": b["doc_id"], "weak_label": np.array(weak, dtype=float), "score": np.array(score, dtype=float)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInPandas(run, f"doc_id {kind}, weak_label double, score double")
    return out.withColumn("kept", F.col("score") >= threshold)
