"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text.
A dictionary holds the segments that pay most for its class: common words for
ordinary text, and for toxic text the whole words and parts of words, of PIECE
to LONGEST_PIECE characters, whose document rate among toxic texts is many
times that among ordinary ones. Both dictionaries end in
the same ordinary part, so a window of a text compresses shorter with the
toxic one only where it holds toxic pieces. The differences over all windows
of a text are calibrated by logistic regression on labelled texts that took no
part in the dictionaries.

Fitting uses at most about ``max_fit`` labelled texts per class (a documented
bound; chosen by a hash, copies counted once), of rows that may be learned
from only. Scoring reads every text whole.

Defined results: a null, empty or blank text has no window and gets the score
of a text without any difference; repeated rows get equal scores; without
labels of both classes all scores are 0; labels that are null are ignored;
ids without text and other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import learnable, stash, texts

WINDOW, LEVEL, LONGEST = 6, 12, 512
MAX_FIT, FEWEST = 3000, 8
ORDINARY_BYTES, TOXIC_BYTES = 24576, 16384
PIECE, LONGEST_PIECE, RATIO, SHARE = 5, 12, 20.0, 0.01
_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> Iterator[bytes]:
    """Runs of WINDOW words, each after a blank; overlong words are cut."""
    out: list[str] = []
    for w in (text or "").lower().split():
        for a in range(0, len(w), LONGEST):
            out.append(w[a : a + LONGEST])
            if len(out) == WINDOW:
                yield (" " + " ".join(out)).encode("utf-8", "replace")
                out = []
    if out:
        yield (" " + " ".join(out)).encode("utf-8", "replace")


def _pieces(word: str) -> set[str]:
    """The word after a blank, and its parts of PIECE to LONGEST_PIECE characters."""
    s = " " + word
    return {s, *(s[i : i + k] for k in range(PIECE, min(LONGEST_PIECE, len(s)) + 1) for i in range(len(s) - k + 1))}


def _telling_spans(word: str, telling: set[str]) -> list[str]:
    """The parts of a word that overlapping telling pieces cover."""
    s, spans = " " + word, []
    places = [(0, len(s))] if s in telling else sorted((i, i + k) for k in range(PIECE, min(LONGEST_PIECE, len(s)) + 1) for i in range(len(s) - k + 1) if s[i : i + k] in telling)
    for a, z in places:
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(z, spans[-1][1])
        else:
            spans.append([a, z])
    return [s[a:z] for a, z in spans]


def train_dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents from texts of either class."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    nt, no = max(1, len(toxic)), max(1, len(ordinary))
    in_toxic, in_ordinary, common, word_docs = Counter(), Counter(), Counter(), Counter()
    for t in toxic:
        held = set(_WORD.findall(t.lower()))
        word_docs.update(held)
        in_toxic.update({p for w in held for p in _pieces(w)})
    # only pieces that enough toxic texts hold are looked for in ordinary ones
    often = {p for p, n in in_toxic.items() if n >= max(3, SHARE * nt)}
    known: dict[str, set[str]] = {}
    for t in ordinary:
        held = set(_WORD.findall(t.lower()))
        common.update(held)
        for w in held:
            if w not in known:
                known[w] = _pieces(w) & often
        in_ordinary.update(set().union(*(known[w] for w in held)))
    telling = {p for p in often if in_toxic[p] / nt >= RATIO * (in_ordinary[p] + 0.5) / no}
    segments: Counter = Counter()
    for w, n in word_docs.items():
        for x in _telling_spans(w, telling):
            segments[x] += n

    def packed(items: list[tuple[str, int]], limit: int, lead: str = "") -> bytes:
        out = b""  # the most frequent last: the nearest offsets are the cheapest
        for s, _ in items:
            e = (lead + s).encode("utf-8", "replace")
            if len(out) + len(e) > limit:
                break
            out = e + out
        return out

    order = lambda c: sorted(c.items(), key=lambda x: (-x[1], x[0]))
    kept = [x for x in order(segments) if x[1] >= max(2, SHARE * nt / 2)]
    kept = [x for x in kept if not any(x[0] != y[0] and x[0] in y[0] for y in kept)]
    base = packed(order(common)[:20000], ORDINARY_BYTES, " ") or b" the and of to "
    return base, packed(kept, TOXIC_BYTES) + base


class Meter:
    """Per text: how much shorter its windows get with the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self._sizes = [self._compressor(d) for d in (ordinary, toxic)]

    @staticmethod
    def _compressor(raw: bytes):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def features(self, text: str | None) -> tuple[float, ...]:
        plain, toxic = self._sizes
        gains = Counter(len(plain(w)) - len(toxic(w)) for w in windows(text))
        n = sum(gains.values())
        # ordinary windows gain now and then, so a long text has to gain more often; FEWEST keeps short ones from standing out by length
        length = np.log1p(max(n, FEWEST))
        if not n:
            return (0.0, 0.0, 0.0, 0.0, 0.0, length, 0.0, 0.0)
        at = lambda least: sum(c for g, c in gains.items() if g >= least)
        mass = sum(g * c for g, c in gains.items() if g >= 2)
        top = max(max(gains), 0)
        return (float(min(top, 12)), float(min(top, 12) >= 5), np.log1p(at(3)), at(3) / n, mass / n, length, np.log1p(at(2)), np.log1p(at(5)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Coefficients (constant first) by Newton steps on weighted rows."""
    a = np.hstack([np.ones((len(x), 1)), x])
    b = np.zeros(a.shape[1])
    pull = np.full(len(b), ridge)
    pull[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (weight * (y - p)) - pull * b
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull), grad)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _fit(rows: pd.DataFrame, shares: dict[int, float]) -> tuple[bytes, bytes, list[float]] | None:
    half = rows["half"] == 0
    of = lambda part, label: rows.loc[part & (rows["toxic"] == label), "text"].tolist()
    if not of(half, 1) or not of(half, 0):
        return None
    ordinary, toxic = train_dictionaries(of(half, 1), of(half, 0))
    rest = rows[~half]
    if rest["toxic"].nunique() < 2:
        rest = rows
    m = Meter(ordinary, toxic)
    x = np.array([m.features(t) for t in rest["text"]])
    y = rest["toxic"].to_numpy(dtype=float)
    # a class that was thinned out counts for as many rows as it stands for
    w = np.array([1 / shares[int(v)] for v in y])
    return ordinary, toxic, fit_logistic(x, y, w * len(w) / w.sum()).tolist()


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> tuple[bytes, bytes, list[float]] | None:
    """(ordinary dictionary, toxic dictionary, coefficients), or None."""
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    named = named.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learnable(F.col("doc_id")))
    # a row labelled twice with different values counts as toxic
    named = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    shares = {k: min(1.0, max_fit / n) for k, n in counts.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    some = named.where((draw < F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])))
    some = stash(some, "toxicity-rows")
    found = texts(docs).join(some, "doc_id").groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    found = found.withColumn("half", F.pmod(F.xxhash64("sha", F.lit("half")), F.lit(2)).cast("int")).drop("sha")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"text": [], "toxic": [], "half": []}), *batches], ignore_index=True)
        out = _fit(rows.sort_values("text", ignore_index=True), shares)
        if out:
            yield pd.DataFrame({"o": [out[0]], "t": [out[1]], "c": [out[2]]})

    got = found.repartition(1).mapInPandas(run, "o binary, t binary, c array<double>").collect()
    return (bytes(got[0]["o"]), bytes(got[0]["t"]), list(got[0]["c"])) if got else None


def score(docs: DataFrame, model: tuple[bytes, bytes, list[float]] | None) -> DataFrame:
    """(doc_id, score) of every row."""
    rows = texts(docs)
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    ordinary, toxic, coef = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, b = Meter(ordinary, toxic), np.array(coef)
        for batch in batches:
            x = np.array([m.features(t) for t in batch["text"]]).reshape(-1, len(coef) - 1)
            p = 1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": p})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
