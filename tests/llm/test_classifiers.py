"""The classifiers and the label model, each step again in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from vitrine.llm import language, toxicity, weak

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ language
def slow_gram_buckets(text):
    """Buckets of the 1- to 3-grams of letters; a run of anything else is one
    blank, and a blank stands before and after the text."""
    m32 = (1 << 32) - 1
    chars, last = [32], None
    for c in text.lower():
        if c.isalpha():
            chars.append(ord(c))
        elif last is None or last.isalpha():
            chars.append(32)
        last = c
    chars.append(32)

    def bucket(h):
        return ((h ^ (h >> 16)) * 2654435769 & m32) >> (32 - language.BUCKET_BITS)

    one = [c * 2654435761 & m32 for c in chars]
    two = [((a ^ (a >> 15)) * 2246822519 + b) & m32 for a, b in zip(one, one[1:])]
    three = [((a ^ (a >> 13)) * 3266489917 + b) & m32 for a, b in zip(two, one[2:])]
    return Counter(bucket(h) for h in [*(x for x, c in zip(one, chars) if c != 32), *two, *three])


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000").select("doc_id", "text", "lang")
    return docs, docs.collect(), language.fit(docs)


def slow_vector(text, idf):
    v = {b: math.log1p(n) * idf[b] for b, n in slow_gram_buckets(text).items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {b: x / norm for b, x in v.items()}


def test_language_weights_centroids_and_cosines_match_brute_force(learnt):
    docs, rows, model = learnt
    rows = [r for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    held = Counter(b for r in rows if r["lang"] for b in slow_gram_buckets(r["text"]))
    n = sum(r["lang"] is not None for r in rows)
    want = [math.log((1 + n) / (1 + held[b])) + 0.1 for b in range(language.BUCKETS)]
    assert np.allclose(model["idf"], want, atol=1e-5)

    # every centroid is the direction of the learnt texts that are nearest to it among its language's
    own = {}
    for text, lang in {(r["text"], r["lang"]) for r in rows if r["lang"]}:
        v = slow_vector(text, want)
        at = [j for j, x in enumerate(model["lang"]) if x == lang]
        cos = [sum(x * model["c"][j][b] for b, x in v.items()) for j in at]
        total = own.setdefault(at[int(np.argmax(cos))], Counter())
        for b, x in v.items():
            total[b] += x
    for j, total in own.items():
        norm = math.sqrt(sum(x * x for x in total.values()))
        assert sum(x / norm * model["c"][j][b] for b, x in total.items()) > 0.98

    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    for r in rows:
        v = slow_vector(r["text"], want)
        cos = [sum(x * c[b] for b, x in v.items()) for c in model["c"].astype(float)]
        best = max(range(len(cos)), key=cos.__getitem__)
        mine, near = got[r["doc_id"]], sorted(cos)[-2:]
        assert abs(mine["cosine"] - cos[best]) < 1e-4
        of = {x: max(c for c, y in zip(cos, model["lang"]) if y == x) for x in model["lang"]}
        if near[1] - near[0] > 1e-4:
            assert mine["lang_pred"] == model["lang"][best]
            assert mine["rejected"] == (cos[best] < model["least"][best]) or abs(cos[best] - model["least"][best]) < 1e-4
        share = 1 / sum(math.exp(language.SHARPNESS * (c - cos[best])) for c in of.values())
        assert abs(mine["score"] - share) < 1e-2


# ------------------------------------------------------------------ toxicity
def test_toxicity_windows_lengths_and_scores_match_brute_force(spark):
    rng = random.Random(3)
    plain = ["river", "house", "morning", "table", "walked", "quiet", "garden", "letter", "seven", "window", "été", "café"]
    bad = ["grobnaxic", "vilethrum", "scornbeak"]
    rows = []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        for _ in range(3 * (i % 2)):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "x" * 5000)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    ordinary, toxic, coef = model

    def shorter(raw, window):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(window))

    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == 403 and got[1000] == got[1001]
    for i, t in rows[:60]:
        words = t.lower().split()
        gains = [shorter(ordinary, w) - shorter(toxic, w) for w in (" " + " ".join(words[a : a + toxicity.WINDOW]) for a in range(0, len(words), toxicity.WINDOW)) for w in [w.encode()]]
        n, top = len(gains), max(0, *gains)
        at = [sum(g >= k for g in gains) for k in (2, 3, 5)]
        x = [1, min(top, 12), float(min(top, 12) >= 5), math.log1p(at[1]), at[1] / n, sum(g for g in gains if g >= 2) / n, math.log1p(max(n, toxicity.FEWEST)), math.log1p(at[0]), math.log1p(at[2])]
        odds = sum(a * b for a, b in zip(coef, x))
        assert abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, odds))))) < 1e-9
    assert not [i for i, _ in rows if i % 2 == 0 and got[i] >= 0.3]
    assert sum(got[i] >= 0.3 for i, _ in rows if i % 2) >= 198


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = [(i, f"words number {i} " + ("vilethrum grobnaxic " if i % 2 else "") + "and a few more") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    wrong = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, wrong)


# --------------------------------------------------------------- label model
def slow_em(rows, prior, weight, steps):
    """Expectation-maximisation row by row, with the start of the library."""
    k, n = len(rows[0]), len(rows)
    pseudo = []
    for j in range(k):
        seen = [sum(r[j] == v for r in rows) + 0.5 for v in (-1, 0, 1)]
        bad, _, fine = (x / sum(seen) for x in seen)
        clip = lambda x: min(0.9, max(1e-4, x))
        low = [clip(0.8 * bad / (1 - prior)), clip(0.2 * bad / prior)]
        high = [clip(0.1 * fine / (1 - prior)), clip(0.9 * fine / prior)]
        over = [max(1, (a + b) / 0.95) for a, b in zip(low, high)]
        low, high = [a / o for a, o in zip(low, over)], [a / o for a, o in zip(high, over)]
        pseudo.append({-1: low, 0: [1 - a - b for a, b in zip(low, high)], 1: high})
    table, good = pseudo, prior
    for _ in range(steps):
        ps = []
        for r in rows:
            a = math.log(good) + sum(math.log(table[j][v][1]) for j, v in enumerate(r))
            b = math.log(1 - good) + sum(math.log(table[j][v][0]) for j, v in enumerate(r))
            ps.append(1 / (1 + math.exp(b - a)))
        new = []
        for j in range(k):
            mass = {v: [weight * pseudo[j][v][c] + sum((p if c else 1 - p) for r, p in zip(rows, ps) if r[j] == v) for c in (0, 1)] for v in (-1, 0, 1)}
            new.append({v: [mass[v][c] / sum(mass[u][c] for u in mass) for c in (0, 1)] for v in mass})
        good = min(0.99, max(0.01, (sum(ps) + weight * prior) / (n + weight)))
        table = new
    return good, table


@pytest.mark.parametrize("steps", [1, 7])
def test_label_model_and_posterior_match_row_by_row_em(spark, steps):
    rng = random.Random(11)
    rows = []
    for _ in range(400):
        good = rng.random() < 0.8
        rows.append(tuple((1 if good == (rng.random() < acc) else -1) if rng.random() < 0.7 else 0 for acc in (0.9, 0.8, 0.7, 0.6)))
    names = ["a", "b", "c", "d"]
    frame = spark.createDataFrame(rows, "a int, b int, c int, d int")
    model = weak.fit_label_model(frame, names, steps=steps)
    good, table = slow_em(rows, 0.9, 20.0, steps)
    assert abs(model.prior - good) < 1e-9
    assert np.allclose(model.table, [[t[v] for v in (-1, 0, 1)] for t in table], atol=1e-9)
    got = frame.select(*names, model.posterior({n: F.col(n) for n in names}).alias("p")).distinct().collect()
    for r in got:
        up = good * math.prod(table[j][r[n]][1] for j, n in enumerate(names))
        down = (1 - good) * math.prod(table[j][r[n]][0] for j, n in enumerate(names))
        assert abs(r["p"] - up / (up + down)) < 1e-9
