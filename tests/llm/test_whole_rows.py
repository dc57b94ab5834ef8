"""No row and no link is lost to its id, its length or its place in a text."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vitrine.llm import pii, quality_model, quality_rules, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n))


# ------------------------------------------------------------------- SimHash
def test_one_row_of_each_group_whatever_the_ids(spark):
    a, b, c, d = (prose(i, 60) for i in range(4))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b), (None, c), (None, d), (None, c), (4, d), (5, ""), (6, None)]
    df = spark.createDataFrame([(*r, "en", "s", 1, "x") for r in rows], SCHEMA + ", _fp string")
    slow = [(i, t, simhash.fingerprint(t)) for i, t in rows]
    out = simhash.keep_one(df).collect()
    # groups by brute force: smallest id of each, a null one last
    groups = []
    for r in slow:
        near = [g for g in groups if any((r[2] ^ x[2]).bit_count() <= 3 for x in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [r]]
    want = Counter(min(g, key=lambda r: (r[0] is None, r[0] or 0, r[2] - (1 << 64) * (r[2] >> 63)))[0] for g in groups)
    assert Counter(r["doc_id"] for r in out) == want and want[1] == 2 and want[None] == 1
    assert {r["text"] for r in out if r["doc_id"] == 1} == {a, b}
    assert out[0]["_fp"] == "x" and simhash.keep_one(df.limit(0)).count() == 0


def test_an_id_with_two_texts_joins_no_groups(spark):
    a, b = prose(1, 50), prose(2, 50)
    df = spark.createDataFrame([(1, a), (1, b), (7, a), (9, b)], "doc_id long, text string")
    fps = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert len(fps) == 4 and set(fps.values()) == {1}
    assert simhash.keep_one(df).count() == 2


# -------------------------------------------------------------- length switches
@pytest.mark.parametrize("n", [400, 1999, 2000, 4999, 5000, 20000])
def test_word_salad_is_no_better_when_longer(n):
    rng, words = random.Random(n), prose(0, 40).split()
    text = " ".join(rng.choice(words) for _ in range(n))
    assert quality_model.votes(quality_model.shares(text))[8] == -1


def test_rules_on_word_salad_of_any_length(spark):
    rng, words = random.Random(8), prose(0, 40).split()
    rows = [(n, " ".join(rng.choice(words) for _ in range(n))) for n in (400, 1999, 2000, 20000)] + [(1, prose(3, 20000))]
    measured = quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["v"] for r in measured.select("doc_id", quality_rules.rule_votes()["variety"].alias("v")).collect()}
    assert got == {400: -1, 1999: -1, 2000: -1, 20000: -1, 1: 0}


def test_stage_keeps_what_the_query_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).where("kept").collect()}
    assert {r["doc_id"] for r in quality_rules.keep_good(docs).collect()} == kept


# ------------------------------------------------------------- personal data
def slow_terms(rows, generalise=0.9, support=3):
    """Ratios by plain counting, for texts of which no two are near copies."""
    docs = []
    for t in rows:
        found = re.findall(r"[a-z0-9.]+@[a-z0-9-]+\.[a-z]+", t)
        plain = re.sub(r"[a-z0-9.]+@[a-z0-9-]+\.[a-z]+", " ", t)
        docs.append((set(found), {w.lower() for w in re.findall(r"[^\W\d_]{3,}", plain)}, {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}))
    n, out = len(docs), {}
    for e in {e for d in docs for e in d[0]}:
        n_e = sum(e in d[0] for d in docs)
        for w in {w for d in docs if e in d[0] for w in d[1]}:
            n_te, n_t = sum(e in d[0] and w in d[1] for d in docs), sum(w in d[2] for d in docs)
            if n_e >= support and n_te >= support and n > n_e:
                ratio = math.log2(n * n_te / (n_t * n_e)) / math.log2(n / n_e)
                if ratio >= generalise:
                    out[w] = max(out.get(w, 0), ratio)
    return out


def test_disclosing_terms_match_plain_counts_wherever_they_stand(spark):
    rng, pool = random.Random(4), prose(5, 3000).split()
    fill = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    rows = [f"Zanzibarov {fill(60)} mail to anna@example.com {fill(40)}" for _ in range(8)]  # the name stands far off
    rows += [f"{fill(30)} bob@example.org {fill(30)} Quillfeather {fill(20)}" for _ in range(6)] + [f"{fill(50)} Quillfeather {fill(10)}"]
    rows += [f"{fill(70)} carl@example.net {fill(10)}" for _ in range(2)] + [fill(rng.randrange(5, 90)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    from vitrine.llm.common import texts

    found = pii.base_spans(texts(df))
    got = {r["term"]: r["ratio"] for r in pii.disclosing_terms(found, texts(df)).collect()}
    want = slow_terms(rows)
    assert got == pytest.approx(want) and "zanzibarov" in got and "quillfeather" in got
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "anovzibar" not in clean[0] and "Zanzibarov" not in clean[0] and "[EMAIL]" in clean[0]


def test_copies_of_a_document_disclose_nothing(spark):
    base = prose(6, 80)
    rows = [(i, f"{base} dave@example.com Copyname {prose(100 + i, 4)}") for i in range(40)] + [(100 + i, prose(200 + i, 50)) for i in range(100)]
    from vitrine.llm.common import texts

    df = texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert pii.disclosing_terms(pii.base_spans(df), df) is None


def test_many_spans_long_texts_and_overlaps(spark):
    text = "1.2.3.4 x " * 30000 + "é日 a@b.cc tail"
    df = spark.createDataFrame([(1, text), (1, "+1 555 123 4567 8.8.8.8 end"), (2, None), (3, "")], "doc_id long, text string")
    got = [r["text"] for r in pii.sanitise(df).orderBy(F.length("text").desc_nulls_last()).collect()]
    assert got[0] == "[IP] x " * 30000 + "é日 [EMAIL] tail"
    assert not re.search(r"\d", got[1]) and got[1].endswith(" end") and got[2:] == ["", None]


# ------------------------------------------------------------------ pipeline
def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline
    import os

    pytest.importorskip("public_tokenizers")
    good, other = prose(11, 200), prose(12, 200)
    rows = [(1, good), (1, other), (2, good), (None, prose(13, 150)), (5, None), (6, ""), (7, " \n"), (8, "word"), (9, prose(14, 30000))]
    bench = spark.createDataFrame([(1, prose(15, 30)), (2, None)], "item_id long, text string")
    for name, some in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame([(*r, None, None, 1, "x") for r in some], SCHEMA + ", _row string").write.parquet(f"{folder}/documents.parquet")
        (bench if some else bench.limit(0)).write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).toPandas()
    assert Counter(out[out.piece == 0].doc_id.fillna(-1).astype(int)) == Counter({1: 2, -1: 1, 9: 1})
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert os.path.exists(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
