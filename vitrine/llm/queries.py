"""The registered queries of this subpackage: whole tables, production
parameters. ``QUERIES`` maps names to ``(spark, sf_dir) -> DataFrame``;
``SQL`` has the DuckDB statement where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import decontaminate, importance, language, license, packing, pii, quality_model, quality_rules, secret_scan, simhash, toxicity, url_filter, whitening
from vitrine.llm.common import learnable
from vitrine.llm.oracle import IMPORTANCE_SQL, SECRET_SQL, URL_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The four rules of the contract, as written there.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(pii.listed(F.col("_spans")), 256).alias("base_sha256"),
        pii.listed(F.concat("_spans", "_terms")).alias("spans"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(learnable(F.col("doc_id"))))
    return language.predict(docs, model).withColumn("held_out", ~learnable(F.col("doc_id")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"), license.make_templates(spark))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", ~learnable(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.make_rules(spark, URL_RULES)
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    number = lambda field, value: F.size(F.filter("found", lambda s: s[field] == value)).cast("long").alias(f"n_{value}")
    base = F.filter("found", lambda s: s["kind"].isin(*secret_scan.BASE))
    return found.select(
        "doc_id",
        *[number("kind", k) for k in secret_scan.BASE],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("found")).alias("spans"),
        *[number("verdict", v) for v in ("live", "example")],
        secret_scan.joined(F.filter("found", lambda s: s["verdict"] == "live")).alias("live_spans"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_pii": op2_pii,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op5_license_scan": op5_license_scan,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_secret_scan": op12_secret_scan,
    "op13_embedding_whitening": op13_embedding_whitening,
}

SQL = {"op7_url_filter": URL_SQL, "op11_importance_resampling": IMPORTANCE_SQL, "op12_secret_scan": SECRET_SQL}
