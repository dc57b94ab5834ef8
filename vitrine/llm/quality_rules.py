"""Quality rules by weak supervision (DataFrame functions only).

Every rule votes good (1), bad (-1) or abstains (0) on a document. EM over the
counts of vote patterns estimates how accurate each rule is; a document stays
if its posterior probability of being good reaches the threshold, instead of
having to pass every rule.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows are judged alike, each for itself; an empty table gives an empty
result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import settled, stash, texts, window_hashes, words
from vitrine.llm.weak import VOTES, LabelModel, fit_label_model

__all__ = ["VOTES", "measures", "rule_votes", "base_failed", "fit_rules", "judge"]

WINDOW = 5


def measures(rows: DataFrame) -> DataFrame:
    """Adds the counts the rules look at to a frame with a ``text`` column.

    Each step is a projection of its own, so that arrays looked up inside a
    lambda are computed once per row.
    """
    t = F.col("text")
    with_word = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = rows.withColumn("_w", words(t))
    a = a.select(
        *rows.columns,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(t, r"[^!?]+", "")).cast("long").alias("n_shouts"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        with_word.alias("_l"),
    )
    a = a.withColumn("_x", window_hashes("_h", WINDOW)).withColumn("n_lines", F.size("_l").cast("long"))
    a = a.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("_l"))).drop("_l", "_h")
    # windows found twice: neighbours in the order of (hash, place); only rows
    # that have any go to the sort
    a = a.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_x")) < F.size("_x"), F.array_sort(F.transform("_x", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("_x")
    s = F.col("_s")
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    a = a.withColumn("_p", F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))).drop("_s")
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
    covered = F.aggregate(
        "_p", start,
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW).cast("long"), p - acc["last"])).alias("n"), p.cast("long").alias("last")),
        lambda acc: acc["n"],
    )
    a = a.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")
    return settled(a, "n_repeat_words", "n_dup_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_votes() -> dict[str, Column]:
    """The rules, over the columns of :func:`measures`. Most speak up against
    a text or abstain; several look at the same fault in different ways, so
    that their agreement tells how far each can be trusted."""
    n, chars = F.col("n_words"), F.col("word_chars")
    symbols, upper, shouts, again = F.col("n_symbols"), F.col("n_upper"), F.col("n_shouts"), F.col("n_repeat_words")
    some = n >= 10
    against = {
        "short": n < 10,
        "word_length": (n > 0) & ((chars < 2 * n) | (chars > 15 * n)),
        "symbols_by_word": 10 * symbols > n,
        "symbols_by_char": 50 * symbols > chars,
        "upper_by_char": some & (100 * upper > 30 * chars),
        "upper_by_word": some & (2 * upper > 3 * n),
        "shouting": some & (4 * shouts > n),
        "repeats": 100 * again > 20 * n,
        "mostly_repeats": 100 * again > 50 * n,
        # vocabulary grows about with the square root of a long text's length
        "variety": (n >= 40) & (5 * F.col("n_distinct") < n) & (F.col("n_distinct") * F.col("n_distinct") < 16 * n),
        "lines": (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines")),
    }
    prose = some & (100 * symbols <= 2 * n) & (100 * upper <= 12 * chars) & (20 * shouts <= n) & (100 * again <= 10 * n)
    return {k: F.when(bad, -1).otherwise(0) for k, bad in against.items()} | {"prose": F.when(prose, 1).otherwise(0)}


def fit_rules(measured: DataFrame) -> LabelModel:
    """EM over the vote patterns of all rows (at most 2 ** rules counts)."""
    votes = rule_votes()
    return fit_label_model(measured.select(*[c.alias(k) for k, c in votes.items()]), list(votes))


def judge(measured: DataFrame, model: LabelModel, threshold: float = 0.5) -> DataFrame:
    """Adds base_failed, quality (posterior probability) and kept."""
    return (
        measured.withColumn("base_failed", base_failed())
        .withColumn("quality", model.posterior(rule_votes()))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def quality_rules(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, counts, base_failed, quality, kept) of every row."""
    m = stash(measures(texts(docs)).drop("text"), "quality-measures")
    return judge(m, fit_rules(m), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only. Texts
    are measured once: rows are stored with their votes, which are counted and
    judged from there."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    votes = rule_votes()
    voted = measures(row).select("_row", base_failed().alias("_failed"), *[v.alias(f"_v_{k}") for k, v in votes.items()])
    voted = stash(voted.where(F.col("_row").isNotNull()), "quality-votes")
    named = {k: F.col(f"_v_{k}") for k in votes}
    model = fit_label_model(voted.select(*[c.alias(k) for k, c in named.items()]), list(votes))
    return voted.where(~F.col("_failed") & (model.posterior(named) >= threshold)).select("_row.*")
