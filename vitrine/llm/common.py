"""Helpers shared by the text operators: tables kept in the shared checkpoint
folder, words and shingle hashes as column expressions, small vector sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.session import resolve_checkpoint_dir

#: The six ASCII blanks (U+0020, U+0009 to U+000D) separate words.
BLANKS = r"[\x20\x09-\x0D]+"


_made: list[list[str]] = []


@contextmanager
def scratch(spark) -> Iterator[list[str]]:
    """Folders stashed inside, for a caller that knows when they are done
    with: on leaving, those still in the list are deleted."""
    made: list[str] = []
    _made.append(made)
    try:
        yield made
    finally:
        _made.pop()
        for path in made:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared checkpoint folder and
    read it back: lineage ends there, a lost executor costs nothing that was
    computed before it, and the planner knows the true size."""
    spark = df.sparkSession
    path = f"{resolve_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    for made in _made[-1:]:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), a null text as the empty one: other columns of the
    input, whatever their names, can't clash with what an operator adds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """Maximal runs of anything but the six ASCII blanks."""
    return F.filter(F.split(text, BLANKS, -1), lambda w: w != "")


def settled(df: DataFrame, *names: str) -> DataFrame:
    """Columns that later filters and lambdas take as they are. The optimiser
    would otherwise put the expression behind a column in the place of its
    name when it pushes a filter down, and inside a lambda that means
    computing it once per element; it doesn't look through a generator."""
    made = F.explode(F.array(F.struct(*names))).alias("_settled")
    return df.select(*[c for c in df.columns if c not in names], made).select(*[F.col(f"_settled.{c}").alias(c) if c in names else c for c in df.columns])


def running_sums(numbers: str) -> Column:
    """Inclusive running sums of an array column of longs, see :func:`running`."""
    return running(numbers, lambda a, x: a + x)


def running(numbers: str, join) -> Column:
    """Inclusive running values of an array column of longs (at least zero)
    under an associative ``join``. Appending to an array copies it, so values
    are taken in blocks of about the square root of the length, and every
    block is then joined with what stands before it: a hundred thousand
    entries copy a few million, not billions. The column must exist already
    (see :func:`settled`)."""
    c, nothing = F.col(numbers), F.array().cast("array<bigint>")
    step = F.greatest(F.ceil(F.sqrt(F.size(c))), F.lit(1)).cast("int")
    add = lambda acc, x: F.concat(acc, F.array(join(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x)))
    blocks = F.transform(F.sequence(F.lit(0), F.size(c) - 1, step), lambda a: F.aggregate(F.slice(c, a + 1, step), nothing, add))
    raised = F.aggregate(
        blocks, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out")),
        lambda acc, b: F.struct(join(acc["at"], F.element_at(b, -1)).alias("at"), F.concat(acc["out"], F.array(F.transform(b, lambda x: join(acc["at"], x)))).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(F.size(c) > 0, raised).otherwise(nothing)


def find_all(rows: DataFrame, patterns: dict[str, str | Column], guards: dict[str, str] | None = None) -> DataFrame:
    """Adds per pattern the column ``_f_<name>``: its leftmost matches that do
    not overlap, as structs (start, end, value) in code points, null if there
    are none. A text without a match is searched once per pattern and not
    taken apart; places come from the lengths of the pieces between matches.
    A guard is a literal that every match holds; a pattern may be a column
    (null: no match). ``rows`` has ``text``."""
    t, out = F.col("text"), rows
    names = [n for n in patterns]
    for n in names:
        pattern = patterns[n] if isinstance(patterns[n], Column) else F.lit(patterns[n])
        hit = F.regexp_like(t, pattern)
        hit = t.contains(guards[n]) & hit if n in (guards or {}) else hit
        out = out.withColumn(f"_m_{n}", F.when(hit, F.regexp_extract_all(t, pattern, F.lit(0))))
    out = out.withColumns({f"_p_{n}": F.when(F.col(f"_m_{n}").isNotNull(), F.split(t, patterns[n], -1)) for n in names})
    out = settled(out, *[f"_{a}_{n}" for a in "mp" for n in names])

    def steps(n: str) -> Column:
        return F.transform(f"_m_{n}", lambda x, i: (F.length(F.get(f"_p_{n}", i)) + F.length(x)).cast("bigint"))

    lengths = {f"_l_{n}": steps(n) for n in names}
    out = settled(out.withColumns(lengths).drop(*[f"_p_{n}" for n in names]), *lengths)
    out = settled(out.withColumns({f"_e_{n}": running_sums(f"_l_{n}") for n in names}).drop(*lengths), *[f"_e_{n}" for n in names])

    def placed(n: str) -> Column:
        return F.transform(f"_m_{n}", lambda x, i: F.struct((F.get(f"_e_{n}", i) - F.length(x)).alias("start"), F.get(f"_e_{n}", i).alias("end"), x.alias("value")))

    return out.withColumns({f"_f_{n}": placed(n) for n in names}).drop(*[f"_{a}_{n}" for a in "me" for n in names])


def window_hashes(word_hashes: str, n: int) -> Column:
    """64-bit hashes of all runs of ``n`` neighbours in an array column of word
    hashes; empty if there are fewer. The column must exist already: it is
    looked up inside the lambda and must not be computed there."""
    c = F.col(word_hashes)
    return F.when(
        F.size(c) >= n,
        F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.xxhash64(*[F.get(c, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))


def vector_total(parts: DataFrame, key: str, value: str, length: int) -> dict:
    """Sum array columns element by element; one bounded vector per key
    reaches the driver. ``parts`` has one row per task and key."""
    flat = parts.select(key, F.posexplode(value).alias("i", "x")).where("x <> 0")
    rows = flat.groupBy(key, "i").agg(F.sum("x").alias("x")).groupBy(key).agg(F.collect_list(F.struct("i", "x")).alias("v")).collect()
    out = {}
    for r in rows:
        v = np.zeros(length)
        for e in r["v"]:
            v[e["i"]] = e["x"]
        out[r[key]] = v
    return out


def learnable(doc_id: Column) -> Column:
    """Rows a classifier may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(True))
