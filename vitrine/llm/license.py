"""License scan (DataFrame functions only).

Templates and texts become shingles of five words (lower case, runs of letters
and digits). Per size class, overlapping windows of a text are sketched by
one-permutation MinHash: a shingle's hash names a bin and the smallest hash of
a bin is its band value. A window and a template that agree in a band meet by
an equi-join. Classes are by the number of shingles of a template: for class c
(a power of two not below that number) windows have 2c shingles and start every
c, so that a template of that class lies whole in one of them. The number of
bins is such that a window which holds a part of ``similarity`` of the template
agrees with it in no band with probability at most ``miss`` (:func:`bins`);
class one has windows of one shingle, where one bin is certain. Retrieved pairs
are verified by exact containment: the share of the template's distinct
shingles that the window and its neighbours hold.

Texts are cut into blocks of BLOCK shingles (with what the windows at the edges
need), so that no row grows with its text. A window agrees with a template in a
band only if that band's smallest hash is one of the template's, so a block
without any shingle of any template can't be retrieved: up to ``known_limit``
template shingles are written into the plan and such blocks are left out before
sketching. No pair is lost by that; beyond the limit all blocks are sketched.
What is joined is (row, block, place, value); shingles are fetched for the
places found.

Defined results: null, empty and short texts have no shingle and match
nothing; repeated rows match alike, each for itself; templates of equal text
match alike; an empty table of either kind gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.common import settled, stash, texts, window_hashes

SHINGLE, SIMILARITY, MISS, KNOWN_LIMIT, BLOCK = 5, 0.8, 1e-3, 100_000, 2048

#: Notices as they stand in public licenses and their usual one-line forms.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def make_templates(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    rows = [(i, n, t) for i, (n, t) in enumerate(templates)]
    return spark.createDataFrame(rows, "template_id int, license string, template string")


def _shingled(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``_x``: hashes of the five-word shingles of a text column."""
    w = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    hashed = settled(rows.withColumn("_h", F.transform(w, lambda x: F.xxhash64(x))), "_h")
    return settled(hashed.withColumn("_x", window_hashes("_h", SHINGLE)).drop("_h"), "_x")


def bins(width: int, size: int, part: int, miss: float = MISS) -> int:
    """Bins for windows of ``width`` shingles that hold ``part`` of the
    ``size`` ones of a template. With u shingles in both together, a shared one
    is alone or smallest in its bin with probability (1 - exp(-x)) / x, where
    x = (u - 1) / bins; all ``part`` of them lose theirs with probability at
    most ``miss`` (shared ones that meet in a bin don't harm each other)."""
    n, rivals = 1, width + size - part - 1
    while rivals > 0:
        x = rivals / n
        if (1 - (1 - math.exp(-x)) / x) ** part <= miss:
            break
        n += 1
    return n


def _sketch(shingles: Column, n_bins: int) -> Column:
    """The band values of an array of shingle hashes: per bin that is not
    empty its number and its smallest hash in one long."""
    placed = F.transform(shingles, lambda h: F.shiftleft(F.pmod(h, F.lit(n_bins)), 48).bitwiseOR(F.shiftrightunsigned(h, 16)))
    return F.array(F.array_min(placed)) if n_bins == 1 else _first_of_bin(F.sort_array(placed))


def _first_of_bin(values: Column) -> Column:
    """The first value of each bin of a sorted array."""
    bin_of = lambda v: F.shiftright(v, 48)
    # the array is named by a lambda, so that it is sorted once
    return F.get(F.transform(F.array(values), lambda a: F.filter(a, lambda v, i: F.coalesce(bin_of(v) != bin_of(F.get(a, i - 1)), F.lit(True)))), F.lit(0))


class _Classes:
    """Bins of each size class that the templates (by their numbers of
    shingles) need, and the columns made for it."""

    def __init__(self, sizes: set[int], similarity: float, miss: float) -> None:
        self.bins: dict[int, int] = {}
        for c in sorted({1 << (s - 1).bit_length() for s in sizes}):
            least = min(s for s in sizes if c // 2 < s <= c)
            self.bins[c] = 1 if c == 1 else bins(2 * c, least, math.ceil(similarity * least), miss)
        self.wide = max(self.bins)
        self.run = min((c for c in self.bins if c > 1), default=0)
        self.block = max(BLOCK, 2 * self.wide)

    def blocks(self, rows: DataFrame) -> DataFrame:
        """(doc_id, _r, _from, _skip, _x): blocks start at a multiple of the
        widest class and have ``_skip`` shingles of the block before them."""
        cut = rows.select("doc_id", "_r", "_x", F.explode(F.sequence(F.lit(0), F.size("_x") - 1, F.lit(self.block))).alias("_start"))
        first = F.greatest(F.col("_start") - self.wide, F.lit(0))
        cut = cut.withColumn("_from", first).withColumn("_skip", F.col("_start") - first)
        return settled(cut.withColumn("_x", F.slice("_x", F.col("_from") + 1, F.col("_skip") + self.block + 3 * self.wide)).drop("_start"), "_x")

    def runs(self, blocks: DataFrame) -> DataFrame:
        """Adds ``_m<c>`` per class above one: the block in runs of c shingles.
        Elements are looked up one by one, as a slice would copy the whole
        array; longer runs join two shorter ones."""
        out, c, nothing = blocks, self.run, F.array().cast("array<bigint>")
        while c and c <= self.wide:
            if c == self.run:
                end = F.size("_x")
                made = F.transform(F.sequence(F.lit(0), end - 1, F.lit(c)), lambda a: F.transform(F.sequence(a, F.least(a + c, end) - 1), lambda i: F.get("_x", i)))
            else:
                m = F.col(f"_m{c // 2}")
                made = F.transform(F.sequence(F.lit(0), F.size(m) - 1, F.lit(2)), lambda i: F.concat(F.get(m, i), F.coalesce(F.get(m, i + 1), nothing)))
            out, c = settled(out.withColumn(f"_m{c}", made), f"_m{c}"), 2 * c
        return out

    def windows(self, c: int) -> Column:
        """The band values of the windows of class c that start in the block
        (after ``_skip``), in order."""
        last = F.least(F.size("_x") - 1, F.col("_skip") + self.block - 1)
        if c == 1:
            own = F.slice("_x", F.col("_skip") + 1, F.greatest(last - F.col("_skip") + 1, F.lit(0)))
            return F.transform(own, lambda h: _sketch(F.array(h), 1))
        m, nothing = F.col(f"_m{c}"), F.array().cast("array<bigint>")
        whole = lambda x: F.floor(x / c).cast("int")
        at = F.when(last >= F.col("_skip"), F.sequence(whole(F.col("_skip")), whole(last))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: _sketch(F.concat(F.get(m, i), F.coalesce(F.get(m, i + 1), nothing)), self.bins[c]))


def scan(docs: DataFrame, templates: DataFrame, similarity: float = SIMILARITY, miss: float = MISS, known_limit: int = KNOWN_LIMIT) -> DataFrame:
    """(doc_id, license, template_id, containment, first_word, n_windows): one
    row per document row and template held; first_word counts from 0."""
    spec = _shingled(templates.select("template_id", "license", F.col("template")), "template")
    spec = spec.select("template_id", "license", F.array_distinct("_x").alias("_t")).where(F.size("_t") > 0)
    spec = stash(spec, "license-templates")
    sizes = {r["s"] for r in spec.select(F.size("_t").alias("s")).distinct().collect()}
    if not sizes:
        return spec.crossJoin(texts(docs).select("doc_id").limit(0)).select("doc_id", "license", "template_id", F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("n_windows"))
    classes = _Classes(sizes, similarity, miss)
    asked = None
    for c, n in classes.bins.items():
        of_class = spec.where((F.size("_t") <= c) & (F.size("_t") > c // 2))
        one = of_class.select(F.lit(c).alias("c"), "template_id", F.explode(_sketch(F.col("_t"), n)).alias("value"))
        asked = one if asked is None else asked.unionByName(one)
    asked = stash(asked, "license-bands")
    few = asked.count() <= known_limit
    known = [r["t"] for r in spec.select(F.explode("_t").alias("t")).distinct().limit(known_limit + 1).collect()]

    rows = _shingled(texts(docs), "text").drop("text").where(F.size("_x") > 0).withColumn("_r", F.monotonically_increasing_id())
    cut = classes.blocks(rows)
    if len(known) <= known_limit:
        cut = cut.where(F.exists("_x", lambda h: h.isin(known)))
    kept = stash(cut.select("doc_id", "_r", "_from", "_skip", "_x"), "license-blocks")
    again, found = classes.runs(kept), None
    for c in classes.bins:
        keys = again.select("_r", "_from", "_skip", F.posexplode(classes.windows(c)).alias("i", "w"))
        keys = keys.select("_r", "_from", (F.col("_skip") + F.col("i") * c).alias("_at"), F.lit(c).alias("c"), F.explode("w").alias("value"))
        found = keys if found is None else found.unionByName(keys)
    # the templates' side is counted: only a small one is sent to every task
    hits = found.join(F.broadcast(asked) if few else asked, ["c", "value"]).select("_r", "_from", "_at", "c", "template_id").distinct()
    reach = F.when(F.col("c") > 1, F.col("c")).otherwise(0)
    lo = F.greatest(F.col("_at") - reach, F.lit(0))
    size = F.when(F.col("c") > 1, 2 * F.col("c")).otherwise(1) + 2 * reach
    near = hits.join(kept, ["_r", "_from"]).withColumn("_lo", lo).withColumn("_near", F.slice("_x", F.col("_lo") + 1, size)).drop("_x")
    good = near.join(F.broadcast(spec) if few else spec, "template_id").withColumn("_both", F.array_intersect("_near", "_t")).withColumn("containment", F.size("_both") / F.size("_t"))
    good = good.where(F.col("containment") >= similarity).withColumn("first", F.col("_from") + F.col("_lo") + F.array_position("_near", F.get("_both", F.lit(0))) - 1)
    return good.groupBy("_r", "template_id").agg(
        F.first("doc_id").alias("doc_id"), F.first("license").alias("license"), F.max("containment").alias("containment"),
        F.min("first").cast("long").alias("first_word"), F.countDistinct(F.col("_from") + F.col("_at")).alias("n_windows"),
    ).select("doc_id", "license", "template_id", "containment", "first_word", "n_windows")
