"""Mergeable sketches: approximate distinct counts and quantiles per group
that roll up without reading the detail rows again.

A distinct count or a median over detail rows shuffles every (group, value)
pair. A sketch is a bounded summary per group (HLL: 2^lg_k registers; KLL: a
few times k values), built with partial aggregation, so only sketches cross
the network; kept per month, they are merged for any longer period. HLL's
relative standard error is about 1.04 / sqrt(2^lg_k); a KLL quantile's true
rank is off by about 1.7 / k^0.9 of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14
KLL_K = 400


def hll_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / (2 ** lg_k) ** 0.5


def kll_error(k: int = KLL_K) -> float:
    """Rank error of a quantile, as a share of the rows."""
    return 1.7 / k ** 0.9


def sketch(df: DataFrame, by: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = (),
           lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """One row per group: ``rows``, ``hll_<c>`` for each column of ``distinct``
    and ``kll_<c>`` for each of ``quantiles``. Nulls are left out of both; a
    group without any value has an empty (HLL) or null (KLL) sketch."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    # one type for all keys: the sketch takes whole numbers, strings and bytes
    aggs += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"hll_{c}") for c in distinct]
    aggs += [_kll(F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k)), F.count(c)).alias(f"kll_{c}")
             for c in quantiles]
    return df.groupBy(*by).agg(*aggs)


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Roll sketches up to coarser groups (none: one row for all)."""
    aggs = [F.sum("rows").alias("rows")]
    for c in sketches.columns:
        if c.startswith("hll_"):
            aggs.append(F.hll_union_agg(c).alias(c))
        elif c.startswith("kll_"):
            aggs.append(_kll(F.kll_merge_agg_double(c), F.count(c)).alias(c))
    return sketches.groupBy(*by).agg(*aggs)


def _kll(made: Column, n: Column) -> Column:
    return F.when(n > 0, made)


def distinct_estimate(sketch_col: str) -> Column:
    return F.hll_sketch_estimate(sketch_col)


def quantile_estimate(sketch_col: str, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch_col), F.lit(float(p)))
