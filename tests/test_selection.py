"""Selection by rank against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.operators import rfm
from vitrine.plans import selection
from vitrine.plans.selection import OrderKey, ntile_bounds, ntile_column, quantile_values, rows_at_ranks


@pytest.fixture(scope="module")
def stored(spark):
    """6,000 rows: a third share one value, some values are null."""
    rng = random.Random(3)
    rows = [(f"key{i * 7919 % 6007:05d}", 7 if i % 3 == 0 else None if i % 50 == 1 else rng.randrange(1000)) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "k string, v long").repartition(7).checkpoint()


@pytest.mark.parametrize("few", [20_000, 300])
def test_rows_at_ranks_are_those_of_a_sort(stored, few):
    rows, df = stored
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    ranks = [1, 2, 17, 1200, 1999, 2000, 2001, 4000, 5999, 6000, 0, 6001]
    got = rows_at_ranks(df, OrderKey([F.col("v"), F.col("k")]), ranks, len(rows), few=few, sample=200)
    assert got == [(want[r - 1][1], want[r - 1][0]) if 1 <= r <= 6000 else None for r in ranks]


@pytest.mark.parametrize("k", [1, 5, 7])
def test_ntile_matches_window(stored, monkeypatch, k):
    monkeypatch.setattr(selection.rows_at_ranks, "__defaults__", (300, 300))
    _, df = stored
    key = OrderKey([-F.col("v"), F.col("k")])
    w = Window.orderBy(key.struct())
    bad = df.select(ntile_column(df, key, k, 6000).alias("a"), F.ntile(k).over(w).alias("b")).where("a <> b")
    assert bad.count() == 0


def test_ntile_of_few_rows(spark):
    for n in range(0, 8):
        df = spark.range(n).withColumn("v", F.lit(1))
        got = [r["t"] for r in df.select("id", ntile_column(df, OrderKey([F.col("v"), F.col("id")]), 5, n).alias("t")).orderBy("id").collect()]
        want = [r["t"] for r in df.select("id", F.ntile(5).over(Window.orderBy("id")).alias("t")).orderBy("id").collect()]
        assert got == want, n
        assert len(ntile_bounds(n, 5)) == 4


def test_quantiles_match_numpy(stored):
    rows, df = stored
    some = df.where("v is not null")
    values = [v for _, v in rows if v is not None]
    probs = (0.0, 0.2, 0.37, 0.5, 0.999, 1.0)
    got = quantile_values(some, OrderKey([F.col("v"), F.col("k")]), probs, len(values))
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-12)


def test_scores_need_no_sort_and_no_rank(tables_small):
    plan = rfm.rfm_scored(tables_small, by_state=False)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Window" not in plan and "Sort" not in plan
