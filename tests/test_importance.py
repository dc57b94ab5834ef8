"""Permutation importance in one job, grouped rank sums and PF1 by bounds
against plain loops."""

import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from vitrine.operators.models import permutation_importance
from vitrine.operators.ml import SEED
from vitrine.plans.ranking import rank_sum


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    data = [(i, float(r.randint(0, 9)), float(r.randint(0, 3)), r.randint(0, 5)) for i in range(301)]
    data = [(i, a, b, c, int(a + r.random() * 4 > 6), 3 * a - b + r.random()) for i, a, b, c in data]
    return spark.createDataFrame(data, "id long, a double, b double, c int, y int, z double")


def _auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y != 1]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("metric", ["auc", "mae"])
def test_importance_equals_a_loop_over_features(spark, rows, metric):
    feats = ["a", "b", "c"]
    est = LogisticRegression(labelCol="y") if metric == "auc" else LinearRegression(labelCol="z")
    label = "y" if metric == "auc" else "z"
    model = Pipeline(stages=[VectorAssembler(inputCols=feats, outputCol="features"), est]).fit(rows)
    got = {r.feature: r.importance for r in permutation_importance(model, rows, feats, label, "id", metric).collect()}

    order = [r for r in rows.orderBy(F.xxhash64("id", F.lit(SEED)), "id").collect()]
    n = len(order)

    def score(swap):
        new = []
        for r, row in enumerate(order):
            d = row.asDict()
            if swap:
                # row r + n/2 takes the value of row r
                d[swap] = order[(r - n // 2) % n][swap]
            new.append(tuple(d[c] for c in rows.columns))
        out = model.transform(spark.createDataFrame(new, rows.schema)).collect()
        if metric == "auc":
            return _auc([(o.y, o.probability[1]) for o in out])
        return sum(abs(o.z - max(o.prediction, 0.0)) for o in out) / n

    base = score(None)
    assert set(got) == set(feats)
    for f in feats:
        want = base - score(f) if metric == "auc" else score(f) - base
        assert got[f] == pytest.approx(want, abs=1e-9), f


def test_rank_sum_per_group(spark):
    r = random.Random(9)
    data = [(i, "ab"[i % 3 == 0], r.randint(0, 6), r.randint(0, 1)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, g string, x int, y int")
    got = {r.g: r for r in rank_sum(df, "x", F.col("y") == 1, ["id"], by=["g"]).collect()}
    for g in "ab":
        one = rank_sum(df.where(F.col("g") == g), "x", F.col("y") == 1, ["id"]).first()
        assert (got[g].rank_sum, got[g].n1, got[g].n2, got[g].tie_term) == (one.rank_sum, one.n1, one.n2, one.tie_term)
        vals = sorted(x for _, k, x, _ in data if k == g)
        mean_rank = {x: vals.index(x) + (vals.count(x) + 1) / 2 for x in set(vals)}
        assert one.rank_sum == pytest.approx(sum(mean_rank[x] for _, k, x, y in data if k == g and y == 1))


@pytest.mark.parametrize("top", [1, 2, 50])
def test_item_profit_by_bounds(spark, top, monkeypatch):
    """Best lines in canceled orders, ties at the bound, a hot order: the same
    rows as without pruning."""
    from dataclasses import replace
    from decimal import Decimal as M

    from test_edges import tiny
    from vitrine.operators import profit

    t = tiny(spark)
    items = ([(3, i, 10, 1, M("900.00"), M("1.00")) for i in range(30)]      # canceled: the best bounds
             + [(1, i, 10, 1, M("80.00"), M("4.00")) for i in range(400)]    # hot order, all tied
             + [(2, i, 12, 2, M(f"{i % 90}.50"), M("3.00")) for i in range(300)])
    t = replace(t, items=spark.createDataFrame(items, t.items.schema))
    got = [tuple(r) for r in profit.order_item_profit(t, top=top).collect()]
    monkeypatch.setattr(profit, "PRUNE_LIMIT", 0)
    want = [tuple(r) for r in profit.order_item_profit(t, top=top).collect()]
    assert len(got) == top and sorted(got, key=str) == sorted(want, key=str)
