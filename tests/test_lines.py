"""Numbers of lines inside their order, whatever the size of the order."""

import random

from vitrine.sources import tables
from vitrine.plans import ranking


def test_large_orders_are_numbered_like_small_ones(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3, 3, 3, 3]), rng.choice([None, 1, 2]), rng.randrange(3), 1, None, 1.5, 2.0) for _ in range(300)]
    li = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double")
    want = []
    for key in (1, 2, 3):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: [(x is not None, x or 0) for x in r[1:]])
        want += [(*r, i) for i, r in enumerate(mine, 1)]
    listed = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert listed(tables.numbered_lines(li)) == sorted(want, key=str)
    assert listed(tables.numbered_lines(li, hot_order=60)) == sorted(want, key=str)


def test_lines_are_not_ranked_globally_without_a_large_order(spark, monkeypatch):
    """The stored, sorted copy of all lines is written for none of them."""
    asked = []
    monkeypatch.setattr(ranking, "global_rank", lambda *a, **k: asked.append(a))
    li = spark.range(100).selectExpr("id div 4 l_orderkey", "cast(id % 4 as int) l_linenumber", "id l_partkey", "id l_suppkey", "timestamp'2020-01-01' l_shipdate", "1.0D l_extendedprice", "1.0D l_quantity")
    assert tables.numbered_lines(li).count() == 100 and not asked
