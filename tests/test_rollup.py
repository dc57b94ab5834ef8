"""Items rolled up before the order joins: a hot order is a few rows there, and
the sums are those of the raw join."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from vitrine.operators.prepare import category_lines, items_with_category
from vitrine.operators.profit import line_totals


@pytest.fixture(scope="module")
def hot(tables_small):
    """A third of all lines belong to one order."""
    t = tables_small
    hot_id = t.items.agg(F.min("order_id")).first()[0]
    third = F.pmod(F.xxhash64("order_id", "order_item_id"), F.lit(3)) == 0
    return replace(t, items=t.items.withColumn("order_id", F.when(third, F.lit(hot_id)).otherwise(F.col("order_id"))))


def test_a_hot_order_is_one_row_per_category(hot):
    lines = category_lines(hot)
    assert lines.groupBy("order_id", "category").count().where("count > 1").isEmpty()
    categories = items_with_category(hot).select("category").distinct().count()
    assert lines.groupBy("order_id").count().agg(F.max("count")).first()[0] <= categories
    assert lines.agg(F.sum("n")).first()[0] == hot.items.join(hot.products, "product_id").count()


def test_totals_equal_the_raw_join(hot):
    raw = (hot.items.join(hot.orders.select("order_id"), "order_id")
           .join(hot.reviews.select("order_id", "review_score"), "order_id", "left"))
    want = raw.agg(F.count(F.lit(1)), F.sum("price"), F.sum("review_score"),
                   F.sum(F.when(F.col("review_score") < 3, F.col("price") * F.lit("0.08").cast("decimal(3,2)")))).first()
    got = line_totals(hot, None).agg(F.sum("w"), F.sum("rev_w"), F.sum("score_w"), F.sum("disc_w")).first()
    assert [float(x) for x in got] == pytest.approx([float(x) for x in want], rel=1e-12)
