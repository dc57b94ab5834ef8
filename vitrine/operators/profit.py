"""Profit operators (PF1-PF19) under the three cost models of
``functions.costs``.

Item models (A, B) over items ⟕ reviews: the review fan-out is replayed from
per-order review statistics (``n_rev`` copies of each item row, ``n_low`` of
them discounted), so a hot order never multiplies rows. Model C works on one
row per delivered, paid order (``order_profit_frame``); items and payments are
rolled up per order before any join.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import DEFAULT_EXCLUDED, CostModel, active_status, pct, rnd
from vitrine.operators.prepare import (
    category_lines,
    fanout,
    items_per_order,
    items_with_category,
    order_lines,
    orders_enriched,
    payments_per_order,
    review_stats,
)
from vitrine.sources.tables import RetailTables

QUERIES = ("order_item_profit", "category_profit", "state_profit", "payment_profit", "monthly_profit",
           "month_category_profit", "geo_profit", "order_profit_master", "platform_profit_summary",
           "category_profit_ranks", "category_margin_flags", "state_profit_ab", "ab_profit_comparison",
           "payment_type_profit", "voucher_margin_gap", "free_shipping_impact", "threshold_sweep",
           "breakeven_order_value", "profit_histogram")

COST = CostModel()

# The workload's region split (customer states); the test data stands in
# nations for states, see ``TEST_GROUPS``.
CONTROL_STATES = ("SP", "RJ", "MG", "ES")
TREATMENT_STATES = ("PR", "SC", "RS")
TEST_GROUPS = {"control": tuple(f"NATION_{i}" for i in range(4)),
               "treatment": tuple(f"NATION_{i}" for i in range(4, 7))}

def _zero():
    return F.lit(Decimal("0"))


# --------------------------------------------------------------- item models
def _reviewed(lines: DataFrame, t: RetailTables, order_filter: Column | None, with_state: bool) -> DataFrame:
    """``lines`` with their order's columns, review statistics and review
    multiplicity ``m``; the customer joins the order, not its lines."""
    o = orders_enriched(t)
    if order_filter is not None:
        o = o.where(order_filter)
    o = o.select("order_id", "customer_id", "order_month", "delivery_delay_days")
    if with_state:
        o = o.join(t.customers.select("customer_id", "customer_state"), "customer_id")
    return (lines.join(o, "order_id").join(review_stats(t.reviews), "order_id", "left")
            .withColumn("m", fanout()).withColumn("n_low", F.coalesce("n_low", F.lit(0))))


def line_totals(t: RetailTables, order_filter: Column | None, cost: CostModel = COST,
                with_category: bool = False, with_state: bool = False) -> DataFrame:
    """One row per order (and category) with sums over its raw
    ``items ⟕ reviews`` rows: ``w`` rows, revenue ``price * m`` etc.;
    ``disc_w`` is the discount summed over the ``n_low`` low-review copies.
    Items are rolled up before the joins: both item models are linear in
    price and freight."""
    lines = category_lines(t) if with_category else order_lines(t)
    rows = _reviewed(lines, t, order_filter, with_state)
    m, n = F.col("m"), F.col("n")
    return rows.select(
        "*",
        (m * n).alias("w"),
        (F.col("price") * m).alias("rev_w"),
        (cost.item_shipping() * m).alias("ship_w"),
        (F.col("price") * cost.lit("discount_rate") * F.col("n_low")).alias("disc_w"),
        (F.coalesce(F.col("sum_score"), F.lit(0)) * n).alias("score_w"),
        (F.coalesce(F.col("n_scored"), F.lit(0)) * n).alias("scored_w"),
    )


def _model_a(keys: list, rows: DataFrame, cost: CostModel = COST, extra: dict | None = None) -> DataFrame:
    """Model A aggregates per ``keys``: sums over the fan-out, operating cost
    per distinct order. Two stages: (keys, order) then keys."""
    extra = extra or {}
    per_order = rows.groupBy(*keys, "order_id").agg(
        F.sum("rev_w").alias("rev"), F.sum("ship_w").alias("ship"), F.sum("disc_w").alias("disc"),
        F.sum("score_w").alias("score"), F.sum("scored_w").alias("scored"),
        F.sum("w").alias("w"), F.max("delivery_delay_days").alias("delay"),
        *[v.alias(k) for k, v in extra.items()])
    agg = per_order.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("rev").alias("_rev"), F.sum("ship").alias("_ship"), F.sum("disc").alias("_disc"),
        (F.sum("score") / F.sum("scored")).alias("_review"),
        (F.sum(F.col("delay") * F.col("w")) / F.sum(F.when(F.col("delay").isNotNull(), F.col("w"))))
        .alias("_delay"))
    op = F.col("total_orders") * cost.lit("operational_cost")
    profit = F.col("_rev") - F.col("_ship") - F.col("_disc") - op
    return agg.withColumn("_op", op).withColumn("_profit", profit)


# Beyond this many bounds looked at (nearly all good lines belong to inactive
# orders) PF1 joins all lines.
PRUNE_LIMIT = 100_000


def _item_variants(lines: DataFrame, t: RetailTables, excluded, cost: CostModel) -> DataFrame:
    """The discounted and the undiscounted row of each line with its profit
    (model B) and its number of copies ``_k``."""
    rows = _reviewed(lines, t, active_status(excluded=excluded), with_state=True)
    variants = F.array(
        F.struct(F.lit(True).alias("low"), F.col("n_low").alias("k")),
        F.struct(F.lit(False).alias("low"), (F.col("m") - F.col("n_low")).alias("k")))
    v = (rows.select("order_id", "customer_state", "category", "price", "freight_value",
                     F.explode(variants).alias("_v"))
         .where(F.col("_v.k") > 0))
    disc = F.when(F.col("_v.low"), F.col("price") * cost.lit("discount_rate")).otherwise(_zero())
    ship = cost.item_shipping()
    profit = F.col("price") - ship - disc - cost.lit("operational_cost")
    return v.select(
        "order_id", "customer_state", "category", F.col("price").alias("revenue"),
        F.col("freight_value").alias("actual_freight"), ship.alias("_ship"), disc.alias("_disc"),
        profit.alias("_profit"), F.col("_v.k").alias("_k"))


def order_item_profit(t: RetailTables, excluded=DEFAULT_EXCLUDED, top: int = 100,
                      cost: CostModel = COST) -> DataFrame:
    """PF1: per joined item row (model B): costs, profit, margin; top by profit.

    Each item yields at most two distinct rows (discounted or not) carrying
    their multiplicities; only the ``top`` best distinct rows are expanded to
    their copies, so the output is exact without materialising the fan-out.

    Lines are pruned by a bound before the joins. No row of a line earns more
    than its price less shipping and operating cost; ``floor`` is the k-th
    best of these bounds. A line below it can't beat ``top`` joined rows at or
    above it, so once there are that many the rest never meets a join.
    """
    best = F.col("price") - cost.item_shipping() - cost.lit("operational_cost")
    take = 4 * top
    while True:
        floor, seen = (t.items.select(best.alias("_b")).orderBy(F.desc("_b")).limit(take)
                       .agg(F.min("_b"), F.count(F.lit(1))).first())
        if seen < take or take > PRUNE_LIMIT:
            shaped = _item_variants(items_with_category(t), t, excluded, cost)
            break
        shaped = _item_variants(items_with_category(t).where(best >= F.lit(floor)), t, excluded, cost)
        enough = shaped.where(F.col("_profit") >= F.lit(floor)).agg(F.sum("_k")).first()[0]
        if enough is not None and enough >= top:
            break
        take *= 4
    order = [F.desc("_profit"), "order_id", F.desc("revenue"), "_disc", "actual_freight",
             F.asc_nulls_first("category"), "customer_state"]
    best = shaped.orderBy(*order).limit(top)
    copies = best.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.least(F.col("_k"), F.lit(top)))))
    out = copies.orderBy(*order).limit(top)
    return out.select(
        "order_id", "customer_state", "category", F.col("revenue").cast("double").alias("revenue"),
        F.col("actual_freight").cast("double").alias("actual_freight"),
        rnd("_ship", 2).alias("shipping_cost"), rnd("_disc", 2).alias("discount_cost"),
        cost.lit("operational_cost").cast("double").alias("operational_cost"),
        rnd("_profit", 2).alias("profit"), pct("_profit", "revenue", 1).alias("profit_margin_pct"))


def category_profit(t: RetailTables, excluded=DEFAULT_EXCLUDED, min_orders: int = 100,
                    cost: CostModel = COST) -> DataFrame:
    """PF2: model A by category, categories with more than ``min_orders``."""
    a = _model_a(["category"], line_totals(t, active_status(excluded=excluded), cost, with_category=True), cost)
    a = a.where(F.col("total_orders") > min_orders)
    return a.select(
        "category", "total_orders", rnd("_rev", 2).alias("total_revenue"),
        rnd("_ship", 2).alias("total_shipping_cost"), rnd("_disc", 2).alias("total_discount_cost"),
        rnd("_op", 2).alias("total_operational_cost"), rnd("_profit", 2).alias("total_profit"),
        pct("_profit", "_rev").alias("profit_margin_pct"), rnd("_review", 2).alias("avg_review_score"))


def state_profit(t: RetailTables, excluded=DEFAULT_EXCLUDED, cost: CostModel = COST) -> DataFrame:
    """PF3: model A by customer state, with the average delay."""
    a = _model_a(["customer_state"], line_totals(t, active_status(excluded=excluded), cost, with_state=True), cost)
    return a.select("customer_state", "total_orders", rnd("_rev", 2).alias("total_revenue"),
                    rnd("_profit", 2).alias("total_profit"), pct("_profit", "_rev").alias("profit_margin_pct"),
                    rnd("_delay", 2).alias("avg_delay_days"))


def payment_profit(t: RetailTables, excluded=DEFAULT_EXCLUDED, min_orders: int = 50,
                   cost: CostModel = COST) -> DataFrame:
    """PF4: model A by (first payment type, installments)."""
    first = t.payments.where(F.col("payment_sequential") == 1).select(
        "order_id", "payment_type", "payment_installments")
    rows = line_totals(t, active_status(excluded=excluded), cost).join(first, "order_id")
    a = _model_a(["payment_type", "payment_installments"], rows, cost).where(F.col("total_orders") > min_orders)
    return a.select("payment_type", "payment_installments", "total_orders",
                    rnd("_rev", 2).alias("total_revenue"), rnd("_profit", 2).alias("total_profit"),
                    pct("_profit", "_rev").alias("profit_margin_pct"))


def monthly_profit(t: RetailTables, excluded=None, cost: CostModel = COST) -> DataFrame:
    """PF5: model A by purchase month; no status filter unless given."""
    flt = None if excluded is None else active_status(excluded=excluded)
    a = _model_a(["order_month"], line_totals(t, flt, cost), cost)
    return a.select(F.col("order_month").alias("month"), "total_orders",
                    rnd("_rev", 2).alias("total_revenue"), rnd("_profit", 2).alias("total_profit"),
                    pct("_profit", "_rev").alias("profit_margin_pct"))


def _model_b(keys: list, rows: DataFrame, cost: CostModel = COST) -> DataFrame:
    """Model B: the operating cost is charged on every joined row."""
    return rows.groupBy(*keys).agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("rev_w").alias("_rev"),
        (F.sum("rev_w") - F.sum("ship_w") - F.sum("disc_w")
         - F.sum("w") * cost.lit("operational_cost")).alias("_profit"))


def month_category_profit(t: RetailTables, excluded=DEFAULT_EXCLUDED, cost: CostModel = COST) -> DataFrame:
    """PF6: model B by (month, category); revenue unrounded, profit rounded."""
    rows = line_totals(t, active_status(excluded=excluded), cost, with_category=True)
    b = _model_b(["order_month", "category"], rows, cost)
    return b.select(F.col("order_month").alias("month"), "category",
                    F.col("_rev").cast("double").alias("total_revenue"),
                    rnd("_profit", 2).alias("total_profit"))


def geo_profit(t: RetailTables, excluded=DEFAULT_EXCLUDED, cost: CostModel = COST) -> DataFrame:
    """PF7: model B by customer state."""
    rows = line_totals(t, active_status(excluded=excluded), cost, with_state=True)
    b = _model_b(["customer_state"], rows, cost)
    return b.select("customer_state", "total_orders", rnd("_rev", 2).alias("total_revenue"),
                    rnd("_profit", 2).alias("total_profit"), pct("_profit", "_rev").alias("profit_margin_pct"))


# ----------------------------------------------------------- order model (C)
def order_profit_frame(t: RetailTables, cost: CostModel = COST) -> DataFrame:
    """Delivered, paid orders with model-C costs (unrounded, DECIMAL)."""
    prod = (t.products.select("product_id", "product_category_name")
            .join(t.translation, "product_category_name", "left"))
    df = (t.orders.select("order_id", "customer_id", "order_status", "order_purchase_timestamp")
          .join(payments_per_order(t.payments), "order_id", "left")
          .join(items_per_order(t.items), "order_id", "left")
          .join(t.customers, "customer_id", "left")
          .join(prod, "product_id", "left"))
    df = df.where((F.col("order_status") == "delivered") & (F.col("payment_value") > 0))
    ship = cost.order_shipping()
    disc = cost.order_discount()
    total = ship + disc + cost.lit("operational_cost")
    return df.select(
        "*", ship.alias("shipping_cost"), disc.alias("discount_cost"),
        cost.lit("operational_cost").alias("operational_cost"), total.alias("total_cost"),
        (F.col("payment_value") - total).alias("profit_per_order"),
        ((F.col("payment_value") - total).cast("double") / F.col("payment_value").cast("double") * 100)
        .alias("profit_margin_pct"))


def order_profit_master(t: RetailTables) -> DataFrame:
    """PF8: the model-C order table (one row per delivered, paid order)."""
    df = order_profit_frame(t)
    return df.select(
        "order_id", "customer_unique_id", "customer_state",
        F.col("product_category_name_english").alias("category"), "payment_type", "voucher_used",
        "item_count", rnd("payment_value", 2).alias("payment_value"), rnd("price", 2).alias("price"),
        rnd("shipping_cost", 4).alias("shipping_cost"), rnd("discount_cost", 4).alias("discount_cost"),
        rnd("total_cost", 4).alias("total_cost"), rnd("profit_per_order", 4).alias("profit_per_order"),
        rnd("profit_margin_pct", 4).alias("profit_margin_pct"))


def platform_profit_summary(t: RetailTables) -> DataFrame:
    """PF9: platform totals, averages and the unprofitable share."""
    p = F.col("profit_per_order")
    return order_profit_frame(t).agg(
        F.count(F.lit(1)).alias("total_orders"),
        rnd(F.sum("payment_value"), 2).alias("total_revenue"),
        rnd(F.sum("shipping_cost"), 2).alias("total_shipping_cost"),
        rnd(F.sum("discount_cost"), 2).alias("total_discount_cost"),
        rnd(F.sum("operational_cost"), 2).alias("total_operational_cost"),
        rnd(F.sum("total_cost"), 2).alias("total_cost"),
        rnd(F.sum(p), 2).alias("total_profit"),
        rnd(F.avg(p), 2).alias("avg_profit_per_order"),
        rnd(F.avg("profit_margin_pct"), 1).alias("avg_margin_pct"),
        F.count_if(p < 0).alias("unprofitable_orders"),
        rnd(F.avg((p < 0).cast("int")) * 100, 1).alias("unprofitable_pct"))


def _category_measures(t: RetailTables) -> DataFrame:
    df = order_profit_frame(t).where(F.col("product_category_name_english").isNotNull())
    return df.groupBy(F.col("product_category_name_english").alias("category")).agg(
        F.count("order_id").alias("orders"),
        F.sum("payment_value").alias("_rev"), F.sum("profit_per_order").alias("_profit"),
        F.avg("profit_per_order").alias("_avg_profit"), F.avg("profit_margin_pct").alias("_avg_margin"),
        F.avg("payment_value").alias("_aov"))


def _avg_rank_desc(col: str) -> Column:
    """pandas ``rank(ascending=False)`` (average method) truncated to int.

    The window runs over one row per category (bounded by the catalogue, not
    the data): rows above + (rows tied + 1) / 2.
    """
    w_all = Window.partitionBy(F.lit(1))
    above = F.count(F.lit(1)).over(w_all.orderBy(F.desc(col)).rangeBetween(Window.unboundedPreceding, 0))
    tied = F.count(F.lit(1)).over(Window.partitionBy(col))
    return F.floor(above - tied + (tied + 1) / 2).cast("int")


def category_profit_ranks(t: RetailTables, top: int = 15) -> DataFrame:
    """PF10: category measures, revenue and profit ranks and their delta."""
    c = _category_measures(t)
    c = c.withColumn("revenue_rank", _avg_rank_desc("_rev")).withColumn("profit_rank", _avg_rank_desc("_profit"))
    c = c.orderBy(F.desc("_profit"), "category").limit(top)
    return c.select("category", "orders", rnd("_rev", 2).alias("revenue"), rnd("_profit", 2).alias("total_profit"),
                    rnd("_avg_profit", 2).alias("avg_profit_per_order"), rnd("_avg_margin", 2).alias("avg_margin_pct"),
                    rnd("_aov", 2).alias("avg_aov"), "revenue_rank", "profit_rank",
                    (F.col("revenue_rank") - F.col("profit_rank")).alias("rank_delta"))


def category_margin_flags(t: RetailTables) -> DataFrame:
    """PF11: each category's average margin against the median over categories.
    The measures (one row per category) are stored once and read twice."""
    from vitrine.plans.ranking import checkpoint

    c = checkpoint(_category_measures(t))
    med = c.agg(F.median("_avg_margin").alias("_med"))
    return c.crossJoin(F.broadcast(med)).select(
        "category", rnd("_avg_margin", 4).alias("avg_margin_pct"), rnd("_med", 4).alias("median_margin_pct"),
        (F.col("_avg_margin") >= F.col("_med")).alias("above_median"))


def group_label(state: Column, control=CONTROL_STATES, treatment=TREATMENT_STATES) -> Column:
    """SF17: state -> test-group label."""
    return (F.when(state.isin(*control), "Control").when(state.isin(*treatment), "Treatment")
            .otherwise("Other"))


def state_profit_ab(t: RetailTables, control=TEST_GROUPS["control"],
                    treatment=TEST_GROUPS["treatment"]) -> DataFrame:
    """PF12: model-C measures per state with the test-group label."""
    df = order_profit_frame(t).where(F.col("customer_state").isNotNull())
    g = df.groupBy("customer_state").agg(
        F.count("order_id").alias("order_count"), F.sum("payment_value").alias("_rev"),
        F.sum("profit_per_order").alias("_profit"), F.avg("profit_margin_pct").alias("_margin"),
        F.avg("shipping_cost").alias("_ship"), F.avg("payment_value").alias("_aov"))
    return g.select("customer_state", "order_count", rnd("_rev", 2).alias("total_revenue"),
                    rnd("_profit", 2).alias("total_profit"), rnd("_margin", 2).alias("avg_margin_pct"),
                    rnd("_ship", 2).alias("avg_shipping"), rnd("_aov", 2).alias("avg_aov"),
                    group_label(F.col("customer_state"), control, treatment).alias("ab_group"))


def _grouped(t: RetailTables, control, treatment) -> DataFrame:
    return (order_profit_frame(t)
            .withColumn("ab_group", group_label(F.col("customer_state"), control, treatment))
            .where(F.col("ab_group") != "Other"))


def ab_profit_comparison(t: RetailTables, control=TEST_GROUPS["control"],
                         treatment=TEST_GROUPS["treatment"]) -> DataFrame:
    """PF13: AOV, shipping, profit, margin and unprofitable share per group."""
    p = F.col("profit_per_order")
    return _grouped(t, control, treatment).groupBy("ab_group").agg(
        F.count(F.lit(1)).alias("orders"),
        rnd(F.avg("payment_value"), 2).alias("avg_aov"), rnd(F.avg("shipping_cost"), 2).alias("avg_shipping_cost"),
        rnd(F.avg(p), 2).alias("avg_profit_per_order"), rnd(F.avg("profit_margin_pct"), 1).alias("avg_margin_pct"),
        rnd(F.avg((p < 0).cast("int")) * 100, 1).alias("unprofitable_pct"))


def payment_type_profit(t: RetailTables) -> DataFrame:
    """PF14: model-C measures by (first) payment type."""
    g = order_profit_frame(t).groupBy("payment_type").agg(
        F.count("order_id").alias("orders"), F.avg("payment_value").alias("_aov"),
        F.avg("discount_cost").alias("_disc"), F.avg("profit_per_order").alias("_profit"),
        F.avg("profit_margin_pct").alias("_margin"))
    return g.select("payment_type", "orders", rnd("_aov", 2).alias("avg_aov"), rnd("_disc", 2).alias("avg_discount"),
                    rnd("_profit", 2).alias("avg_profit"), rnd("_margin", 2).alias("avg_margin_pct"))


def voucher_margin_gap(t: RetailTables) -> DataFrame:
    """PF15: average margin with and without a voucher, and the gap."""
    m, v = F.col("profit_margin_pct"), F.col("voucher_used")
    a = order_profit_frame(t).agg(F.avg(F.when(v, m)).alias("_with"), F.avg(F.when(~v, m)).alias("_without"))
    return a.select(rnd("_with", 1).alias("voucher_margin_pct"), rnd("_without", 1).alias("no_voucher_margin_pct"),
                    rnd(F.col("_without") - F.col("_with"), 1).alias("margin_gap_pp"))


def _impact(t: RetailTables, control, treatment, threshold) -> DataFrame:
    g = _grouped(t, control, treatment)
    ctl, trt = F.col("ab_group") == "Control", F.col("ab_group") == "Treatment"
    pay = F.col("payment_value")
    return g.agg(
        F.avg(F.when(ctl, pay)).alias("_c_aov"), F.avg(F.when(trt, pay)).alias("_t_aov"),
        F.avg(F.when(trt & (pay >= threshold), F.col("shipping_cost"))).alias("_absorbed"),
        F.avg(F.when(trt & (pay < threshold), F.col("shipping_cost"))).alias("_non_qual"),
        F.avg(F.when(ctl, F.col("profit_per_order"))).alias("_c_profit"),
        F.avg(F.when(trt, F.col("profit_per_order"))).alias("_t_profit"),
        F.avg(F.when(ctl, F.col("profit_margin_pct"))).alias("_c_margin"),
        F.avg(F.when(trt, F.col("profit_margin_pct"))).alias("_t_margin"))


def free_shipping_impact(t: RetailTables, control=TEST_GROUPS["control"], treatment=TEST_GROUPS["treatment"],
                         threshold: int = 150) -> DataFrame:
    """PF16: AOV lift, shipping absorbed on qualifying treatment orders,
    profit and margin lift, and the verdict (one row)."""
    a = _impact(t, control, treatment, threshold)
    lift = F.col("_t_profit") - F.col("_c_profit")
    return a.select(
        rnd(F.col("_t_aov") - F.col("_c_aov"), 2).alias("aov_lift"),
        rnd("_absorbed", 2).alias("shipping_absorbed"), rnd("_non_qual", 2).alias("shipping_non_qualifying"),
        rnd("_c_profit", 2).alias("control_profit"), rnd("_t_profit", 2).alias("treatment_profit"),
        rnd(lift, 2).alias("net_profit_lift"),
        rnd("_c_margin", 1).alias("control_margin_pct"), rnd("_t_margin", 1).alias("treatment_margin_pct"),
        rnd(F.col("_t_margin") - F.col("_c_margin"), 1).alias("margin_change_pp"),
        F.when(lift > 0, "net_positive").otherwise("net_negative").alias("verdict"))


def threshold_sweep(t: RetailTables, treatment=TEST_GROUPS["treatment"],
                    thresholds=(150, 175, 200, 250), cost: CostModel = COST) -> DataFrame:
    """PF17: per free-shipping threshold: share of treatment orders that
    qualify and shipping absorbed per qualifying order (0 when none)."""
    trt = order_profit_frame(t).where(F.col("customer_state").isin(*treatment))
    pay = F.col("payment_value")
    # one pass: each threshold is a pair of conditional aggregates
    of = lambda x: F.struct(F.lit(int(x)).alias("threshold"), F.count_if(pay >= x).alias("qualifying_orders"), F.avg(F.when(pay >= x, pay)).alias("_avg_q"))
    g = trt.agg(F.count(F.lit(1)).alias("_n"), F.array(*[of(x) for x in thresholds]).alias("_q")).select("_n", F.explode("_q").alias("q")).select("_n", "q.*").where("_n > 0")
    return g.select("threshold", "qualifying_orders",
                    rnd(F.col("qualifying_orders") * 100.0 / F.col("_n"), 1).alias("pct_qualifying"),
                    rnd(F.coalesce(F.col("_avg_q") * cost.lit("shipping_rate"), _zero()), 2).alias("avg_shipping_absorbed"))


def breakeven_order_value(t: RetailTables, control=TEST_GROUPS["control"],
                          treatment=TEST_GROUPS["treatment"], cost: CostModel = COST) -> DataFrame:
    """PF18: AOV lift / shipping rate, the average qualifying order at which
    free shipping pays for itself."""
    a = _impact(t, control, treatment, 150)
    lift = F.col("_t_aov") - F.col("_c_aov")
    return a.select(rnd(lift, 2).alias("aov_lift"),
                    rnd(lift / cost.lit("shipping_rate"), 2).alias("breakeven_avg_order"))


def equal_width_histogram(df: DataFrame, value: Column, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the min and the max of
    ``value`` (the max falls in the last bin), empty bins with 0. Per-group
    ranges when ``by`` is given; ``by`` has few values: ranges and counts, one
    row per group and per bin, are broadcast, the rows themselves stay put."""
    by = by or []
    v = df.select(*by, value.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    rng = v.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where(F.col("_lo").isNotNull())
    width = F.col("_hi") - F.col("_lo")
    idx = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) * bins / width), F.lit(bins - 1))) \
        .otherwise(F.lit(0)).cast("int")
    placed = v.join(F.broadcast(rng), by) if by else v.crossJoin(F.broadcast(rng))
    counts = placed.groupBy(*by, idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    g = spine.join(F.broadcast(counts), [*by, "bin"], "left")
    return g.select(*by, "bin", rnd(F.col("_lo") + F.col("bin") * width / bins, 4).alias("bin_lo"),
                    rnd(F.col("_lo") + (F.col("bin") + 1) * width / bins, 4).alias("bin_hi"), F.coalesce("n", F.lit(0)).alias("n"))


def profit_histogram(t: RetailTables, lo: int = -50, hi: int = 300, bins: int = 60) -> DataFrame:
    """PF19: profit per order clipped to [lo, hi], 60 equal-width bins."""
    p = F.greatest(F.lit(lo), F.least(F.col("profit_per_order"), F.lit(hi)))
    return equal_width_histogram(order_profit_frame(t), p, bins)
