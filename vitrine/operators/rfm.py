"""RFM operators (RF1-RF7).

Scores are global NTILE(5)s / quantile bins. Only the customers at the bucket
boundaries are looked up (``plans.selection``); every other one is scored by
comparing its (value, key) with theirs, so nothing is sorted. Every ordering
ends in the customer key, so ties are broken the same way in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import DEFAULT_EXCLUDED, active_status, delay_days_floor, rnd
from vitrine.plans.ranking import checkpoint, qcut_bin
from vitrine.plans.selection import OrderKey, above, ntile_column, quantile_values, rows_at_ranks
from vitrine.sources.tables import RetailTables

QUERIES = ("rfm_base", "rfm_scores", "rfm_segments", "rfm_segment_summary", "rfm_segments_short",
           "rfm_qcut_segments", "rfm_profit_summary")


def R():
    return F.col("r_score")


def Fq():
    return F.col("f_score")


def M():
    return F.col("m_score")


# Fixed segment rules of the workload, evaluated in order (first match wins):
# (label, recommended strategy, condition).
SEGMENTS_8 = [
    ("Champions", "VIP loyalty program + early access to new products",
     "r_score >= 4 AND f_score >= 4 AND m_score >= 4"),
    ("Loyal Customers", "Points & cashback rewards, upsell premium categories", "r_score >= 3 AND f_score >= 3"),
    ("New Customers", "Onboarding email series + free shipping on 2nd order", "r_score >= 4 AND f_score <= 2"),
    ("At Risk", "Win-back campaign: 15% discount + personalised recommendation", "r_score <= 2 AND f_score >= 4"),
    ("Cant Lose Them", "Urgent re-engagement: big discount + remind of past purchases",
     "r_score <= 2 AND f_score >= 3"),
    ("Lost", "Survey + 30% off voucher, otherwise write off", "r_score <= 1 AND f_score <= 2"),
    ("Potential Loyalists", "Nurture with curated content + 2nd purchase incentive", "r_score >= 3 AND f_score <= 2"),
]
SEGMENT_8_DEFAULT = ("Needs Attention", "Flash sale offer + review request email")

SEGMENTS_5 = [
    ("Champions", "r_score >= 4 AND f_score >= 4 AND m_score >= 4"),
    ("Loyal Customers", "r_score >= 3 AND f_score >= 3"),
    ("New Customers", "r_score >= 4 AND f_score <= 2"),
    ("At Risk", "r_score <= 2 AND f_score >= 4"),
]
SEGMENT_5_DEFAULT = "Needs Attention"

SEGMENTS_QCUT = [
    ("Champions", "r_score >= 4 AND f_score >= 4"),
    ("Loyal Customers", "r_score >= 3 AND f_score >= 3"),
    ("Recent Customers", "r_score >= 4 AND f_score <= 2"),
    ("At Risk (High Value)", "r_score <= 2 AND m_score >= 4"),
    ("Lost (Low Value)", "r_score <= 2 AND m_score <= 2"),
]
SEGMENT_QCUT_DEFAULT = "Potential Loyalists"


def first_match(rules, default) -> Column:
    """Ordered CASE: the first rule whose condition (SQL predicate) holds
    gives the value."""
    expr = F.lit(default)
    for value, cond in reversed(rules):
        expr = F.when(F.expr(cond), F.lit(value)).otherwise(expr)
    return expr


def _keys(by_state: bool) -> list[str]:
    return ["customer_unique_id", "customer_state"] if by_state else ["customer_unique_id"]


def rfm_metrics(t: RetailTables, by_state: bool = True, excluded=None) -> DataFrame:
    """Recency (calendar days to the latest purchase of *all* orders),
    frequency (distinct orders) and monetary value (item prices) per customer.

    Items are summed per order before joining orders and customers; the
    reference date is a 1-row aggregate, broadcast.
    """
    ref = t.orders.agg(F.max("order_purchase_timestamp").alias("_max_date"))
    o = t.orders if excluded is None else t.orders.where(active_status(excluded=excluded))
    per_order = t.items.groupBy("order_id").agg(F.sum("price").alias("_price"))
    rows = (o.select("order_id", "customer_id", "order_purchase_timestamp")
            .join(per_order, "order_id")
            .join(t.customers, "customer_id"))
    keys = _keys(by_state)
    agg = rows.groupBy(*keys).agg(
        F.max("order_purchase_timestamp").alias("_last"),
        F.count(F.lit(1)).alias("frequency"),
        F.round(F.sum("_price"), 2).alias("monetary_value"))
    return agg.crossJoin(F.broadcast(ref)).select(
        *keys,
        F.datediff(F.to_date("_max_date"), F.to_date("_last")).alias("recency_days"),
        "frequency", "monetary_value")


def rfm_scored(t: RetailTables, by_state: bool = True, excluded=None) -> DataFrame:
    """RF metrics plus NTILE(5) scores: recency descending, frequency and
    monetary ascending, customer key as tie-break."""
    keys = [F.col(k) for k in _keys(by_state)]
    base = checkpoint(rfm_metrics(t, by_state, excluded))
    n = base.count()
    order = {"r_score": -F.col("recency_days"), "f_score": F.col("frequency"), "m_score": F.col("monetary_value")}
    return base.withColumns({name: ntile_column(base, OrderKey([value, *keys]), 5, n) for name, value in order.items()})


def _out(df: DataFrame, by_state: bool, extra=()) -> DataFrame:
    return df.select(*_keys(by_state), "recency_days", "frequency",
                     F.col("monetary_value").cast("double").alias("monetary_value"), *extra)


def rfm_base(t: RetailTables, top: int = 20) -> DataFrame:
    """RF1: per (customer, state), no status filter; the ``top`` by money."""
    b = rfm_metrics(t, by_state=True)
    return _out(b.orderBy(F.desc("monetary_value"), "customer_unique_id", "customer_state").limit(top), True)


def rfm_scores(t: RetailTables, top: int = 50) -> DataFrame:
    """RF2: scores and the 'r-f-m' string; the ``top`` by m, f, r."""
    s = rfm_scored(t, by_state=True)
    s = s.withColumn("rfm_score", F.concat_ws("-", R(), Fq(), M()))
    s = s.orderBy(M().desc(), Fq().desc(), R().desc(), "customer_unique_id", "customer_state").limit(top)
    return _out(s, True, ("r_score", "f_score", "m_score", "rfm_score"))


def rfm_segments(t: RetailTables, excluded=DEFAULT_EXCLUDED) -> DataFrame:
    """RF3: every (customer, state) with its 8-way segment and strategy."""
    s = rfm_scored(t, by_state=True, excluded=excluded)
    return _out(s, True, ("r_score", "f_score", "m_score",
                          first_match([(a, c) for a, _, c in SEGMENTS_8], SEGMENT_8_DEFAULT[0]).alias("segment"),
                          first_match([(b, c) for _, b, c in SEGMENTS_8], SEGMENT_8_DEFAULT[1])
                          .alias("recommended_strategy")))


def rfm_segment_summary(t: RetailTables, excluded=DEFAULT_EXCLUDED) -> DataFrame:
    """RF4: per segment (customers grouped without state): count, share,
    average recency/frequency/money and revenue."""
    s = rfm_scored(t, by_state=False, excluded=excluded).withColumn(
        "segment", first_match([(a, c) for a, _, c in SEGMENTS_8], SEGMENT_8_DEFAULT[0]))
    g = s.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg("recency_days").alias("_r"), F.avg("frequency").alias("_f"),
        F.avg("monetary_value").alias("_m"), F.sum("monetary_value").alias("_t"))
    total = s.agg(F.count(F.lit(1)).alias("_all"))
    return g.crossJoin(F.broadcast(total)).select(
        "segment", "customer_count",
        rnd(F.col("customer_count") * 100.0 / F.col("_all"), 1).alias("pct_of_customers"),
        rnd("_r", 0).alias("avg_recency_days"), rnd("_f", 1).alias("avg_frequency"),
        rnd("_m", 2).alias("avg_monetary"), rnd("_t", 2).alias("total_revenue"))


def rfm_segments_short(t: RetailTables, excluded=DEFAULT_EXCLUDED) -> DataFrame:
    """RF5: the 5-label variant over customers (no state)."""
    s = rfm_scored(t, by_state=False, excluded=excluded)
    return _out(s, False, ("r_score", "f_score", "m_score",
                           first_match(SEGMENTS_5, SEGMENT_5_DEFAULT).alias("segment")))


def rfm_qcut(master: DataFrame) -> DataFrame:
    """RF6 core: quantile-edge scores over the delivered, paid order frame.

    Recency = whole days to (latest purchase + 1 day); frequency = orders;
    monetary = payments; R and M are qcut into 5 bins on linearly
    interpolated edges (R labels reversed); F is qcut on the row number by
    (frequency, customer), rank(method='first'), so its edges are
    1 + (n-1)·p and a row lies above an edge if it comes after the row of
    that rank, rounded down.
    """
    snap = master.agg((F.max("order_purchase_timestamp") + F.expr("INTERVAL 1 DAY")).alias("_snap"))
    cust = (master.groupBy("customer_unique_id").agg(
        F.max("order_purchase_timestamp").alias("_last"),
        F.count("order_id").alias("frequency"),
        F.sum("payment_value").alias("monetary"),
        F.sum("profit_per_order").alias("total_profit"))
        .crossJoin(F.broadcast(snap))
        .withColumn("recency", delay_days_floor("_snap", "_last"))
        .drop("_snap", "_last"))
    cust = checkpoint(cust)
    probs, n = (0.2, 0.4, 0.6, 0.8), cust.count()
    key = lambda name: OrderKey([F.col(name), F.col("customer_unique_id")])
    edges = {name: F.array(*[F.lit(e) for e in quantile_values(cust, key(name), probs, n)]) if n else F.array().cast("array<double>")
             for name in ("recency", "monetary")}
    by_count = key("frequency")
    first = rows_at_ranks(cust, by_count, [int((n - 1) * p + 1) for p in probs], n)
    return cust.select("customer_unique_id", "recency", "frequency", "monetary", "total_profit",
                       (5 - qcut_bin(F.col("recency").cast("double"), edges["recency"])).alias("r_score"),
                       (1 + above(by_count, first)).cast("int").alias("f_score"),
                       (1 + qcut_bin(F.col("monetary").cast("double"), edges["monetary"])).alias("m_score"))


def rfm_qcut_segments(t: RetailTables) -> DataFrame:
    """RF6: quantile scores, 'rfm' digits and the 6-way segment, with profit."""
    from vitrine.operators.profit import order_profit_frame

    s = rfm_qcut(order_profit_frame(t))
    return s.select(
        "customer_unique_id", "recency", "frequency",
        rnd("monetary", 2).alias("monetary"), rnd("total_profit", 2).alias("total_profit"),
        "r_score", "f_score", "m_score", F.concat(R(), Fq(), M()).alias("rfm_score"),
        first_match(SEGMENTS_QCUT, SEGMENT_QCUT_DEFAULT).alias("segment"))


def rfm_profit_summary(t: RetailTables) -> DataFrame:
    """RF7: customers, average revenue, average profit and margin per segment."""
    from vitrine.operators.profit import order_profit_frame

    s = rfm_qcut(order_profit_frame(t)).withColumn(
        "segment", first_match(SEGMENTS_QCUT, SEGMENT_QCUT_DEFAULT))
    g = s.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"),
                                 F.avg("monetary").alias("_rev"), F.avg("total_profit").alias("_profit"))
    return g.select("segment", "customers", rnd("_rev", 2).alias("avg_revenue"),
                    rnd("_profit", 2).alias("avg_profit"),
                    rnd(F.col("_profit") / F.col("_rev") * 100, 1).alias("profit_margin_pct"))
