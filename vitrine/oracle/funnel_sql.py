"""Oracle SQL for the funnel operators, from the definitions.

``facts`` has one row per order; what the raw joins would repeat (an order per
review, an item per review) is counted by weights instead of joining rows:
an order without a review stands once, with k reviews k times.
"""

from vitrine.oracle import P, R, with_views


def _facts(excluded: str = "canceled") -> str:
    return f"""scores AS (SELECT order_id, count(*) AS k, sum(review_score) AS points FROM r_reviews GROUP BY order_id),
facts AS (
  SELECT order_id, customer_id, order_purchase_timestamp AS placed, order_approved_at AS paid,
    order_delivered_carrier_date AS sent, order_delivered_customer_date AS got,
    date_diff('day', order_estimated_delivery_date::DATE, order_delivered_customer_date::DATE) AS days,
    order_status <> '{excluded}' AND order_status <> 'unavailable' AS valid,
    coalesce(k, 1) AS copies, k, points
  FROM r_orders LEFT JOIN scores USING (order_id)),
lines AS (
  SELECT order_id, coalesce(product_category_name_english, product_category_name) AS category,
    count(*) AS n, sum(price) AS value
  FROM r_items JOIN r_products USING (product_id) LEFT JOIN r_translation USING (product_category_name)
  GROUP BY ALL)"""


def _mean(total: str, count: str, digits: int) -> str:
    return R(f"CAST({total} AS DOUBLE) / {count}", digits)


# lines as often as the raw join with the reviews has them
W = "n * copies"
LATE_ROWS = f"coalesce(sum({W}) FILTER (days > 0), 0)"
_DAYS = _mean(f"sum(days * {W})", f"sum({W}) FILTER (days IS NOT NULL)", 1)

_BY_CATEGORY = f"""
SELECT category, count(DISTINCT order_id) AS total_orders, {R("sum(value * copies)", 2)} AS total_revenue,
  {R(f"sum(value * copies) / sum({W})", 2)} AS avg_price, {_DAYS} AS avg_delay_days,
  {LATE_ROWS}::BIGINT AS late_orders, {P(LATE_ROWS, f"sum({W})")} AS late_rate_pct,
  {_mean("sum(points * n)", "sum(k * n)", 1)} AS avg_review_score
FROM lines JOIN facts USING (order_id)
WHERE valid GROUP BY category HAVING count(DISTINCT order_id) > 100
ORDER BY late_rate_pct DESC, category NULLS FIRST LIMIT 20"""



def _root_cause(late: str) -> str:
    return f"""
SELECT customer_state, category, count(*) AS total_orders, {_DAYS} AS avg_delay_days,
  {P(late, "count(*)")} AS late_rate_pct,
  {_mean("sum(points * n)", "sum(k * n)", 2)} AS avg_review_score
FROM lines JOIN facts USING (order_id) JOIN r_customers USING (customer_id)
WHERE got IS NOT NULL GROUP BY customer_state, category HAVING count(*) > 30
ORDER BY late_rate_pct DESC, customer_state, category NULLS FIRST LIMIT 25"""


_STEPS = f"""
SELECT count(*) AS total_orders, count(*) FILTER (valid) AS valid_orders, count(paid) AS payment_confirmed,
  count(sent) AS shipped, count(got) AS delivered, count(*) FILTER (days <= 0) AS delivered_on_time,
  {P("count(paid)", "count(*)")} AS pct_payment_confirmed, {P("count(got)", "count(*)")} AS pct_delivered,
  {P("count(*) FILTER (days <= 0)", "count(*)")} AS pct_on_time
FROM facts"""

SQL = {
    "funnel_summary": with_views(_STEPS, _facts()),
    "funnel_summary_as_written": with_views(_STEPS, _facts("cancelled")),
    "funnel_by_state": with_views(f"""
SELECT customer_state AS state, count(*) AS total_orders,
  {_mean("sum(days * copies)", "sum(copies)", 1)} AS avg_delay_days,
  coalesce(sum(copies) FILTER (days > 0), 0)::BIGINT AS late_orders,
  {P("coalesce(sum(copies) FILTER (days > 0), 0)", "sum(copies)")} AS late_rate_pct,
  {_mean("sum(points)", "sum(k)", 1)} AS avg_review_score
FROM facts JOIN r_customers USING (customer_id) WHERE got IS NOT NULL GROUP BY customer_state""", _facts()),
    "funnel_by_category": with_views(_BY_CATEGORY, _facts()),
    "funnel_by_category_as_written": with_views(_BY_CATEGORY, _facts("cancelled")),
    "funnel_by_category_distinct": with_views(f"""
SELECT category, count(*) AS total_orders, {R("sum(value)", 2)} AS total_revenue,
  {R("sum(value) / sum(n)", 2)} AS avg_price,
  {_mean("sum(days * n)", "sum(n) FILTER (days IS NOT NULL)", 1)} AS avg_delay_days,
  count(*) FILTER (days > 0) AS late_orders, {P("count(*) FILTER (days > 0)", "count(*)")} AS late_rate_pct,
  {_mean("sum(CAST(points AS DOUBLE) / k * n)", "sum(n) FILTER (k IS NOT NULL)", 2)} AS avg_review_score
FROM lines JOIN facts USING (order_id)
WHERE valid GROUP BY category HAVING count(*) > 100
ORDER BY late_rate_pct DESC, category NULLS FIRST LIMIT 20""", _facts()),
    "delay_root_cause": with_views(_root_cause("count(*) FILTER (days > 0)"), _facts()),
    "delay_root_cause_as_written": with_views(_root_cause(LATE_ROWS), _facts()),
    "monthly_performance": with_views(f"""
SELECT strftime(placed, '%Y-%m') AS month, count(*) AS total_orders, count(DISTINCT customer_unique_id) AS unique_customers,
  {R("sum(value * copies)", 2)} AS total_revenue, {R(f"sum(value * copies) / sum({W})", 2)} AS avg_order_value,
  {_mean("sum(points * n)", "sum(k * n)", 2)} AS avg_review_score, {LATE_ROWS}::BIGINT AS late_orders
FROM (SELECT order_id, sum(n) AS n, sum(value) AS value FROM (SELECT order_id, count(*) AS n, sum(price) AS value FROM r_items GROUP BY 1) GROUP BY 1)
JOIN facts USING (order_id) JOIN r_customers USING (customer_id)
WHERE valid GROUP BY month""", _facts()),
    "delay_rate_by_state": with_views(f"""
SELECT customer_state, total, late AS delayed, {R("late * 100.0 / total", 2)} AS rate_pct,
  {R("all_late * 100.0 / all_total", 2)} AS national_rate_pct, late * all_total > all_late * total AS above_national
FROM (SELECT customer_state, count(*) AS total, count(*) FILTER (late) AS late FROM arrived JOIN r_customers USING (customer_id)
      WHERE customer_state IS NOT NULL GROUP BY customer_state)
CROSS JOIN (SELECT count(*) AS all_total, count(*) FILTER (late) AS all_late FROM arrived)
WHERE total > 200 ORDER BY late / total DESC, customer_state DESC LIMIT 15""",
        """arrived AS (SELECT customer_id, order_delivered_customer_date > order_estimated_delivery_date AS late FROM r_orders
  WHERE order_delivered_customer_date IS NOT NULL AND coalesce(order_status, '') NOT IN ('canceled', 'unavailable'))"""),
}
