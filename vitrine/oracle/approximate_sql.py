"""Oracle SQL of the sketch queries: the exact answers; every estimate is to
lie within its error."""

from vitrine.oracle import R, with_views

_MONTH = "strftime(o.order_purchase_timestamp, '%Y-%m')"

SQL = {
    "approx_customers_by_month": with_views(f"""
SELECT CASE WHEN GROUPING({_MONTH}) = 1 THEN 'all' ELSE {_MONTH} END AS month, COUNT(*) AS orders,
  COUNT(DISTINCT c.customer_unique_id) AS customers, TRUE AS within_error
FROM r_orders o JOIN r_customers c ON o.customer_id = c.customer_id GROUP BY ROLLUP ({_MONTH})"""),
    "approx_median_by_month": with_views(f"""
SELECT CASE WHEN GROUPING({_MONTH}) = 1 THEN 'all' ELSE {_MONTH} END AS month, COUNT(*) AS orders,
  {R('SUM(v.value)', 2)} AS revenue, TRUE AS within_error
FROM r_orders o JOIN (SELECT order_id, SUM(price + freight_value) AS value FROM r_items GROUP BY 1) v ON o.order_id = v.order_id
GROUP BY ROLLUP ({_MONTH})"""),
}
