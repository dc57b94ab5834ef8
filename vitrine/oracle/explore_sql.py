"""Oracle SQL for the exploration operators: statistics over the materialised
wide frame (the direct way)."""

from vitrine.oracle import R, with_views

WIDE = """wide AS (
  SELECT o.*, c.customer_unique_id, c.customer_state, i.order_item_id, i.product_id, i.price,
    i.freight_value, p.payment_sequential, pr.product_category_name, r.review_score,
    CAST(floor(datediff('second', o.order_estimated_delivery_date, o.order_delivered_customer_date) / 86400) AS INT) AS delay
  FROM r_orders o LEFT JOIN r_customers c ON o.customer_id = c.customer_id
  LEFT JOIN r_items i ON o.order_id = i.order_id
  LEFT JOIN r_payments p ON o.order_id = p.order_id
  LEFT JOIN r_products pr ON i.product_id = pr.product_id
  LEFT JOIN r_reviews r ON o.order_id = r.order_id
  LEFT JOIN r_sellers s ON i.seller_id = s.seller_id)"""

REV = """rev AS (
  SELECT o.order_id, o.order_purchase_timestamp, i.product_id, i.price + i.freight_value AS revenue
  FROM r_orders o LEFT JOIN r_items i ON o.order_id = i.order_id)"""

OPC = """opc AS (
  SELECT c.customer_unique_id, COUNT(DISTINCT o.order_id) AS n_orders
  FROM r_orders o LEFT JOIN r_customers c ON o.customer_id = c.customer_id
  WHERE c.customer_unique_id IS NOT NULL GROUP BY c.customer_unique_id)"""

BUCKET = """CASE WHEN delay > -100 AND delay <= -10 THEN 'Very Early'
  WHEN delay > -10 AND delay <= 0 THEN 'Early' WHEN delay > 0 AND delay <= 5 THEN 'On Time'
  WHEN delay > 5 AND delay <= 10 THEN 'Slight Delay' WHEN delay > 10 AND delay <= 20 THEN 'Delay'
  WHEN delay > 20 AND delay <= 100 THEN 'Severe Delay' END"""

SQL = {
    "total_revenue": with_views(f"SELECT {R('SUM(revenue)', 2)} AS total_revenue FROM rev", REV),
    "daily_revenue": with_views(f"""
SELECT strftime(order_purchase_timestamp, '%Y-%m-%d') AS order_date, {R('COALESCE(SUM(revenue), 0)', 2)} AS revenue
FROM rev GROUP BY 1""", REV),
    "peak_revenue_day": with_views(f"""
SELECT strftime(order_purchase_timestamp, '%Y-%m-%d') AS order_date, {R('COALESCE(SUM(revenue), 0)', 2)} AS revenue,
  COUNT(*) AS n_rows
FROM rev GROUP BY 1 ORDER BY COALESCE(SUM(revenue), 0) DESC, 1 LIMIT 1""", REV),
    "peak_day_items": with_views("""
SELECT strftime(o.order_purchase_timestamp, '%Y-%m-%d') AS order_date, o.order_id, o.order_status, i.order_item_id, i.product_id,
  CAST(i.price AS DOUBLE) AS price, CAST(i.freight_value AS DOUBLE) AS freight_value
FROM r_orders o LEFT JOIN r_items i ON o.order_id = i.order_id
WHERE o.order_purchase_timestamp::DATE = (
  SELECT order_purchase_timestamp::DATE FROM rev GROUP BY 1 ORDER BY COALESCE(SUM(revenue), 0) DESC, 1 LIMIT 1)""", REV),
    "top_categories": with_views(f"""
SELECT COALESCE(p.product_category_name, 'Unknown') AS top_category, {R('COALESCE(SUM(revenue), 0)', 2)} AS revenue
FROM rev LEFT JOIN r_products p ON rev.product_id = p.product_id
GROUP BY 1 ORDER BY COALESCE(SUM(revenue), 0) DESC, 1 LIMIT 10""", REV),
    "review_score_histogram": with_views("""
SELECT review_score, COUNT(*) AS n_rows FROM wide WHERE review_score IS NOT NULL GROUP BY 1""", WIDE),
    "late_delivery_stats": with_views(f"""
SELECT {R('100.0 * SUM(CASE WHEN delay > 0 THEN 1 ELSE 0 END) / COUNT(order_delivered_customer_date)', 2)} AS pct_delayed,
  {R('AVG(delay)', 2)} AS avg_delay_days FROM wide""", WIDE),
    "review_by_delay": with_views(f"""
SELECT delay AS delivery_delay, {R('AVG(review_score)', 4)} AS avg_review_score
FROM wide WHERE delay IS NOT NULL GROUP BY delay""", WIDE),
    "review_by_delay_bucket": with_views(f"""
SELECT b.bucket_order, b.delay_bucket, {R('AVG(w.review_score)', 4)} AS avg_review_score
FROM (VALUES (0, 'Very Early'), (1, 'Early'), (2, 'On Time'), (3, 'Slight Delay'), (4, 'Delay'),
             (5, 'Severe Delay')) b(bucket_order, delay_bucket)
LEFT JOIN (SELECT *, {BUCKET} AS bucket FROM wide) w ON w.bucket = b.delay_bucket
GROUP BY b.bucket_order, b.delay_bucket""", WIDE),
    "monthly_revenue": with_views(f"""
SELECT strftime(order_purchase_timestamp, '%Y-%m') AS month, {R('COALESCE(SUM(revenue), 0)', 2)} AS revenue
FROM rev GROUP BY 1""", REV),
    "customers_by_state": with_views("""
SELECT customer_state, COUNT(*) AS n_rows FROM wide WHERE customer_state IS NOT NULL GROUP BY 1""", WIDE),
    "orders_per_customer": with_views("""
SELECT n_orders, COUNT(*) AS n_customers FROM opc GROUP BY n_orders""", OPC),
    "repeat_rate": with_views(f"""
SELECT COUNT(*) AS total_customers, COUNT(*) FILTER (WHERE n_orders > 1) AS repeat_customers,
  {R('100.0 * COUNT(*) FILTER (WHERE n_orders > 1) / COUNT(*)', 2)} AS repeat_rate_pct FROM opc""", OPC),
}
