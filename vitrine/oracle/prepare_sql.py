"""Oracle SQL for the preparation operators."""

from vitrine.oracle import with_views

WIDE = """FROM r_orders o LEFT JOIN r_customers c ON o.customer_id = c.customer_id
  LEFT JOIN r_items i ON o.order_id = i.order_id LEFT JOIN r_payments p ON o.order_id = p.order_id
  LEFT JOIN r_products pr ON i.product_id = pr.product_id LEFT JOIN r_reviews r ON o.order_id = r.order_id
  LEFT JOIN r_sellers s ON i.seller_id = s.seller_id"""

SQL = {
    "denormalised_orders": with_views("""
SELECT o.order_id, i.order_item_id, c.customer_state, pr.product_category_name, s.seller_state,
  CAST(i.price AS DOUBLE) AS price, CAST(p.payment_value AS DOUBLE) AS payment_value, p.n_payments, p.payment_type,
  r.n_rev, lr.review_score
FROM r_orders o LEFT JOIN r_customers c ON o.customer_id = c.customer_id
LEFT JOIN r_items i ON o.order_id = i.order_id
LEFT JOIN (SELECT order_id, COUNT(*) AS n_payments, SUM(payment_value) AS payment_value,
             arg_min(payment_type, payment_sequential) AS payment_type FROM r_payments GROUP BY 1) p ON o.order_id = p.order_id
LEFT JOIN r_products pr ON i.product_id = pr.product_id
LEFT JOIN (SELECT order_id, COUNT(*) AS n_rev FROM r_reviews GROUP BY 1) r ON o.order_id = r.order_id
LEFT JOIN (SELECT order_id, review_score FROM (SELECT *, row_number() OVER (PARTITION BY order_id
             ORDER BY review_answer_timestamp DESC, review_id DESC) AS rn FROM r_reviews) x WHERE rn = 1) lr
  ON o.order_id = lr.order_id
LEFT JOIN r_sellers s ON i.seller_id = s.seller_id"""),
    "dedup_order_items": with_views(f"""
SELECT o.order_id, i.order_item_id, CAST(i.price AS DOUBLE) AS price,
  CAST(i.freight_value AS DOUBLE) AS freight_value, p.payment_type, r.review_score {WIDE}
QUALIFY row_number() OVER (PARTITION BY o.order_id, i.order_item_id ORDER BY p.payment_sequential, r.review_id) = 1"""),
    "latest_review_per_order": with_views("""
SELECT order_id, review_score FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY review_answer_timestamp DESC, review_id DESC) AS rn
  FROM r_reviews) x WHERE rn = 1"""),
    "items_per_order": with_views("""
SELECT order_id, CAST(SUM(price) AS DOUBLE) AS price, CAST(SUM(freight_value) AS DOUBLE) AS freight_value,
  COUNT(order_item_id) AS item_count, arg_min(product_id, order_item_id) AS product_id FROM r_items GROUP BY 1"""),
    "payments_per_order": with_views("""
SELECT order_id, CAST(SUM(payment_value) AS DOUBLE) AS payment_value,
  arg_min(payment_type, payment_sequential) AS payment_type, bool_or(payment_type = 'voucher') AS voucher_used
FROM r_payments GROUP BY 1"""),
    "payments_per_order_mode": with_views("""
SELECT p.order_id, CAST(SUM(payment_value) AS DOUBLE) AS payment_value, MAX(payment_installments) AS payment_installments,
  ANY_VALUE(m.payment_type) AS payment_type
FROM r_payments p LEFT JOIN (SELECT order_id, payment_type FROM (
    SELECT order_id, payment_type, row_number() OVER (PARTITION BY order_id ORDER BY COUNT(*) DESC, payment_type) AS rn
    FROM r_payments WHERE payment_type IS NOT NULL GROUP BY 1, 2) x WHERE rn = 1) m ON p.order_id = m.order_id
GROUP BY p.order_id"""),
    "orders_enriched": with_views("""
SELECT order_id, order_status,
  CAST(datediff('day', CAST(order_estimated_delivery_date AS DATE), CAST(order_delivered_customer_date AS DATE)) AS INTEGER) AS delivery_delay_days,
  CAST(floor(datediff('second', order_estimated_delivery_date, order_delivered_customer_date) / 86400) AS INT) AS delay_days_floor,
  strftime(order_purchase_timestamp, '%Y-%m') AS order_month
FROM r_orders WHERE order_status NOT IN ('canceled', 'unavailable')"""),
    "sql_preview": with_views("""
SELECT order_id, strftime(order_purchase_timestamp, '%Y-%m') AS order_month,
  CAST(datediff('day', CAST(order_estimated_delivery_date AS DATE), CAST(order_delivered_customer_date AS DATE)) AS INTEGER) AS delivery_delay_days
FROM r_orders ORDER BY order_id LIMIT 10"""),
}
