"""Oracle SQL for the deterministic ML feature tables, encodings and splits."""

from vitrine.oracle import R, dense_histogram, with_views

OT = """oc AS (SELECT * FROM r_orders WHERE order_status IS NULL OR order_status NOT IN ('canceled', 'unavailable')),
ia AS (SELECT order_id, SUM(price) AS order_price, SUM(freight_value) AS freight_value, COUNT(order_item_id) AS n_items
  FROM r_items GROUP BY 1),
pa AS (SELECT order_id, SUM(payment_value) AS payment_value, MAX(payment_installments) AS payment_installments
  FROM r_payments GROUP BY 1),
pmode AS (SELECT order_id, payment_type FROM (
    SELECT order_id, payment_type, row_number() OVER (PARTITION BY order_id ORDER BY COUNT(*) DESC, payment_type) AS rn
    FROM r_payments WHERE payment_type IS NOT NULL GROUP BY order_id, payment_type) x WHERE rn = 1),
lr AS (SELECT order_id, review_score FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY review_answer_timestamp DESC, review_id DESC) AS rn
    FROM r_reviews) x WHERE rn = 1),
ot AS (
  SELECT o.order_id, o.order_purchase_timestamp, c.customer_unique_id, c.customer_state, ia.order_price,
    ia.freight_value, ia.n_items, pa.payment_value, pa.payment_installments, pm.payment_type, lr.review_score,
    CAST(floor(datediff('second', o.order_estimated_delivery_date, o.order_delivered_customer_date) / 86400) AS INT) AS delay_days
  FROM oc o LEFT JOIN r_customers c ON o.customer_id = c.customer_id LEFT JOIN ia ON o.order_id = ia.order_id
  LEFT JOIN pa ON o.order_id = pa.order_id LEFT JOIN pmode pm ON o.order_id = pm.order_id
  LEFT JOIN lr ON o.order_id = lr.order_id)"""

CT = OT + """,
cpm AS (SELECT customer_unique_id, payment_type FROM (
    SELECT customer_unique_id, payment_type,
      row_number() OVER (PARTITION BY customer_unique_id ORDER BY COUNT(*) DESC, payment_type) AS rn
    FROM ot WHERE payment_type IS NOT NULL AND customer_unique_id IS NOT NULL GROUP BY 1, 2) x WHERE rn = 1),
ct0 AS (
  SELECT customer_unique_id, MAX(order_purchase_timestamp) AS last_ts, COUNT(DISTINCT order_id) AS frequency,
    CAST(COALESCE(SUM(order_price), 0) AS DOUBLE) AS monetary, AVG(CAST(order_price AS DOUBLE)) AS avg_order_value,
    AVG(review_score) AS avg_review_score, AVG(CAST(freight_value AS DOUBLE)) AS avg_freight,
    AVG(payment_installments) AS avg_installments, COALESCE(AVG(delay_days), 0.0) AS avg_delay_days,
    arg_min(customer_state, struct_pack(t := order_purchase_timestamp, i := order_id)) AS customer_state,
    CAST(COALESCE(SUM(n_items), 0) AS BIGINT) AS n_items_total
  FROM ot WHERE customer_unique_id IS NOT NULL GROUP BY 1),
ct AS (
  SELECT ct0.customer_unique_id, CAST(floor(datediff('second', last_ts, (SELECT MAX(order_purchase_timestamp) FROM ot)) / 86400) AS INT) AS recency_days,
    frequency, monetary, avg_order_value,
    COALESCE(avg_review_score, (SELECT median(avg_review_score) FROM ct0)) AS avg_review_score,
    avg_freight, avg_installments, avg_delay_days, customer_state, COALESCE(cpm.payment_type, 'unknown') AS payment_type,
    n_items_total
  FROM ct0 LEFT JOIN cpm ON ct0.customer_unique_id = cpm.customer_unique_id),
ch AS (SELECT *, CAST(recency_days > 90 AS INT) AS churned FROM ct),
enc AS (
  SELECT ch.*, se.state_enc, pe.payment_enc FROM ch
  JOIN (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS state_enc
        FROM (SELECT DISTINCT COALESCE(customer_state, 'Unknown') AS v FROM ch) d) se ON COALESCE(ch.customer_state, 'Unknown') = se.v
  JOIN (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS payment_enc
        FROM (SELECT DISTINCT COALESCE(payment_type, 'Unknown') AS v FROM ch) d) pe ON COALESCE(ch.payment_type, 'Unknown') = pe.v)"""


def strat(src: str, label: str, key: str, name: str) -> str:
    """Stratified split CTE chain over ``src`` (the ML6 rule)."""
    return f"""{name}_r AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY ({key} * 48271) % 2147483647, {key}) AS _rc,
    COUNT(*) OVER () AS _n, COUNT(*) OVER (PARTITION BY {label}) AS _nc FROM {src}),
{name}_c AS (SELECT DISTINCT {label}, _nc, _n, ceil(_n * 0.2) * _nc / _n AS _ex FROM {name}_r),
{name}_t AS (
  SELECT {label}, floor(_ex) + CASE WHEN row_number() OVER (ORDER BY _ex - floor(_ex) DESC, {label})
      <= ceil(_n * 0.2) - SUM(floor(_ex)) OVER () THEN 1 ELSE 0 END AS _take FROM {name}_c),
{name} AS (
  SELECT r.*, CASE WHEN _rc <= _take THEN 'test' ELSE 'train' END AS split
  FROM {name}_r r JOIN {name}_t t ON r.{label} = t.{label})"""


CHURN_FEATURES = ["frequency", "monetary", "avg_order_value", "avg_review_score", "avg_freight",
                  "avg_installments", "avg_delay_days", "n_items_total", "state_enc", "payment_enc"]

MID = """mid AS (SELECT MIN(order_purchase_timestamp) AS mn, MAX(order_purchase_timestamp) AS mx,
  MIN(order_purchase_timestamp) + to_microseconds(datediff('microsecond', MIN(order_purchase_timestamp), MAX(order_purchase_timestamp)) // 2) AS md
  FROM oc)"""

CLV = OT + ",\n" + MID + """,
early AS (SELECT oc.* FROM oc, mid WHERE order_purchase_timestamp <= md),
late AS (SELECT oc.* FROM oc, mid WHERE order_purchase_timestamp > md),
e AS (
  SELECT e.order_id, e.order_purchase_timestamp, c.customer_unique_id, c.customer_state, i.order_price, i.freight,
    p.payment_installments
  FROM early e LEFT JOIN r_customers c ON e.customer_id = c.customer_id
  LEFT JOIN (SELECT order_id, SUM(price) AS order_price, SUM(freight_value) AS freight FROM r_items GROUP BY 1) i ON e.order_id = i.order_id
  LEFT JOIN (SELECT order_id, MAX(payment_installments) AS payment_installments FROM r_payments GROUP BY 1) p ON e.order_id = p.order_id
  WHERE c.customer_unique_id IS NOT NULL),
feats AS (
  SELECT customer_unique_id, COUNT(DISTINCT order_id) AS frequency_early,
    CAST(COALESCE(SUM(order_price), 0) AS DOUBLE) AS total_spend_early, AVG(CAST(order_price AS DOUBLE)) AS avg_order_value,
    AVG(CAST(freight AS DOUBLE)) AS avg_freight, AVG(payment_installments) AS avg_installments,
    arg_min(customer_state, struct_pack(t := order_purchase_timestamp, i := order_id)) AS customer_state
  FROM e GROUP BY 1),
ecat AS (
  SELECT c.customer_unique_id, COALESCE(t.product_category_name_english, pr.product_category_name) AS category
  FROM early e LEFT JOIN r_items i ON e.order_id = i.order_id LEFT JOIN r_customers c ON e.customer_id = c.customer_id
  LEFT JOIN r_products pr ON i.product_id = pr.product_id
  LEFT JOIN r_translation t ON pr.product_category_name = t.product_category_name
  WHERE c.customer_unique_id IS NOT NULL),
topcat AS (SELECT customer_unique_id, category AS top_category FROM (
    SELECT customer_unique_id, category, row_number() OVER (PARTITION BY customer_unique_id ORDER BY COUNT(*) DESC, category) AS rn
    FROM ecat WHERE category IS NOT NULL GROUP BY 1, 2) x WHERE rn = 1),
fut AS (
  SELECT c.customer_unique_id, COALESCE(SUM(i.price), 0) AS future_spend
  FROM late l LEFT JOIN r_customers c ON l.customer_id = c.customer_id
  LEFT JOIN (SELECT order_id, SUM(price) AS price FROM r_items GROUP BY 1) i ON l.order_id = i.order_id
  WHERE c.customer_unique_id IS NOT NULL GROUP BY 1),
clv0 AS (
  SELECT f.*, COALESCE(tc.top_category, 'unknown') AS top_category,
    COALESCE(CAST(fu.future_spend AS DOUBLE), 0.0) AS future_spend
  FROM feats f LEFT JOIN topcat tc ON f.customer_unique_id = tc.customer_unique_id
  LEFT JOIN fut fu ON f.customer_unique_id = fu.customer_unique_id),
clv AS (
  SELECT clv0.*, se.state_enc, ce.cat_enc FROM clv0
  JOIN (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS state_enc
        FROM (SELECT DISTINCT COALESCE(customer_state, 'Unknown') AS v FROM clv0) d) se ON COALESCE(clv0.customer_state, 'Unknown') = se.v
  JOIN (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS cat_enc
        FROM (SELECT DISTINCT top_category AS v FROM clv0) d) ce ON clv0.top_category = ce.v)"""

DELAY = OT + """,
d0 AS (
  SELECT o.order_id, CAST(o.order_delivered_customer_date > o.order_estimated_delivery_date AS INT) AS is_delayed,
    c.customer_state, CAST(i.price AS DOUBLE) AS price, CAST(i.freight AS DOUBLE) AS freight,
    COALESCE(pc.product_category_name, CASE WHEN pw.order_id IS NOT NULL THEN 'unknown' END) AS product_category_name,
    pw.product_weight_g, pw.product_length_cm * pw.product_height_cm * pw.product_width_cm AS volume_cm3,
    COALESCE(pm.payment_type, CASE WHEN pp.order_id IS NOT NULL THEN 'unknown' END) AS payment_type
  FROM oc o LEFT JOIN r_customers c ON o.customer_id = c.customer_id
  LEFT JOIN (SELECT order_id, SUM(price) AS price, SUM(freight_value) AS freight FROM r_items GROUP BY 1) i ON o.order_id = i.order_id
  LEFT JOIN (SELECT i.order_id, AVG(p.product_weight_g) AS product_weight_g, AVG(p.product_length_cm) AS product_length_cm,
               AVG(p.product_height_cm) AS product_height_cm, AVG(p.product_width_cm) AS product_width_cm
             FROM r_items i JOIN r_products p ON i.product_id = p.product_id GROUP BY 1) pw ON o.order_id = pw.order_id
  LEFT JOIN (SELECT order_id, product_category_name FROM (
      SELECT i.order_id, p.product_category_name,
        row_number() OVER (PARTITION BY i.order_id ORDER BY COUNT(*) DESC, p.product_category_name) AS rn
      FROM r_items i JOIN r_products p ON i.product_id = p.product_id
      WHERE p.product_category_name IS NOT NULL GROUP BY 1, 2) x WHERE rn = 1) pc ON o.order_id = pc.order_id
  LEFT JOIN pmode pm ON o.order_id = pm.order_id
  LEFT JOIN (SELECT DISTINCT order_id FROM r_payments) pp ON o.order_id = pp.order_id
  WHERE o.order_delivered_customer_date IS NOT NULL),
d1 AS (
  SELECT d0.order_id, d0.is_delayed, d0.price, d0.freight, d0.product_weight_g, d0.volume_cm3,
    se.state_enc, ce.cat_enc, pe.payment_enc FROM d0
  JOIN (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS state_enc
        FROM (SELECT DISTINCT COALESCE(customer_state, 'Unknown') AS v FROM d0) d) se ON COALESCE(d0.customer_state, 'Unknown') = se.v
  JOIN (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS cat_enc
        FROM (SELECT DISTINCT COALESCE(product_category_name, 'unknown') AS v FROM d0) d) ce ON COALESCE(d0.product_category_name, 'unknown') = ce.v
  JOIN (SELECT v, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INT) AS payment_enc
        FROM (SELECT DISTINCT COALESCE(payment_type, 'unknown') AS v FROM d0) d) pe ON COALESCE(d0.payment_type, 'unknown') = pe.v),
dl AS (SELECT * FROM d1 WHERE product_weight_g IS NOT NULL AND volume_cm3 IS NOT NULL AND price IS NOT NULL
  AND freight IS NOT NULL AND state_enc IS NOT NULL AND cat_enc IS NOT NULL AND payment_enc IS NOT NULL AND is_delayed IS NOT NULL)"""

DELAY_OUT = ("order_id, " + ", ".join(f"{R(c, 6)} AS {c}" for c in ("product_weight_g", "volume_cm3", "price", "freight"))
             + ", state_enc, cat_enc, payment_enc, is_delayed")


def rnd_cols(cols: list[str], doubles: set[str]) -> str:
    return ", ".join(f"{R(c, 6)} AS {c}" if c in doubles else c for c in cols)


_CT_DOUBLES = {"monetary", "avg_order_value", "avg_review_score", "avg_freight", "avg_installments", "avg_delay_days"}
_CT_COLS = ["customer_unique_id", "recency_days", "frequency", "monetary", "avg_order_value", "avg_review_score",
            "avg_freight", "avg_installments", "avg_delay_days", "customer_state", "payment_type", "n_items_total"]

_HIST_RECENCY = dense_histogram("(SELECT CAST(recency_days AS DOUBLE) AS x FROM ct)", 60)

_STD = ", ".join(
    f"{R(f'(COALESCE({c}, 0) - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END', 6)} AS {c}" for c in CHURN_FEATURES)
_STATS = ", ".join(f"AVG(COALESCE({c}, 0)) AS m_{c}, stddev_pop(COALESCE({c}, 0)) AS s_{c}" for c in CHURN_FEATURES)

_FMT = "'%Y-%m-%d %H:%M:%S.%f'"

SQL = {
    "order_features": with_views("""
SELECT order_id, customer_unique_id, customer_state, strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS purchase_ts,
  CAST(order_price AS DOUBLE) AS order_price, CAST(freight_value AS DOUBLE) AS freight_value,
  CAST(n_items AS DOUBLE) AS n_items, CAST(payment_value AS DOUBLE) AS payment_value,
  CAST(payment_installments AS DOUBLE) AS payment_installments, payment_type,
  CAST(review_score AS DOUBLE) AS review_score, CAST(delay_days AS DOUBLE) AS delay_days
FROM ot""", OT),
    "customer_features": with_views(f"SELECT {rnd_cols(_CT_COLS, _CT_DOUBLES)} FROM ct", CT),
    "churn_labels": with_views(f"""
SELECT churned, COUNT(*) AS customers, {R('100.0 * COUNT(*) / SUM(COUNT(*)) OVER ()', 2)} AS pct FROM ch GROUP BY churned""", CT),
    "recency_histogram": with_views(_HIST_RECENCY, CT),
    "label_encode": with_views("""
SELECT customer_unique_id, COALESCE(customer_state, 'Unknown') AS customer_state, state_enc,
  COALESCE(payment_type, 'Unknown') AS payment_type, payment_enc FROM enc""", CT),
    "stratified_split": with_views("SELECT customer_unique_id, churned, split FROM cs",
                                   CT + ",\n" + strat("enc", "churned", "customer_unique_id", "cs")),
    "random_split": with_views("""
SELECT customer_unique_id, CASE WHEN row_number() OVER (ORDER BY (customer_unique_id * 48271) % 2147483647, customer_unique_id)
  <= ceil(COUNT(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM clv""", CLV),
    "standardise": with_views(f"""
SELECT customer_unique_id, split, {_STD} FROM cs, (SELECT {_STATS} FROM cs WHERE split = 'train') st""",
                              CT + ",\n" + strat("enc", "churned", "customer_unique_id", "cs")),
    "class_weights": with_views(f"""
SELECT churned AS label, COUNT(*) AS n, {R('SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*))', 6)} AS weight,
  {R('SUM(COUNT(*) FILTER (WHERE churned = 0)) OVER () / SUM(COUNT(*) FILTER (WHERE churned = 1)) OVER ()', 6)} AS scale_pos_weight
FROM cs WHERE split = 'train' GROUP BY churned""", CT + ",\n" + strat("enc", "churned", "customer_unique_id", "cs")),
    "time_split": with_views(f"""
SELECT CASE WHEN order_purchase_timestamp <= md THEN 'early' ELSE 'late' END AS period, strftime(md, {_FMT}) AS midpoint,
  COUNT(*) AS orders, strftime(MIN(order_purchase_timestamp), {_FMT}) AS first_ts,
  strftime(MAX(order_purchase_timestamp), {_FMT}) AS last_ts
FROM oc, mid GROUP BY 1, 2""", OT + ",\n" + MID),
    "clv_features": with_views(f"""
SELECT {rnd_cols(["customer_unique_id", "frequency_early", "total_spend_early", "avg_order_value", "avg_freight",
                  "avg_installments", "customer_state", "top_category", "state_enc", "cat_enc"],
                 {"total_spend_early", "avg_order_value", "avg_freight", "avg_installments"})} FROM clv""", CLV),
    "future_spend": with_views(f"SELECT customer_unique_id, {R('future_spend', 2)} AS future_spend FROM clv", CLV),
    "delay_features": with_views(f"SELECT {DELAY_OUT} FROM dl", DELAY),
    "sample_rows": with_views(f"""
SELECT {DELAY_OUT} FROM ds WHERE split = 'test' ORDER BY (order_id * 48271) % 2147483647, order_id LIMIT 2000""",
                              DELAY + ",\n" + strat("dl", "is_delayed", "order_id", "ds")),
    "delay_class_balance": with_views(f"""
SELECT is_delayed, COUNT(*) AS orders, {R('100.0 * COUNT(*) / SUM(COUNT(*)) OVER ()', 2)} AS pct,
  (SELECT COUNT(*) FROM d1) AS rows_before, (SELECT COUNT(*) FROM d1) - (SELECT COUNT(*) FROM dl) AS rows_dropped
FROM dl GROUP BY is_delayed""", DELAY),
}
