"""DuckDB oracle SQL: an independent statement of every registered query.

The driver registers the raw test tables as views; the retail views of
FIXTURES.md section 4 are therefore spelled out as CTEs in front of every
oracle query (DuckDB drops the ones a query does not reference).
"""

from __future__ import annotations

ADAPTER_CTES = """
r_orders AS (
  SELECT o_orderkey AS order_id, o_orderkey AS customer_id,
    CASE WHEN o_orderkey % 50 = 0 THEN 'canceled' WHEN o_orderkey % 50 = 1 THEN 'unavailable'
         WHEN o_orderkey % 50 = 2 THEN 'shipped' ELSE 'delivered' END AS order_status,
    o_orderdate + to_seconds(o_orderkey % 86400) AS order_purchase_timestamp,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderdate + to_seconds(3600 + o_orderkey % 86400) END AS order_approved_at,
    CASE WHEN o_orderkey % 50 < 2 THEN NULL ELSE o_orderdate + to_days(CAST(1 + o_orderkey % 3 AS INT)) END AS order_delivered_carrier_date,
    CASE WHEN o_orderkey % 50 < 3 THEN NULL ELSE o_orderdate + to_days(CAST(3 + (o_orderkey*31) % 20 AS INT)) + to_hours(14) END AS order_delivered_customer_date,
    o_orderdate + to_days(CAST(20 + o_orderkey % 4 AS INT)) AS order_estimated_delivery_date
  FROM orders),
r_customers AS (
  SELECT o.o_orderkey AS customer_id, o.o_custkey AS customer_unique_id, n.n_name AS customer_state
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
r_items AS (
  SELECT l_orderkey AS order_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS INT) AS order_item_id,
    l_partkey AS product_id, l_suppkey AS seller_id,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // 500 AS DECIMAL(12,0)) * 0.01 AS price,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) // 4000 AS DECIMAL(12,0)) * 0.01 AS freight_value
  FROM lineitem),
r_products AS (
  SELECT p_partkey AS product_id,
    CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE p_type END AS product_category_name,
    CASE WHEN p_partkey % 67 = 0 THEN NULL ELSE CAST(p_size * 100 AS DOUBLE) END AS product_weight_g,
    CAST(10 + p_partkey % 40 AS DOUBLE) AS product_length_cm,
    CAST(5 + p_partkey % 20 AS DOUBLE) AS product_height_cm,
    CAST(8 + p_partkey % 30 AS DOUBLE) AS product_width_cm
  FROM part),
r_translation AS (
  SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english
  FROM part WHERE p_type <> 'PROMO'),
r_reviews AS (
  SELECT o_orderkey AS review_id, o_orderkey AS order_id,
    CAST(1 + (o_orderkey * 7 + o_custkey) % 5 AS INT) AS review_score,
    o_orderdate + to_days(CAST(25 + o_orderkey % 5 AS INT)) AS review_answer_timestamp
  FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL
  SELECT o_orderkey + 1000000000, o_orderkey, CAST(1 + (o_orderkey * 3) % 5 AS INT), o_orderdate + to_days(31)
  FROM orders WHERE o_orderkey % 101 = 0),
r_pay_t AS (
  SELECT order_id, CAST(sum(price + freight_value) * 100 AS BIGINT) AS cents FROM r_items GROUP BY order_id),
r_pay_v AS (
  SELECT order_id, cents, CASE WHEN order_id % 17 = 0 THEN cents // 10 ELSE 0 END AS voucher_cents FROM r_pay_t),
r_payments AS (
  SELECT order_id, 1 AS payment_sequential,
    CASE order_id % 4 WHEN 0 THEN 'boleto' WHEN 1 THEN 'debit_card' ELSE 'credit_card' END AS payment_type,
    CAST(1 + order_id % 10 AS INT) AS payment_installments,
    CAST(cents - voucher_cents AS DECIMAL(12,0)) * 0.01 AS payment_value
  FROM r_pay_v
  UNION ALL
  SELECT order_id, 2, 'voucher', 1, CAST(voucher_cents AS DECIMAL(12,0)) * 0.01 FROM r_pay_v WHERE voucher_cents > 0),
r_sellers AS (
  SELECT s_suppkey AS seller_id, n.n_name AS seller_state
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey)
"""


def with_views(body: str, ctes: str = "") -> str:
    """Prefix ``body`` (a SELECT) with the adapter CTEs and optional extra CTEs."""
    extra = f",\n{ctes.strip()}" if ctes.strip() else ""
    return f"WITH {ADAPTER_CTES.strip()}{extra}\n{body.strip()}"


def R(expr: str, d: int) -> str:
    """Oracle twin of ``functions.rnd``: round half-up through DECIMAL(28,8)."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,8)), {d}) AS DOUBLE)"


def P(num: str, den: str, d: int = 1) -> str:
    """Oracle twin of ``functions.pct``."""
    return R(f"100.0 * ({num}) / NULLIF({den}, 0)", d)


def dense_histogram(values: str, bins: int, by: str = "") -> str:
    """Counts of ``x`` of a subquery in equal-width bins between its least and
    greatest value (per group), empty bins included."""
    lead = f"{by}, " if by else ""
    pair = f"USING ({by})" if by else "ON TRUE"
    return f"""
SELECT * FROM (WITH v AS (SELECT * FROM {values} s WHERE x IS NOT NULL),
r AS (SELECT {lead}MIN(CAST(x AS DOUBLE)) AS lo, MAX(CAST(x AS DOUBLE)) AS hi FROM v {f'GROUP BY {by}' if by else 'HAVING COUNT(*) > 0'}),
n AS (
  SELECT {lead}CASE WHEN hi - lo > 0 THEN CAST(LEAST(floor((x - lo) * {bins} / (hi - lo)), {bins - 1}) AS INT) ELSE 0 END AS bin, COUNT(*) AS n
  FROM v JOIN r {pair} GROUP BY ALL),
spine AS (SELECT *, CAST(unnest(range({bins})) AS INT) AS bin FROM r)
SELECT {lead}bin, {R(f'lo + bin * (hi - lo) / {bins}', 4)} AS bin_lo, {R(f'lo + (bin + 1) * (hi - lo) / {bins}', 4)} AS bin_hi, COALESCE(n, 0) AS n
FROM spine LEFT JOIN n USING ({lead}bin)) histogram"""
