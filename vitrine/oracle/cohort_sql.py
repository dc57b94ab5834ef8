"""Oracle SQL for the cohort operators, from the definition: who bought in
which month, how many months after their first, counted once per customer."""

from vitrine.oracle import P, R, with_views

MONTHS = range(1, 7)


def _counts(excluded: str = "canceled") -> str:
    """``counts``: customers by first month and distance, one column each."""
    later = ", ".join(f"count(*) FILTER (gap = {k}) AS month_{k}" for k in MONTHS)
    return f"""bought AS (
  SELECT DISTINCT customer_unique_id AS who, date_trunc('month', order_purchase_timestamp) AS mon
  FROM r_orders JOIN r_customers USING (customer_id)
  WHERE order_status <> '{excluded}' AND order_status <> 'unavailable'),
aged AS (
  SELECT who, min(mon) OVER (PARTITION BY who) AS born, datediff('month', min(mon) OVER (PARTITION BY who), mon) AS gap
  FROM bought),
counts AS (
  SELECT strftime(born, '%Y%m') AS cohort_month, count(*) FILTER (gap = 0) AS cohort_size, {later}
  FROM aged GROUP BY born)"""


SQL = {
    "customer_cohort": with_views(
        "SELECT who AS customer_unique_id, strftime(min(mon), '%Y-%m') AS cohort_month FROM bought GROUP BY who", _counts()),
    "cohort_retention": with_views("FROM counts", _counts()),
    "cohort_retention_pct": with_views(
        "SELECT cohort_month, cohort_size, " + ", ".join(f"{P(f'month_{k}', 'cohort_size')} AS pct_month_{k}" for k in MONTHS) + " FROM counts", _counts()),
    "retention_matrix": with_views(
        "SELECT cohort_month, " + ", ".join(f"{R(f'CAST(month_{k} AS DOUBLE) / cohort_size', 6)} AS rate_month_{k}" for k in MONTHS) + " FROM counts", _counts()),
    "cohort_revenue": with_views(f"""
SELECT strftime(born, '%Y-%m') AS cohort_month, count(*) AS cohort_size, {R('sum(spent)', 2)} AS total_revenue,
  {R('sum(spent) / count(*)', 2)} AS revenue_per_customer
FROM (SELECT who, min(mon) AS born FROM bought GROUP BY who)
JOIN (SELECT customer_unique_id AS who, sum(price) AS spent
      FROM r_items JOIN r_orders USING (order_id) JOIN r_customers USING (customer_id)
      WHERE order_status <> 'canceled' AND order_status <> 'unavailable' GROUP BY 1) USING (who)
GROUP BY born""", _counts()),
    "cohort_retention_as_written": with_views("FROM counts", _counts("cancelled")),
}
