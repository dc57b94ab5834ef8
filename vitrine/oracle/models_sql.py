"""Oracle SQL of the model metrics, stated over the scorecard and the naive
forecast (the fitted models themselves have none)."""

from vitrine.operators.models import CLV_TIERS
from vitrine.oracle import R, with_views
from vitrine.oracle.ml_sql import CLV, CT, strat

CARD = CT + ",\n" + strat("enc", "churned", "customer_unique_id", "cs") + """,
card0 AS (SELECT customer_unique_id, churned, split, CAST(1000 - 10 * frequency - n_items_total AS BIGINT) AS score FROM cs),
card AS (SELECT *, CAST(score >= (SELECT AVG(score) FROM card0 WHERE split = 'train') AS INT) AS predicted
  FROM card0 WHERE split = 'test')"""

NAIVE = CLV + """,
naive AS (
  SELECT customer_unique_id, CAST(round(future_spend * 100) AS DOUBLE) AS y, CAST(round(total_spend_early * 100) AS DOUBLE) AS x,
    CASE WHEN row_number() OVER (ORDER BY (customer_unique_id * 48271) % 2147483647, customer_unique_id)
      <= ceil(COUNT(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM clv),
tiered AS (
  SELECT *, CASE WHEN x <= (SELECT quantile_cont(x, 0.25) FROM naive) THEN 'Low CLV'
    WHEN x <= (SELECT quantile_cont(x, 0.75) FROM naive) THEN 'Medium CLV' ELSE 'High CLV' END AS clv_tier FROM naive)"""

_STRATEGY = "CASE clv_tier " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CLV_TIERS) + " END"


def _report(label: int) -> str:
    tp = f"COUNT(*) FILTER (WHERE churned = {label} AND predicted = {label})"
    said = f"COUNT(*) FILTER (WHERE predicted = {label})"
    real = f"COUNT(*) FILTER (WHERE churned = {label})"
    cells = ", ".join(f"COUNT(*) FILTER (WHERE churned = {c} AND predicted = {p}) AS {n}"
                      for n, c, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))
    return f"""SELECT {label} AS label, {cells}, {R(f'COALESCE({tp} / NULLIF({said}, 0), 0)', 6)} AS precision,
  {R(f'COALESCE({tp} / NULLIF({real}, 0), 0)', 6)} AS recall,
  {R(f'COALESCE(CASE WHEN {tp} > 0 THEN 2.0 * {tp} / ({said} + {real}) END, 0)', 6)} AS f1, {real} AS support FROM card"""


SQL = {
    "scorecard_roc_curve": with_views(f"""
SELECT DISTINCT score AS threshold,
  {R('COUNT(*) FILTER (WHERE churned <> 1) OVER w / COUNT(*) FILTER (WHERE churned <> 1) OVER ()', 6)} AS fpr,
  {R('COUNT(*) FILTER (WHERE churned = 1) OVER w / COUNT(*) FILTER (WHERE churned = 1) OVER ()', 6)} AS tpr
FROM card WINDOW w AS (ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", CARD),
    "scorecard_auc": with_views(f"""
SELECT {R('SUM(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END * a.n * b.n) / SUM(a.n * b.n)', 6)} AS auc
FROM (SELECT score, COUNT(*) AS n FROM card WHERE churned = 1 GROUP BY 1) a,
  (SELECT score, COUNT(*) AS n FROM card WHERE churned = 0 GROUP BY 1) b""", CARD),
    "scorecard_confusion": with_views(_report(1) + "\nUNION ALL\n" + _report(0), CARD),
    "baseline_regression_report": with_views(f"""
SELECT {R('AVG(abs(y - x))', 6)} AS mae, {R('sqrt(AVG((y - x) * (y - x)))', 6)} AS rmse,
  {R('1 - SUM((y - x) * (y - x)) / SUM((y - m) * (y - m))', 6)} AS r2
FROM naive, (SELECT AVG(y) AS m FROM naive WHERE split = 'test') mean WHERE split = 'test'""", NAIVE),
    "baseline_clv_tiers": with_views("SELECT customer_unique_id, x AS predicted_clv, clv_tier FROM tiered", NAIVE),
    "baseline_clv_tier_summary": with_views(f"""
SELECT clv_tier, COUNT(*) AS customers, {R('AVG(x)', 2)} AS avg_predicted_clv, {R('SUM(x)', 2)} AS total_predicted,
  {R('AVG(x)', 2)} AS avg_historical_spend, {_STRATEGY} AS recommended_strategy FROM tiered GROUP BY clv_tier""", NAIVE),
}
