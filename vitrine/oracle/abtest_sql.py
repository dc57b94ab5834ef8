"""Oracle SQL for the experiment statistics (statistics in plain SQL; tails of
distributions by Simpson's rule over the density)."""

from vitrine.oracle import R, dense_histogram, with_views

Z975 = "1.959963984540054"
Z80 = "0.8416212335729143"

AB = """ab AS (
  SELECT * FROM (
    SELECT o.order_id, c.customer_unique_id, c.customer_state, CAST(p.payment_value AS DOUBLE) AS payment_value,
      CASE WHEN c.customer_state IN ('NATION_0','NATION_1','NATION_2','NATION_3') THEN 'control'
           WHEN c.customer_state IN ('NATION_4','NATION_5','NATION_6') THEN 'treatment' END AS ab_group
    FROM r_orders o
    LEFT JOIN (SELECT order_id, SUM(payment_value) AS payment_value FROM r_payments GROUP BY 1) p ON o.order_id = p.order_id
    LEFT JOIN r_customers c ON o.customer_id = c.customer_id
    WHERE o.order_status = 'delivered' AND p.payment_value > 0) s
  WHERE ab_group IS NOT NULL),
mo AS (
  SELECT COUNT(*) FILTER (WHERE ab_group = 'control') AS n_c, COUNT(*) FILTER (WHERE ab_group = 'treatment') AS n_t,
    AVG(payment_value) FILTER (WHERE ab_group = 'control') AS m_c, AVG(payment_value) FILTER (WHERE ab_group = 'treatment') AS m_t,
    var_samp(payment_value) FILTER (WHERE ab_group = 'control') AS v_c,
    var_samp(payment_value) FILTER (WHERE ab_group = 'treatment') AS v_t FROM ab),
k AS (
  SELECT COUNT(*) FILTER (WHERE ab_group = 'control' AND payment_value >= 150) AS ca,
    COUNT(*) FILTER (WHERE ab_group = 'control' AND payment_value < 150) AS cb,
    COUNT(*) FILTER (WHERE ab_group = 'treatment' AND payment_value >= 150) AS ta,
    COUNT(*) FILTER (WHERE ab_group = 'treatment' AND payment_value < 150) AS tb FROM ab),
kr AS (SELECT *, ca / (ca + cb) AS p_c, ta / (ta + tb) AS p_t, ca + cb AS n_c, ta + tb AS n_t FROM k)"""


def yates(a: str, b: str, c: str, d: str) -> str:
    n = f"({a} + {b} + {c} + {d})"
    e11, e12 = f"(({a} + {b}) * ({a} + {c}) / {n})", f"(({a} + {b}) * ({b} + {d}) / {n})"
    e21, e22 = f"(({c} + {d}) * ({a} + {c}) / {n})", f"(({c} + {d}) * ({b} + {d}) / {n})"
    adj = f"GREATEST(abs({a} - {e11}) - 0.5, 0.0)"
    return f"({adj} * {adj} * (1 / {e11} + 1 / {e12} + 1 / {e21} + 1 / {e22}))"


def wilson(p: str, n: str) -> tuple[str, str]:
    z2 = f"({Z975} * {Z975})"
    denom = f"(1 + {z2} / {n})"
    center = f"(({p} + {z2} / (2 * {n})) / {denom})"
    half = f"({Z975} * sqrt({p} * (1 - {p}) / {n} + {z2} / (4 * {n} * {n})) / {denom})"
    return f"({center} - {half})", f"({center} + {half})"


_l1, _u1 = wilson("p_t", "n_t")
_l2, _u2 = wilson("p_c", "n_c")
_T = "((m_t - m_c) / sqrt(v_c / n_c + v_t / n_t))"
_DF = "(power(v_c / n_c + v_t / n_t, 2) / (power(v_c / n_c, 2) / (n_c - 1) + power(v_t / n_t, 2) / (n_t - 1)))"
_D = "((m_t - m_c) / sqrt((v_c + v_t) / 2))"

CONV = """cv AS (
  SELECT SUM(conv) FILTER (WHERE ab_group = 'control') AS cc, SUM(conv) FILTER (WHERE ab_group = 'treatment') AS tc
  FROM (SELECT ab_group, COUNT(DISTINCT customer_unique_id) AS conv FROM ab GROUP BY 1) g),
cv2 AS (SELECT cc, tc, CAST(floor(cc * 1.5) AS BIGINT) AS ct, CAST(floor(tc * 1.5) AS BIGINT) AS tt FROM cv)"""

CG = """cg AS (SELECT customer_unique_id, bool_or(ab_group = 'control') AS in_c, bool_or(ab_group = 'treatment') AS in_t
  FROM ab GROUP BY 1)"""

QS = """qs AS (
  SELECT ab_group, quantile_cont(payment_value, 0.25) AS q1, quantile_cont(payment_value, 0.5) AS median,
    quantile_cont(payment_value, 0.75) AS q3 FROM ab GROUP BY 1)"""

RK = """rk AS (
  SELECT payment_value, ab_group,
    rank() OVER (ORDER BY payment_value) + (COUNT(*) OVER (PARTITION BY payment_value) - 1) / 2.0 AS ar FROM ab),
mw AS (
  SELECT SUM(ar) FILTER (WHERE ab_group = 'treatment') AS rs, COUNT(*) FILTER (WHERE ab_group = 'treatment') AS n1,
    COUNT(*) FILTER (WHERE ab_group <> 'treatment') AS n2,
    (SELECT SUM(power(t, 3) - t) FROM (SELECT COUNT(*) AS t FROM ab GROUP BY payment_value) x) AS tie_term FROM rk)"""

_U = "(rs - n1 * (n1 + 1) / 2)"

SQL = {
    "ab_groups": with_views("SELECT * FROM ab", AB),
    "ab_summary": with_views(f"""
SELECT ab_group, COUNT(*) AS count, {R('AVG(payment_value)', 2)} AS mean,
  {R('quantile_cont(payment_value, 0.5)', 2)} AS median, {R('stddev_samp(payment_value)', 2)} AS std,
  {R('MIN(payment_value)', 2)} AS min, {R('MAX(payment_value)', 2)} AS max FROM ab GROUP BY ab_group""", AB),
    "ab_sample_check": with_views(f"""
SELECT ab_group, COUNT(*) AS n,
  CAST(floor(2 * power({Z975} + {Z80}, 2) / power(0.2, 2) + power({Z975}, 2) / 4) AS INT) AS required_n,
  COUNT(*) >= 2 * power({Z975} + {Z80}, 2) / power(0.2, 2) + power({Z975}, 2) / 4 AS sufficient
FROM ab GROUP BY ab_group""", AB),
    "welch_test": with_views(f"""
SELECT n_c, n_t, {R('m_c', 4)} AS mean_control, {R('m_t', 4)} AS mean_treatment, {R('m_t - m_c', 4)} AS mean_diff,
  {R('(m_t / m_c - 1) * 100', 4)} AS lift_pct, {R(_T, 6)} AS t_stat, {R(_DF, 4)} AS welch_df FROM mo""", AB),
    "cohens_d": with_views(f"SELECT {R('sqrt((v_c + v_t) / 2)', 6)} AS pooled_std, {R(_D, 6)} AS cohens_d FROM mo", AB),
    "conversion_chi2": with_views(f"""
SELECT CAST(cc AS BIGINT) AS control_converted, ct AS control_total, CAST(tc AS BIGINT) AS treatment_converted, tt AS treatment_total,
  {R('cc / ct', 6)} AS control_rate, {R('tc / tt', 6)} AS treatment_rate,
  {R('(tc / tt - cc / ct) * 100', 4)} AS lift_pp, {R(yates('CAST(cc AS DOUBLE)', '(ct - cc)', 'tc', '(tt - tc)'), 6)} AS chi2
FROM cv2""", AB + ",\n" + CONV),
    "threshold_chi2": with_views(f"""
SELECT ca AS control_above, cb AS control_below, ta AS treatment_above, tb AS treatment_below,
  {R('ca / (ca + cb)', 6)} AS control_rate, {R('ta / (ta + tb)', 6)} AS treatment_rate,
  {R(yates('CAST(ca AS DOUBLE)', 'cb', 'ta', 'tb'), 6)} AS chi2 FROM k""", AB),
    "cohens_h": with_views(f"""
SELECT {R('2 * (asin(sqrt(p_t)) - asin(sqrt(p_c)))', 6)} AS cohens_h,
  CASE WHEN abs(2 * (asin(sqrt(p_t)) - asin(sqrt(p_c)))) < 0.2 THEN 'SMALL'
       WHEN abs(2 * (asin(sqrt(p_t)) - asin(sqrt(p_c)))) < 0.5 THEN 'MEDIUM' ELSE 'LARGE' END AS effect_size,
  {R('(p_t - p_c) * 100', 4)} AS abs_lift_pp, {R('(p_t / p_c - 1) * 100', 4)} AS rel_lift_pct,
  {R('(p_t - p_c) * 5000', 4)} AS extra_orders_per_month FROM kr""", AB),
    "proportion_diff_ci": with_views(f"""
SELECT {R('p_t - p_c', 6)} AS diff,
  {R(f'p_t - p_c - sqrt(power(p_t - {_l1}, 2) + power({_u2} - p_c, 2))', 6)} AS ci_low,
  {R(f'p_t - p_c + sqrt(power({_u1} - p_t, 2) + power(p_c - {_l2}, 2))', 6)} AS ci_high FROM kr""", AB),
    "effect_size_summary": with_views(f"""
SELECT {R('m_t - m_c', 4)} AS abs_lift, {R('(m_t / m_c - 1) * 100', 4)} AS rel_lift_pct, {R(_D, 6)} AS cohens_d,
  CASE WHEN abs({_D}) < 0.2 THEN 'SMALL' WHEN abs({_D}) < 0.5 THEN 'SMALL-MEDIUM'
       WHEN abs({_D}) < 0.8 THEN 'MEDIUM-LARGE' ELSE 'LARGE' END AS effect_size,
  {R('(m_t - m_c) * 5000', 2)} AS monthly_revenue_impact FROM mo""", AB),
    "group_overlap": with_views("""
SELECT COUNT(*) FILTER (WHERE in_c) AS control_customers, COUNT(*) FILTER (WHERE in_t) AS treatment_customers,
  COUNT(*) FILTER (WHERE in_c AND in_t) AS overlap FROM cg""", AB + ",\n" + CG),
    "remove_group_overlap": with_views("""
SELECT ab.customer_unique_id, order_id, customer_state, payment_value, ab_group FROM ab
WHERE customer_unique_id NOT IN (SELECT customer_unique_id FROM cg WHERE in_c AND in_t)""", AB + ",\n" + CG),
    "group_mean_ci": with_views(f"""
SELECT ab_group, {R('m', 4)} AS mean, {R('sem', 6)} AS sem, {R('m - 1.96 * sem', 4)} AS ci_low,
  {R('m + 1.96 * sem', 4)} AS ci_high
FROM (SELECT ab_group, AVG(payment_value) AS m, stddev_samp(payment_value) / sqrt(COUNT(*)) AS sem FROM ab GROUP BY 1) g""", AB),
    "group_box_stats": with_views(f"""
SELECT ab.ab_group, {R('ANY_VALUE(q1)', 4)} AS q1, {R('ANY_VALUE(median)', 4)} AS median, {R('ANY_VALUE(q3)', 4)} AS q3,
  {R('MIN(payment_value) FILTER (WHERE payment_value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 4)} AS whisker_low,
  {R('MAX(payment_value) FILTER (WHERE payment_value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))', 4)} AS whisker_high,
  COUNT(*) FILTER (WHERE NOT (payment_value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
FROM ab JOIN qs ON ab.ab_group = qs.ab_group GROUP BY ab.ab_group""", AB + ",\n" + QS),
    "aov_histogram": with_views(dense_histogram("(SELECT ab_group, payment_value AS x FROM ab)", 50, "ab_group"), AB),
    "mann_whitney": with_views(f"""
SELECT n1 AS n_treatment, n2 AS n_control, {R(_U, 2)} AS u_stat,
  {R(f'({_U} - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1))))', 6)} AS z
FROM mw""", AB + ",\n" + RK),
}



def simpson(a: str, b: str, f: str, n: int = 8000) -> str:
    """Integral from a to b of ``f`` (an expression in {x}) over n steps."""
    x = f"({a} + ({b} - {a}) * j / {n})"
    weight = f"CASE WHEN j = 0 OR j = {n} THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({b} - {a}) / {3 * n} * list_sum(list_transform(range({n + 1}), lambda j: {weight} * {f.replace('{x}', x)})))"


def t_tail(t: str, df: str) -> str:
    """P(|T| > t) from the density itself, for many degrees of freedom: both
    integrals end 12 standard deviations behind where they start."""
    dens = "power(1 + {x} * {x} / DF, -(DF + 1) / 2)".replace("DF", df)
    return f"({simpson(t, f'({t} + 12.0)', dens)} / {simpson('0.0', '12.0', dens)})"


def normal_tail(z: str) -> str:
    return f"({simpson(z, f'({z} + 12.0)', 'exp(-{x} * {x} / 2)')} / sqrt(pi() / 2))"


_TESTS = f"""w AS (SELECT abs({_T}) AS t, {_T} AS stat, {_DF} AS df FROM mo),
chi AS (SELECT {yates('CAST(ca AS DOUBLE)', 'cb', 'ta', 'tb')} AS thr FROM k),
conv AS (SELECT {R(yates('CAST(cc AS DOUBLE)', '(ct - cc)', 'tc', '(tt - tc)'), 6)} AS chi2 FROM cv2),
zs AS (SELECT ({_U} - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie_term / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM mw),
tests AS (
  SELECT 'aov_welch_t' AS test, {R('stat', 6)} AS statistic, {R(t_tail('t', 'df'), 8)} AS p_value FROM w
  UNION ALL SELECT 'threshold_chi2', {R('thr', 6)}, {R(normal_tail('sqrt(thr)'), 8)} FROM chi
  UNION ALL SELECT 'conversion_chi2', {R('chi2', 6)}, {R(normal_tail('sqrt(chi2)'), 8)} FROM conv
  UNION ALL SELECT 'aov_mann_whitney', {R('z', 6)}, {R(normal_tail('abs(z)'), 8)} FROM zs)"""
_TEST_VIEWS = ",\n".join([AB, CONV, RK, _TESTS])

SQL["ab_pvalues"] = with_views("SELECT * FROM tests", _TEST_VIEWS)
SQL["bonferroni"] = with_views("""
SELECT test, p_value, count(*) OVER () AS m, 0.05::DOUBLE / count(*) OVER () AS bonferroni_alpha,
  p_value < 0.05::DOUBLE / count(*) OVER () AS significant FROM tests""", _TEST_VIEWS)
# the quantile by halving a bracket until nothing is left of it
SQL["mean_diff_ci"] = with_views(f"""
SELECT {R('diff', 4)} AS mean_diff, {R('diff - q * se', 4)} AS ci_low, {R('diff + q * se', 4)} AS ci_high
FROM wd, (SELECT lo AS q FROM halved ORDER BY i DESC LIMIT 1) x""", AB + f""",
wd AS MATERIALIZED (SELECT m_t - m_c AS diff, sqrt(v_c / n_c + v_t / n_t) AS se, {_DF} AS df FROM mo),
halved AS (
  WITH RECURSIVE h AS (
    SELECT 0 AS i, 0.0::DOUBLE AS lo, 12.0::DOUBLE AS hi, df FROM wd
    UNION ALL
    SELECT i + 1, CASE WHEN p > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE (lo + hi) / 2 END, df
    FROM (SELECT *, {t_tail('((lo + hi) / 2)', 'df')} AS p FROM h WHERE i < 45) s)
  SELECT * FROM h)""")

_AB_ROWS = AB.split("mo AS (")[0].rstrip().rstrip(",").replace(
    "LEFT JOIN (SELECT order_id, SUM(payment_value) AS payment_value FROM r_payments GROUP BY 1) p",
    "LEFT JOIN r_payments p")
SQL["ab_summary_payment_rows"] = SQL["ab_summary"].replace(AB.strip(), _AB_ROWS.strip())
