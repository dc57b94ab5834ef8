"""Experiment statistics (AB1-AB18).

Spark reduces the data to per-group moments, counts and ranks (partial
aggregation; no group is gathered in one task); the statistics are column
arithmetic on those few rows, and so are p-values and t quantiles
(``functions.stats``).

Groups are regions (``control``/``treatment`` state lists). The unit is the
order (payments summed per order) by default; ``unit='payment_row'`` keeps
one row per payment as the original notebook did.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import rnd
from vitrine.functions.stats import Z_80, Z_975, chi2_p, normal_p, t_quantile, t_test_p, yates_chi2
from vitrine.operators.profit import TEST_GROUPS, equal_width_histogram
from vitrine.plans.ranking import grouped_quantiles, rank_sum
from vitrine.sources.tables import RetailTables

QUERIES = ("ab_groups", "ab_summary", "ab_sample_check", "welch_test", "cohens_d", "mean_diff_ci",
           "conversion_chi2", "threshold_chi2", "cohens_h", "proportion_diff_ci", "bonferroni",
           "effect_size_summary", "group_overlap", "remove_group_overlap", "group_mean_ci",
           "group_box_stats", "aov_histogram", "mann_whitney", "ab_pvalues", "ab_summary_payment_rows")

CTRL, TRT = "control", "treatment"


def _x():
    return F.col("payment_value")


def ab_frame(t: RetailTables, control=TEST_GROUPS["control"], treatment=TEST_GROUPS["treatment"],
             unit: str = "order") -> DataFrame:
    """Delivered orders with a positive payment, labelled by region group;
    rows outside both groups are dropped."""
    pay = t.payments
    if unit == "order":
        pay = pay.groupBy("order_id").agg(F.sum("payment_value").alias("payment_value"))
    elif unit != "payment_row":
        raise ValueError(f"unit must be 'order' or 'payment_row', not {unit!r}")
    df = (t.orders.select("order_id", "customer_id", "order_status")
          .join(pay.select("order_id", *(["payment_sequential"] if unit == "payment_row" else []),
                           "payment_value"), "order_id", "left")
          .join(t.customers, "customer_id", "left")
          .where((F.col("order_status") == "delivered") & (_x() > 0)))
    state = F.col("customer_state")
    grp = F.when(state.isin(*control), F.lit(CTRL)).when(state.isin(*treatment), F.lit(TRT))
    extra = ["payment_sequential"] if unit == "payment_row" else []
    return (df.withColumn("ab_group", grp).where(F.col("ab_group").isNotNull())
            .select("order_id", *extra, "customer_unique_id", "customer_state",
                    _x().cast("double").alias("payment_value"), "ab_group"))


def ab_groups(t: RetailTables) -> DataFrame:
    """AB1: the labelled rows of both groups."""
    return ab_frame(t)


def _moments(df: DataFrame) -> DataFrame:
    """One row, both groups side by side: n, mean, sample variance."""
    c, tr = F.col("ab_group") == CTRL, F.col("ab_group") == TRT
    return df.agg(
        F.count_if(c).alias("n_c"), F.count_if(tr).alias("n_t"),
        F.avg(F.when(c, _x())).alias("m_c"), F.avg(F.when(tr, _x())).alias("m_t"),
        F.var_samp(F.when(c, _x())).alias("v_c"), F.var_samp(F.when(tr, _x())).alias("v_t"))


def ab_summary(t: RetailTables, unit: str = "order") -> DataFrame:
    """AB2: count, mean, median, std, min and max per group."""
    df = ab_frame(t, unit=unit)
    tie = ["order_id"] if unit == "order" else ["order_id", "payment_sequential"]
    med = grouped_quantiles(df, "payment_value", [0.5], ["ab_group"], tie).select("ab_group", "q")
    g = df.groupBy("ab_group").agg(
        F.count(F.lit(1)).alias("count"), F.avg(_x()).alias("_mean"), F.stddev_samp(_x()).alias("_std"),
        F.min(_x()).alias("_min"), F.max(_x()).alias("_max"))
    return g.join(med, "ab_group").select(
        "ab_group", "count", rnd("_mean", 2).alias("mean"), rnd("q", 2).alias("median"),
        rnd("_std", 2).alias("std"), rnd("_min", 2).alias("min"), rnd("_max", 2).alias("max"))


def ab_sample_check(t: RetailTables, effect_size: float = 0.2) -> DataFrame:
    """AB3: actual size of each group against the size a two-sided test at
    alpha 0.05 with power 0.8 needs to detect ``effect_size``: the normal
    formula 2(z_a + z_b)^2 / d^2 plus Guenther's z_a^2 / 4 t-correction."""
    need = 2 * (Z_975 + Z_80) ** 2 / effect_size ** 2 + Z_975 ** 2 / 4
    g = ab_frame(t).groupBy("ab_group").agg(F.count(F.lit(1)).alias("n"))
    return g.select("ab_group", "n", F.lit(int(need)).alias("required_n"),
                    (F.col("n") >= F.lit(need)).alias("sufficient"))


def _welch(m: DataFrame) -> DataFrame:
    se2_c, se2_t = F.col("v_c") / F.col("n_c"), F.col("v_t") / F.col("n_t")
    return m.select(
        "*", ((F.col("m_t") - F.col("m_c")) / F.sqrt(se2_c + se2_t)).alias("_t"),
        ((se2_c + se2_t) ** 2 / (se2_c ** 2 / (F.col("n_c") - 1) + se2_t ** 2 / (F.col("n_t") - 1))).alias("_df"),
        ((F.col("m_t") - F.col("m_c")) / F.sqrt((F.col("v_c") + F.col("v_t")) / 2)).alias("_d"))


def welch_test(t: RetailTables) -> DataFrame:
    """AB4: Welch's t statistic and degrees of freedom, mean difference and
    relative lift (p-value: ``ab_pvalues``)."""
    w = _welch(_moments(ab_frame(t)))
    return w.select("n_c", "n_t", rnd("m_c", 4).alias("mean_control"), rnd("m_t", 4).alias("mean_treatment"),
                    rnd(F.col("m_t") - F.col("m_c"), 4).alias("mean_diff"),
                    rnd((F.col("m_t") / F.col("m_c") - 1) * 100, 4).alias("lift_pct"),
                    rnd("_t", 6).alias("t_stat"), rnd("_df", 4).alias("welch_df"))


def cohens_d(t: RetailTables) -> DataFrame:
    """AB5: (mean_t - mean_c) / sqrt((s_c^2 + s_t^2) / 2)."""
    w = _welch(_moments(ab_frame(t)))
    return w.select(rnd(F.sqrt((F.col("v_c") + F.col("v_t")) / 2), 6).alias("pooled_std"),
                    rnd("_d", 6).alias("cohens_d"))


def mean_diff_ci(t: RetailTables, level: float = 0.95) -> DataFrame:
    """AB6: Welch confidence interval of mean(treatment) - mean(control)."""
    w = _welch(_moments(ab_frame(t)))
    q = t_quantile(1 - (1 - level) / 2, F.col("_df"))
    se = F.sqrt(F.col("v_c") / F.col("n_c") + F.col("v_t") / F.col("n_t"))
    diff = F.col("m_t") - F.col("m_c")
    return w.select(rnd(diff, 4).alias("mean_diff"), rnd(diff - q * se, 4).alias("ci_low"),
                    rnd(diff + q * se, 4).alias("ci_high"))


def _chi2_frame(a, b, c, d) -> list[Column]:
    chi2 = yates_chi2(F.col(a), F.col(b), F.col(c), F.col(d))
    return [rnd(chi2, 6).alias("chi2")]


def conversion_chi2(t: RetailTables, exposure_factor: float = 1.5) -> DataFrame:
    """AB7: distinct buyers per group against an assumed audience of
    ``exposure_factor`` x buyers (the assumption the workload later withdrew),
    2x2 chi-square with Yates' correction."""
    df = ab_frame(t)
    per = df.groupBy("ab_group").agg(F.count_distinct("customer_unique_id").alias("conv"))
    piv = per.agg(F.sum(F.when(F.col("ab_group") == CTRL, F.col("conv"))).alias("cc"),
                  F.sum(F.when(F.col("ab_group") == TRT, F.col("conv"))).alias("tc"))
    piv = piv.select("cc", "tc", F.floor(F.col("cc") * exposure_factor).cast("bigint").alias("ct"),
                     F.floor(F.col("tc") * exposure_factor).cast("bigint").alias("tt"))
    piv = piv.select("*", (F.col("ct") - F.col("cc")).alias("cn"), (F.col("tt") - F.col("tc")).alias("tn"))
    return piv.select(
        F.col("cc").alias("control_converted"), F.col("ct").alias("control_total"),
        F.col("tc").alias("treatment_converted"), F.col("tt").alias("treatment_total"),
        rnd(F.col("cc") / F.col("ct"), 6).alias("control_rate"),
        rnd(F.col("tc") / F.col("tt"), 6).alias("treatment_rate"),
        rnd((F.col("tc") / F.col("tt") - F.col("cc") / F.col("ct")) * 100, 4).alias("lift_pp"),
        *_chi2_frame("cc", "cn", "tc", "tn"))


def _threshold_counts(t: RetailTables, threshold) -> DataFrame:
    df = ab_frame(t)
    c, tr, up = F.col("ab_group") == CTRL, F.col("ab_group") == TRT, _x() >= threshold
    return df.agg(F.count_if(c & up).alias("ca"), F.count_if(c & ~up).alias("cb"),
                  F.count_if(tr & up).alias("ta"), F.count_if(tr & ~up).alias("tb"))


def threshold_chi2(t: RetailTables, threshold: int = 150) -> DataFrame:
    """AB8: share of orders at or above ``threshold`` per group, chi-square
    with Yates' correction."""
    k = _threshold_counts(t, threshold)
    return k.select(
        F.col("ca").alias("control_above"), F.col("cb").alias("control_below"),
        F.col("ta").alias("treatment_above"), F.col("tb").alias("treatment_below"),
        rnd(F.col("ca") / (F.col("ca") + F.col("cb")), 6).alias("control_rate"),
        rnd(F.col("ta") / (F.col("ta") + F.col("tb")), 6).alias("treatment_rate"),
        *_chi2_frame("ca", "cb", "ta", "tb"))


def _rates(k: DataFrame) -> DataFrame:
    return k.select("*", (F.col("ca") / (F.col("ca") + F.col("cb"))).alias("p_c"),
                    (F.col("ta") / (F.col("ta") + F.col("tb"))).alias("p_t"),
                    (F.col("ca") + F.col("cb")).alias("n_c"), (F.col("ta") + F.col("tb")).alias("n_t"))


def cohens_h(t: RetailTables, threshold: int = 150, monthly_orders: int = 5000) -> DataFrame:
    """AB9: Cohen's h of the two rates, its size label, and the extra
    high-value orders per ``monthly_orders``."""
    r = _rates(_threshold_counts(t, threshold))
    h = 2 * (F.asin(F.sqrt("p_t")) - F.asin(F.sqrt("p_c")))
    label = (F.when(F.abs(h) < 0.2, "SMALL").when(F.abs(h) < 0.5, "MEDIUM").otherwise("LARGE"))
    return r.select(rnd(h, 6).alias("cohens_h"), label.alias("effect_size"),
                    rnd((F.col("p_t") - F.col("p_c")) * 100, 4).alias("abs_lift_pp"),
                    rnd((F.col("p_t") / F.col("p_c") - 1) * 100, 4).alias("rel_lift_pct"),
                    rnd((F.col("p_t") - F.col("p_c")) * monthly_orders, 4).alias("extra_orders_per_month"))


def _wilson(p: Column, n: Column, z: float):
    z2 = z * z
    denom = 1 + z2 / n
    center = (p + z2 / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / denom
    return center - half, center + half


def proportion_diff_ci(t: RetailTables, threshold: int = 150, z: float = Z_975) -> DataFrame:
    """AB10: Newcombe's hybrid-score interval for p_t - p_c (95%)."""
    r = _rates(_threshold_counts(t, threshold))
    pt, pc = F.col("p_t"), F.col("p_c")
    l1, u1 = _wilson(pt, F.col("n_t"), z)
    l2, u2 = _wilson(pc, F.col("n_c"), z)
    d = pt - pc
    return r.select(rnd(d, 6).alias("diff"),
                    rnd(d - F.sqrt((pt - l1) ** 2 + (u2 - pc) ** 2), 6).alias("ci_low"),
                    rnd(d + F.sqrt((u1 - pt) ** 2 + (pc - l2) ** 2), 6).alias("ci_high"))


def ab_pvalues(t: RetailTables) -> DataFrame:
    """UD4: the tests of the experiment with their p-values: Welch's t on
    order value, the threshold chi-square, the conversion chi-square and the
    Mann-Whitney U (normal approximation). One row per test."""
    w = _welch(_moments(ab_frame(t)))
    welch = w.select(F.lit("aov_welch_t").alias("test"), F.col("_t").alias("statistic"),
                     t_test_p(F.col("_t"), F.col("_df")).alias("p_value"))
    k = _threshold_counts(t, 150)
    thr = k.select(F.lit("threshold_chi2").alias("test"),
                   yates_chi2(F.col("ca"), F.col("cb"), F.col("ta"), F.col("tb")).alias("statistic"))
    thr = thr.withColumn("p_value", chi2_p(F.col("statistic")))
    conv = conversion_chi2(t).select(F.lit("conversion_chi2").alias("test"), F.col("chi2").alias("statistic"))
    conv = conv.withColumn("p_value", chi2_p(F.col("statistic")))
    mw = _mann_whitney(t).select(F.lit("aov_mann_whitney").alias("test"), F.col("z").alias("statistic"),
                                 normal_p(F.col("z")).alias("p_value"))
    return reduce(DataFrame.unionByName, [welch, thr, conv, mw]).select(
        "test", rnd("statistic", 6).alias("statistic"), rnd("p_value", 8).alias("p_value"))


def bonferroni(t: RetailTables, alpha: float = 0.05, tests: DataFrame | None = None) -> DataFrame:
    """AB11: Bonferroni threshold alpha/m over a test-result frame
    (``test``, ``p_value``); m is the number of tests in the frame."""
    tests = tests if tests is not None else ab_pvalues(t)
    m = tests.agg(F.count(F.lit(1)).alias("m"))
    return tests.crossJoin(F.broadcast(m)).select(
        "test", "p_value", "m", (F.lit(alpha) / F.col("m")).alias("bonferroni_alpha"),
        (F.col("p_value") < F.lit(alpha) / F.col("m")).alias("significant"))


def effect_size_summary(t: RetailTables, monthly_orders: int = 5000) -> DataFrame:
    """AB12: absolute and relative lift, Cohen's d with its size label, and
    the monthly revenue impact."""
    w = _welch(_moments(ab_frame(t)))
    d = F.abs(F.col("_d"))
    label = (F.when(d < 0.2, "SMALL").when(d < 0.5, "SMALL-MEDIUM").when(d < 0.8, "MEDIUM-LARGE")
             .otherwise("LARGE"))
    lift = F.col("m_t") - F.col("m_c")
    return w.select(rnd(lift, 4).alias("abs_lift"), rnd((F.col("m_t") / F.col("m_c") - 1) * 100, 4).alias("rel_lift_pct"),
                    rnd("_d", 6).alias("cohens_d"), label.alias("effect_size"),
                    rnd(lift * monthly_orders, 2).alias("monthly_revenue_impact"))


def _customer_groups(df: DataFrame) -> DataFrame:
    return df.groupBy("customer_unique_id").agg(
        F.bool_or(F.col("ab_group") == CTRL).alias("in_c"), F.bool_or(F.col("ab_group") == TRT).alias("in_t"))


def group_overlap(t: RetailTables) -> DataFrame:
    """AB13: distinct customers per group and how many are in both."""
    g = _customer_groups(ab_frame(t))
    return g.agg(F.count_if("in_c").alias("control_customers"), F.count_if("in_t").alias("treatment_customers"),
                 F.count_if(F.col("in_c") & F.col("in_t")).alias("overlap"))


def remove_group_overlap(t: RetailTables) -> DataFrame:
    """AB14: both groups without the customers that appear in both."""
    df = ab_frame(t)
    both = _customer_groups(df).where(F.col("in_c") & F.col("in_t")).select("customer_unique_id")
    return df.join(both, "customer_unique_id", "left_anti")


def group_mean_ci(t: RetailTables) -> DataFrame:
    """AB15: mean ± 1.96 standard errors per group (error-bar data)."""
    g = ab_frame(t).groupBy("ab_group").agg(F.avg(_x()).alias("_m"),
                                            (F.stddev_samp(_x()) / F.sqrt(F.count(F.lit(1)))).alias("_sem"))
    return g.select("ab_group", rnd("_m", 4).alias("mean"), rnd("_sem", 6).alias("sem"),
                    rnd(F.col("_m") - 1.96 * F.col("_sem"), 4).alias("ci_low"),
                    rnd(F.col("_m") + 1.96 * F.col("_sem"), 4).alias("ci_high"))


def group_box_stats(t: RetailTables) -> DataFrame:
    """AB16: quartiles, whiskers (most extreme values within 1.5 IQR) and
    outlier counts per group (box-plot data)."""
    df = ab_frame(t)
    q = grouped_quantiles(df, "payment_value", [0.25, 0.5, 0.75], ["ab_group"], ["order_id"])
    qs = q.groupBy("ab_group").agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(n)
                                     for i, n in enumerate(["q1", "median", "q3"])])
    iqr = F.col("q3") - F.col("q1")
    qs = qs.select("*", (F.col("q1") - 1.5 * iqr).alias("_lf"), (F.col("q3") + 1.5 * iqr).alias("_uf"))
    inside = (_x() >= F.col("_lf")) & (_x() <= F.col("_uf"))
    w = df.join(F.broadcast(qs), "ab_group").groupBy("ab_group", "q1", "median", "q3").agg(
        F.min(F.when(inside, _x())).alias("whisker_low"), F.max(F.when(inside, _x())).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
    return w.select("ab_group", rnd("q1", 4).alias("q1"), rnd("median", 4).alias("median"),
                    rnd("q3", 4).alias("q3"), rnd("whisker_low", 4).alias("whisker_low"),
                    rnd("whisker_high", 4).alias("whisker_high"), "outliers")


def aov_histogram(t: RetailTables, bins: int = 50) -> DataFrame:
    """AB17: 50 equal-width bins of order value per group."""
    return equal_width_histogram(ab_frame(t), _x(), bins, by=["ab_group"])


def _mann_whitney(t: RetailTables) -> DataFrame:
    df = ab_frame(t)
    rs = rank_sum(df, "payment_value", F.col("ab_group") == TRT, ["order_id"])
    n1, n2 = F.col("n1"), F.col("n2")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    n = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    return rs.select("n1", "n2", u.alias("u"), ((u - n1 * n2 / 2.0) / sigma).alias("z"))


def mann_whitney(t: RetailTables) -> DataFrame:
    """AB18: Mann-Whitney U of treatment against control (average ranks for
    ties) and its tie-corrected normal z (p-value in ``ab_pvalues``)."""
    return _mann_whitney(t).select(F.col("n1").alias("n_treatment"), F.col("n2").alias("n_control"),
                                   rnd("u", 2).alias("u_stat"), rnd("z", 6).alias("z"))


def ab_summary_payment_rows(t: RetailTables) -> DataFrame:
    """AB2 over one row per payment, the unit of the original notebook."""
    return ab_summary(t, unit="payment_row")
