"""Distribution functions and test statistics against textbook values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions.stats import (
    Z_80,
    Z_975,
    betainc,
    chi2_sf_1df,
    normal_sf_two_sided,
    t_ppf,
    t_sf_two_sided,
    yates_chi2,
)


def test_student_t_tails():
    assert abs(t_sf_two_sided(2.0, 10)[()] - 0.0733880347707) < 1e-9
    assert abs(t_sf_two_sided(2.228138851986274, 10)[()] - 0.05) < 1e-9
    assert abs(t_sf_two_sided(0.0, 5)[()] - 1.0) < 1e-12
    assert abs(t_sf_two_sided(1.959963984540054, 1e7)[()] - 0.05) < 1e-5


def test_t_quantile():
    assert abs(t_ppf(0.975, 10)[()] - 2.228138851986274) < 1e-8
    assert abs(t_ppf(0.975, 30)[()] - 2.042272456301238) < 1e-8


def test_betainc_symmetry():
    x = np.array([0.1, 0.5, 0.9])
    assert np.allclose(betainc(2.5, 3.5, x) + betainc(3.5, 2.5, 1 - x), 1.0)


def test_chi2_and_normal_tails():
    assert abs(chi2_sf_1df([3.841458820694124])[0] - 0.05) < 1e-12
    assert abs(normal_sf_two_sided([Z_975])[0] - 0.05) < 1e-12
    assert abs(normal_sf_two_sided([-Z_80])[0] * 0.5 - 0.2) < 1e-9


def test_yates_chi2(spark):
    df = spark.createDataFrame([(10, 20, 30, 40)], "a long, b long, c long, d long")
    v = df.select(yates_chi2(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert abs(v - 0.44642857142857) < 1e-9


def test_required_sample_size():
    need = 2 * (Z_975 + Z_80) ** 2 / 0.2 ** 2 + Z_975 ** 2 / 4
    assert int(need) == 393


def test_newcombe_interval(spark):
    from vitrine.operators.abtest import _wilson

    df = spark.createDataFrame([(56, 70, 48, 80)], "x1 long, n1 long, x2 long, n2 long")
    p1, p2 = F.col("x1") / F.col("n1"), F.col("x2") / F.col("n2")
    l1, u1 = _wilson(p1, F.col("n1"), Z_975)
    l2, u2 = _wilson(p2, F.col("n2"), Z_975)
    d = p1 - p2
    r = df.select((d - F.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2)).alias("lo"),
                  (d + F.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)).alias("hi")).first()
    # Newcombe (1998), example (56/70 vs 48/80), method 10
    assert abs(r.lo - 0.0524) < 5e-5 and abs(r.hi - 0.3339) < 5e-5


@pytest.mark.parametrize("t,df", [(1.5, 4.0), (-3.2, 17.5), (0.3, 200.0)])
def test_t_tail_matches_integral(t, df):
    # numeric check of the Student-t density integral
    xs = np.linspace(abs(t), 400, 400001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    dens = c * (1 + xs ** 2 / df) ** (-(df + 1) / 2)
    tail = 2 * np.trapezoid(dens, xs)
    assert abs(t_sf_two_sided(t, df)[()] - tail) < 1e-5


def test_column_forms_agree_with_the_other_methods(spark):
    """Quadrature in the JVM against the incomplete beta function, erfc and
    bisection, from one degree of freedom to a million."""
    from vitrine.functions.stats import chi2_p, normal_p, t_quantile, t_test_p

    rows = [(t, df) for t in (0.0, 0.3, -1.7, 2.5, 8.0) for df in (1.0, 1.4, 2.0, 3.5, 10.0, 250.0, 1e4, 1e6)]
    frame = spark.createDataFrame(rows, "t double, df double")
    for r in frame.select("*", t_test_p(F.col("t"), F.col("df")).alias("p"), normal_p(F.col("t")).alias("n"), chi2_p(F.col("t") ** 2).alias("c")).collect():
        want = float(t_sf_two_sided(r["t"], r["df"]))
        assert abs(r["p"] - want) < 1e-9 and abs(r["p"] - want) < 1e-6 * want + 1e-300, r
        assert abs(r["n"] - normal_sf_two_sided([r["t"]])[0]) < 1e-11 and abs(r["c"] - r["n"]) < 1e-12
    for q in (0.975, 0.5, 0.1, 0.9999):
        for r in frame.select("df").distinct().select("df", t_quantile(q, F.col("df")).alias("x")).collect():
            want = float(t_ppf(q, r["df"]))
            assert abs(r["x"] - want) < 1e-7 * max(1.0, abs(want)), (q, r)
