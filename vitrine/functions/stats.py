"""Distribution functions for test statistics.

Spark has no Student-t / chi-square / normal CDFs. The column forms
(``t_test_p``, ``t_quantile``, ``chi2_p``, ``normal_p``) integrate the
densities with a fixed number of nodes inside ``aggregate``, so they stay in
the JVM and any SQL engine can state the same sum. They run on one row per
test after Spark has reduced the data to moments and counts. The numpy forms
next to them use other methods (the regularised incomplete beta function,
``erfc``, bisection) and serve driver-side code and as a check.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_DEEPEST = 1 << 17


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log B(a, b). For a large argument the difference of two huge
    log-gammas would lose all digits; it is taken from Stirling's series."""
    big, small = np.maximum(a, b), np.minimum(a, b)
    lg = np.vectorize(math.lgamma, otypes=[float])

    def tail(z):
        return 1 / (12 * z) - 1 / (360 * z**3)

    drop = (big - 0.5) * np.log1p(small / big) + small * np.log(big + small) - small + tail(big + small) - tail(big)
    return np.where(big > 1e3, lg(small) - drop, lg(a) + lg(b) - lg(np.minimum(a + b, 1e300)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """1 / (1 + c1 / (1 + c2 / (1 + ...))) of the incomplete beta function,
    from the inside out; the depth doubles until two values agree."""
    last, depth = None, 64
    while depth <= _DEEPEST:
        value = np.ones_like(x)
        for n in range(depth, 0, -1):
            m, odd = divmod(n, 2)
            top = -(a + m) * (a + b + m) if odd else m * (b - m)
            value = 1 + top * x / ((a + n - 1) * (a + n)) / value
        value = 1 / value
        if last is not None and np.all(np.abs(value - last) <= 1e-14 * np.abs(value)):
            return value
        last, depth = value, 2 * depth
    raise ArithmeticError("incomplete beta function did not converge")


def betainc(a, b, x, rest=None) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), elementwise. ``rest`` is 1 - x
    where the caller knows it better than the difference gives it."""
    a, b, x, y = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x, 1.0 - np.asarray(x, dtype=float) if rest is None else rest))
    out = np.full(x.shape, np.nan)
    ok = (x >= 0) & (y >= 0) & (a > 0) & (b > 0)
    out[ok & (x == 0)] = 0.0
    out[ok & (y == 0)] = 1.0
    inner = ok & (x > 0) & (y > 0)
    swap = inner & (x * (a + b + 2) > a + 1)
    for part, p, q, u, v in ((inner & ~swap, a, b, x, y), (swap, b, a, y, x)):
        if part.any():
            p, q, u, v = p[part], q[part], u[part], v[part]
            log_u = np.where(u < 0.5, np.log(u), np.log1p(-v))
            log_v = np.where(v < 0.5, np.log(v), np.log1p(-u))
            value = np.exp(p * log_u + q * log_v - _log_beta(p, q)) / p * _beta_fraction(p, q, u)
            out[part] = value if part is not swap else 1.0 - value
    return out


def t_sf_two_sided(t, df) -> np.ndarray:
    """P(|T| > |t|) for Student-t with ``df`` degrees of freedom."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return betainc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def t_cdf(t, df) -> np.ndarray:
    t = np.asarray(t, dtype=float)
    tail = 0.5 * t_sf_two_sided(t, df)
    return np.where(t >= 0, 1.0 - tail, tail)


def t_ppf(q, df, iters: int = 200) -> np.ndarray:
    """Student-t quantile by bisection on the tail, from a bracket that grows
    until it holds the quantile."""
    q, df = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(q, df))
    tail = 2 * np.minimum(q, 1 - q)
    hi = np.ones(q.shape)
    for _ in range(1000):
        short = t_sf_two_sided(hi, df) > tail
        if not short.any():
            break
        hi = np.where(short, 2 * hi, hi)
    lo = np.zeros(q.shape)
    for _ in range(iters):
        mid = 0.5 * (lo + hi)
        inside = t_sf_two_sided(mid, df) > tail
        lo, hi = np.where(inside, mid, lo), np.where(inside, hi, mid)
    return np.where(q < 0.5, -1.0, 1.0) * 0.5 * (lo + hi)


def chi2_sf_1df(x) -> np.ndarray:
    """Upper tail of chi-square with 1 df: erfc(sqrt(x / 2))."""
    return np.array([math.erfc(math.sqrt(v / 2.0)) if v == v and v >= 0 else np.nan
                     for v in np.asarray(x, dtype=float)])


def normal_sf_two_sided(z) -> np.ndarray:
    return np.array([math.erfc(abs(v) / math.sqrt(2.0)) if v == v else np.nan
                     for v in np.asarray(z, dtype=float)])


#: Nodes of the quadrature, log of what the cut-off tail is worth at most
#: against its first value, and Newton steps of the quantile.
NODES, CUT, STEPS = 2000, 41.0, 40


def _integral(a: Column, b: Column, f) -> Column:
    """Integral of ``f`` from a to b: the trapezoid rule after the
    substitution x = a + (b - a) w^3 (10 - 15 w + 6 w^2), whose slope is zero
    at both ends, so that the rule converges fast there too."""

    def add(acc: Column, i: Column) -> Column:
        w = i / float(NODES)
        return acc + 30.0 * w * w * (1 - w) * (1 - w) * f(a + (b - a) * (w * w * w * (10 - 15 * w + 6 * w * w)))

    return (b - a) / float(NODES) * F.aggregate(F.sequence(F.lit(1), F.lit(NODES - 1)), F.lit(0.0), add)


def _cosine_integral(start: Column, df: Column) -> Column:
    """Integral of (cos x / cos start)^(df - 1) from start to pi / 2: the
    Student-t density after t = sqrt(df) tan x, cut off where it is nothing."""
    power = F.greatest(df - 1, F.lit(1e-9))
    end = F.acos(F.cos(start) * F.exp(-CUT / power))
    return _integral(start, end, lambda x: F.exp(power * F.ln(F.cos(x) / F.cos(start))))


def _t_tail(t: Column, df: Column) -> Column:
    start = F.atan(F.abs(t) / F.sqrt(df))
    whole = _cosine_integral(F.lit(0.0), df)
    return _cosine_integral(start, df) * F.exp((df - 1) * F.ln(F.cos(start))) / whole


def t_test_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value (column), for at least one degree of freedom."""
    return _t_tail(t.cast("double"), df.cast("double"))


def t_quantile(q: float, df: Column) -> Column:
    """Student-t quantile: Newton steps on the tail from the normal one, which
    lies nearer to the middle, so that every step falls short of the root."""
    if not 0 < q < 1:
        raise ValueError("a quantile needs a probability between 0 and 1")
    df, tail, sign = df.cast("double"), 2 * min(q, 1 - q), 1.0 if q >= 0.5 else -1.0
    start = abs(NormalDist().inv_cdf(q))

    def step(x: Column, _: Column) -> Column:
        angle = F.atan(x / F.sqrt(df))
        slope = F.exp((df + 1) * F.ln(F.cos(angle))) / (F.sqrt(df) * _cosine_integral(F.lit(0.0), df))
        return x + (_t_tail(x, df) - tail) / slope

    return sign * F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(start), step)


def normal_p(z: Column) -> Column:
    """Two-sided normal p-value."""
    z = F.abs(z.cast("double"))
    end = F.sqrt(z * z + 2 * CUT)
    return _integral(z, end, lambda x: F.exp((z * z - x * x) / 2)) * F.exp(-z * z / 2) / math.sqrt(math.pi / 2)


def chi2_p(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom."""
    return normal_p(F.sqrt(x.cast("double")))


# Standard normal quantiles used by the workload (fixed values):
Z_975 = 1.959963984540054  # two-sided 95%
Z_80 = 0.8416212335729143  # power 0.80


def yates_chi2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Pearson chi-square of the 2x2 table [[a, b], [c, d]] with Yates'
    continuity correction (scipy's default for one degree of freedom): every
    cell moves at most 0.5 towards its expectation."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    e11, e12 = (a + b) * (a + c) / n, (a + b) * (b + d) / n
    e21, e22 = (c + d) * (a + c) / n, (c + d) * (b + d) / n
    adj = F.greatest(F.abs(a - e11) - 0.5, F.lit(0.0))
    return adj * adj * (1 / e11 + 1 / e12 + 1 / e21 + 1 / e22)
