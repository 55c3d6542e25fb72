"""Two-sided normal / t p-values and the chi-square upper tail.

These act on coefficient-sized tables on the driver (a handful of numbers per
fit), so they are plain Python: the data work never passes through here."""

from __future__ import annotations

import math


def p_normal(z: float) -> float:
    """Two-sided normal p-value, 2 * pnorm(-|z|)."""
    if z is None or math.isnan(z):
        return float("nan")
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float, depth: int = 600) -> float:
    """1 / (1 + d1 / (1 + d2 / ...)), DLMF 8.17.22, evaluated from the inside out."""
    tail = 1.0
    for n in range(depth, 0, -1):
        m = n // 2
        if n % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        tail = 1.0 + d / tail
    return 1.0 / tail


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(lbt) * _beta_fraction(b, a, 1.0 - x) / b


def p_t(t: float, df: float) -> float:
    """Two-sided Student-t p-value, 2 * pt(-|t|, df) (Stata ``tprob``)."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return float("nan")
    x = df / (df + t * t)
    return betainc_reg(df / 2.0, 0.5, x)


def gammainc_upper_reg(s: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(s, x)."""
    if x <= 0.0:
        return 1.0
    if x < s + 1.0:
        term = total = 1.0 / s
        ap = s
        for _ in range(1000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return 1.0 - total * math.exp(-x + s * math.log(x) - math.lgamma(s))
    tiny = 1e-300
    b = x + 1.0 - s
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return math.exp(-x + s * math.log(x) - math.lgamma(s)) * h


def p_chi2(x: float, df: int) -> float:
    """Upper-tail chi-square probability, pchisq(x, df, lower.tail = FALSE)."""
    if x is None or df is None or df <= 0 or math.isnan(x):
        return float("nan")
    return gammainc_upper_reg(df / 2.0, x / 2.0)
