"""Upper tails of the t, F and chi-square distributions and the normal log-cdf.

Most are evaluated on the driver for one result row, so plain Python is enough. The incomplete
beta and gamma functions use their textbook continued fractions (modified Lentz) and power series.
What is needed for every value is written for whole arrays or as a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300
_EPS = 1e-16
_MAX_STEPS = 100_000


def _lentz(first: float, steps) -> float:
    """Value of a continued fraction from its (a, b) coefficient pairs."""
    f = first if first else _TINY
    c, d = f, 0.0
    for a, b in steps:
        d = b + a * d
        c = b + a / c
        d = 1.0 / (d if d else _TINY)
        c = c if c else _TINY
        f *= c * d
        if abs(c * d - 1.0) < _EPS:
            break
    return f


def _beta_steps(a: float, b: float, x: float):
    for m in range(1, _MAX_STEPS):
        k = m // 2
        if m % 2:
            top = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        else:
            top = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        yield top, 1.0


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    return front / a / _lentz(1.0, _beta_steps(a, b, x))


def _gamma_steps(a: float, x: float):
    for i in range(1, _MAX_STEPS):
        yield -i * (i - a), x + 2 * i + 1.0 - a


def upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = series = 1.0 / a
        k = a
        while abs(term) > abs(series) * _EPS:
            k += 1.0
            term *= x / k
            series += term
        return 1.0 - series * front
    return front / _lentz(x + 1.0 - a, _gamma_steps(a, x))


def t_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def f_upper(f: float, dof1: float, dof2: float) -> float:
    return 1.0 if f <= 0 else incomplete_beta(dof2 / 2.0, dof1 / 2.0, dof2 / (dof2 + dof1 * f))


def chi2_upper(x: float, dof: float) -> float:
    return upper_gamma(dof / 2.0, x / 2.0)


def log_normal_cdf(z: np.ndarray) -> np.ndarray:
    """ln of the standard normal cdf of every element."""
    z = np.asarray(z, dtype=float)
    out = np.empty_like(z)
    near = np.abs(z) <= 2.5
    x = z[near]
    # the power series around 0: 0.5 + pdf(x) * (x + x^3 / 3 + x^5 / 15 + ...)
    term, total = x.copy(), x.copy()
    for k in range(3, 90, 2):
        term *= x * x / k
        total += term
    out[near] = np.log(0.5 + total * np.exp(-0.5 * x * x) / math.sqrt(2.0 * math.pi))
    x = np.abs(z[~near])
    # the continued fraction of the tail: pdf(x) / (x + 1 / (x + 2 / (x + 3 / ...)))
    fraction = x.copy()
    for k in range(150, 0, -1):
        fraction = x + k / fraction
    tail = -0.5 * x * x - 0.5 * math.log(2.0 * math.pi) - np.log(fraction)
    out[~near] = np.where(z[~near] < 0, tail, np.log1p(-np.exp(tail)))
    return out


# Coefficients, highest power first, of the normal quantile (Wichura 1988, AS 241): numerator and
# denominator near the centre, in the tails and far out.
QUANTILE_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125,
     1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077,
     687.18700749205790830, 42.313330701600911252, 1.0))
QUANTILE_TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
     3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
     0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0))
QUANTILE_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
     0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
     0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0))


def _horner(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a probability column."""
    q = p - 0.5
    centre, r = F.lit(0.180625) - q * q, F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    ratio = lambda pair, x: _horner(pair[0], x) / _horner(pair[1], x)
    outer = F.when(r <= 5.0, ratio(QUANTILE_TAIL, r - 1.6)).otherwise(ratio(QUANTILE_FAR, r - 5.0))
    return F.when(F.abs(q) <= 0.425, q * ratio(QUANTILE_CENTRE, centre)).otherwise(F.signum(q) * outer)
