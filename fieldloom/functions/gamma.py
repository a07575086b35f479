"""Gamma distributions located at 0 as column expressions: their fit, their probabilities on the normal scale; all JVM-side."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wichura's rational approximations of the normal quantile (AS 241), highest power first; numerator, then denominator,
#: for the middle, the tails and the far tails.
QUANTILE = [
    [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080],
    [5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867, 5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0],
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 0.241780725177450611770, 1.27045825245236838258, 3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 0.148103976427480074590, 0.689767334985100004550, 1.67638483018380384940, 2.05319162663775882187, 1.0],
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 0.296560571828504891230, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 0.136929880922735805310, 0.599832206555887937690, 1.0],
]
#: Shapes from here on are so close to a normal distribution that the cube root is taken for one.
LARGE_SHAPE = 1e5
#: Newton's steps from a start that is right to about 1.5 percent.
STEPS = 6
_SHIFT = 8


def _polynomial(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda s, c: s * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def digamma(x: Column) -> Column:
    """Derivative of the log gamma function for x > 0: shifted up by recurrence, then the asymptotic series."""
    y = x + _SHIFT
    r = 1 / (y * y)
    series = F.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * (691 / 32760))))))
    return series - reduce(lambda s, i: s + 1 / (x + i), range(1, _SHIFT), 1 / x)


def trigamma(x: Column) -> Column:
    """Derivative of ``digamma`` for x > 0."""
    y = x + _SHIFT
    r = 1 / (y * y)
    series = 1 / y + 0.5 * r + r / y * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * (5 / 66)))))
    return series + reduce(lambda s, i: s + 1 / ((x + i) * (x + i)), range(1, _SHIFT), 1 / (x * x))


def gamma_shape(mean: Column, mean_log: Column) -> Column:
    """Shape of the largest likelihood from the mean and the mean logarithm of positive values; values that hardly differ count as a little spread."""
    spread = F.greatest(F.log(mean) - mean_log, F.lit(1e-12))
    start = (3 - spread + F.sqrt((spread - 3) * (spread - 3) + 24 * spread)) / (12 * spread)
    newton = lambda a: F.greatest(a - (F.log(a) - digamma(a) - spread) / (1 / a - trigamma(a)), a / 10)
    return F.when(spread < 0.5 / LARGE_SHAPE, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda a, _: newton(a)))


def gamma_probability(shape: Column, ratio: Column) -> Column:
    """Probability below ``ratio`` times the mean, for shapes below ``LARGE_SHAPE``: the power series, as many terms as still count.

    Its front factor is written in the distance from the mean, so that large shapes cancel nothing.
    """
    x, y = shape * ratio, shape + _SHIFT
    d, r = F.log(ratio), 1 / (y * y)
    # log Gamma(shape) less (shape log shape - shape)
    rest = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    rest = rest - reduce(lambda s, i: s + F.log(shape + i), range(1, _SHIFT), F.log(shape)) - shape * F.log(shape) + shape
    terms = F.ceil(F.greatest(x - shape, F.lit(0.0)) + 9 * F.sqrt(x) + 40).cast("int")
    one = F.lit(1.0)
    sums = F.aggregate(
        F.sequence(F.lit(1), terms),
        F.struct(one.alias("term"), one.alias("sum")),
        lambda s, n: F.struct((s["term"] * x / (shape + n)).alias("term"), (s["sum"] + s["term"] * x / (shape + n)).alias("sum")),
        lambda s: s["sum"],
    )
    return F.least(F.exp(shape * (d - F.expm1(d)) - rest) * sums / shape, one)


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution; infinite at 0 and 1."""
    part = lambda i, x: _let(x, lambda v: _polynomial(QUANTILE[i], v) / _polynomial(QUANTILE[i + 1], v))

    def quantile(p: Column) -> Column:
        q, depth = p - 0.5, F.sqrt(-F.log(F.least(p, 1 - p)))
        tail = F.signum(q) * _let(depth, lambda t: F.when(t <= 5, part(2, t - 1.6)).otherwise(part(4, t - 5)))
        return F.when(p <= 0, -math.inf).when(p >= 1, math.inf).when(F.abs(q) <= 0.425, q * part(0, 0.180625 - q * q)).otherwise(tail)

    return _let(p, quantile)


def gamma_score(shape: Column, ratio: Column) -> Column:
    """Normal quantile of the probability below ``ratio`` times the mean; minus infinity for ratios of 0 and less."""
    root = 3 * F.sqrt(shape) * (F.cbrt(ratio) - 1 + 1 / (9 * shape))
    p = gamma_probability(shape, ratio)
    return F.when(ratio <= 0, -math.inf).when(shape >= LARGE_SHAPE, root).otherwise(normal_quantile(p))
