"""Special functions and log-probabilities as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

LN_2PI = math.log(2 * math.pi)
#: From this count on the Stirling error is a short series; below it a table.
STIRLING_FROM = 16
#: Terms of the series: enough for double precision where they are used.
DEVIANCE_TERMS, HALLEY_STEPS, DIGAMMA_SHIFT = 12, 3, 10
#: Rational approximations of the error function (those of fdlibm's s_erf.c): bounds below which each holds, and the
#: coefficients of numerator and denominator, from the constant on.
ERF_NEAR, ERF_ONE, ERF_MIDDLE, ERF_FAR = 0.84375, 1.25, 1 / 0.35, 6.0
ERF_AT_ONE = 8.45062911510467529297e-01
NEAR = [1.28379167095512558561e-01, -3.25042107247001499370e-01, -2.84817495755985104766e-02, -5.77027029648944159157e-03, -2.37630166566501626084e-05], [1.0, 3.97917223959155352819e-01, 6.50222499887672944485e-02, 5.08130628187576562776e-03, 1.32494738004321644526e-04, -3.96022827877536812320e-06]
ONE = [-2.36211856075265944077e-03, 4.14856118683748331666e-01, -3.72207876035701323847e-01, 3.18346619901161753674e-01, -1.10894694282396677476e-01, 3.54783043256182359371e-02, -2.16637559486879084300e-03], [1.0, 1.06420880400844228286e-01, 5.40397917702171048937e-01, 7.18286544141962662868e-02, 1.26171219808761642112e-01, 1.36370839120290507362e-02, 1.19844998467991074170e-02]
MIDDLE = [-9.86494403484714822705e-03, -6.93858572707181764372e-01, -1.05586262253232909814e01, -6.23753324503260060396e01, -1.62396669462573470355e02, -1.84605092906711035994e02, -8.12874355063065934246e01, -9.81432934416914548592e00], [1.0, 1.96512716674392571292e01, 1.37657754143519042600e02, 4.34565877475229228821e02, 6.45387271733267880336e02, 4.29008140027567833386e02, 1.08635005541779435134e02, 6.57024977031928170135e00, -6.04244152148580987438e-02]
FAR = [-9.86494292470009928597e-03, -7.99283237680523006574e-01, -1.77579549177547519889e01, -1.60636384855821916062e02, -6.37566443368389627722e02, -1.02509513161107724954e03, -4.83519191608651397019e02], [1.0, 3.03380607434824582924e01, 3.25792512996573918826e02, 1.53672958608443695994e03, 3.19985821950859553908e03, 2.55305040643316442583e03, 4.74528541206955367215e02, -2.24409524465858183362e01]


def polynomial(coefficients: list[float], x: Column) -> Column:
    """c0 + c1 x + ... by Horner's rule."""
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = c + x * out
    return out


def rational(parts: tuple[list[float], list[float]], x: Column) -> Column:
    return polynomial(parts[0], x) / polynomial(parts[1], x)


def fast_round(x: Column) -> Column:
    """The nearest integer, halves away from zero."""
    return F.when(x > 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("int")


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function for x > 0: shifted up by the recurrence, then its asymptotic series."""
    y = x + float(DIGAMMA_SHIFT)
    steps = sum((1.0 / (x + float(k)) for k in range(1, DIGAMMA_SHIFT)), 1.0 / x)
    z = 1.0 / (y * y)
    # Bernoulli numbers over 2n
    series = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z * (1 / 132)))))
    return F.log(y) - 0.5 / y - series - steps


def erf(x: Column) -> Column:
    """The error function by a rational approximation of four ranges; 1 from 6 on."""

    def tail(a: Column) -> Column:
        outer = let(1.0 / (a * a), lambda z: F.when(a < ERF_MIDDLE, rational(MIDDLE, z)).otherwise(rational(FAR, z)))
        return 1.0 - F.exp(outer - a * a - 0.5625) / a

    def whole(a: Column) -> Column:
        near = let(a * a, lambda z: a + a * rational(NEAR, z))
        one = let(a - 1.0, lambda z: ERF_AT_ONE + rational(ONE, z))
        return F.when(a < ERF_NEAR, near).when(a < ERF_ONE, one).when(a < ERF_FAR, tail(a)).otherwise(1.0)

    return let(x.cast("double"), lambda v: F.signum(v) * let(F.abs(v), whole))


def erf_inverse(y: Column) -> Column:
    """x with erf(x) = y for -1 < y < 1: a closed first guess and Halley's steps."""
    a = 8 * (math.pi - 3) / (3 * math.pi * (4 - math.pi))

    def whole(v: Column) -> Column:
        def guess(log: Column) -> Column:
            first = 2 / (math.pi * a) + log / 2
            return F.signum(v) * F.sqrt(F.sqrt(first * first - log / a) - first)

        x = let(F.log1p(-v * v), guess)
        for _ in range(HALLEY_STEPS):
            x = let(x, lambda g: let((erf(g) - v) / (2 / math.sqrt(math.pi) * F.exp(-g * g)), lambda u: g - u / (1.0 + g * u)))
        return x

    return let(y.cast("double"), whole)


def stirling_error(n: Column) -> Column:
    """ln n! less Stirling's approximation of it, for whole n >= 0."""
    table = [0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - LN_2PI / 2 for k in range(1, STIRLING_FROM)]
    z = 1.0 / (n * n)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / n
    return F.when(n < STIRLING_FROM, F.get(F.array(*[F.lit(x) for x in table]), n.cast("int"))).otherwise(series)


def deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, by a series where x and the mean are close."""
    series = [1.0 / (2 * j + 1) for j in range(1, DEVIANCE_TERMS + 1)]
    near = let((x - mean) / (x + mean), lambda v: (x - mean) * v + 2.0 * x * v * let(v * v, lambda w: w * polynomial(series, w)))
    return F.when(F.abs(x - mean) < 0.1 * (x + mean), near).when(x == 0, mean).otherwise(x * F.log(x / mean) + mean - x)


def binomial_log_pmf(x: Column, n: Column, p: Column) -> Column:
    """ln P(x successes of n) for 0 < p < 1 by the saddle-point expansion; null outside 0..n."""
    x, n = x.cast("double"), n.cast("double")
    q = 1.0 - p
    middle = stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * q)
    spread = LN_2PI + F.log(x) + F.log1p(-x / n)
    none = F.when(p < 0.1, -deviance(n, n * q) - n * p).otherwise(n * F.log(q))
    every = F.when(q < 0.1, -deviance(n, n * p) - n * q).otherwise(n * F.log(p))
    return F.when((x < 0) | (x > n), F.lit(None).cast("double")).when(n == 0, 0.0).when(x == 0, none).when(x == n, every).otherwise(middle - 0.5 * spread)


def hypergeometric_log_pmf(x: Column, marked: Column, drawn: Column, total: Column) -> Column:
    """ln P(x marked among those drawn): three binomial terms at one rate; null where it can't be."""
    p = drawn.cast("double") / total
    rest = binomial_log_pmf(drawn - x, total - marked, p)
    inner = binomial_log_pmf(x, marked, p) + rest - binomial_log_pmf(drawn, total, p)
    certain = (drawn == 0) | (drawn == total)
    return F.when(certain, F.when(x == F.when(drawn == 0, F.lit(0)).otherwise(marked), 0.0)).otherwise(inner)
