"""Random numbers as column expressions: what a draw is called decides its value, so it is the same wherever and however often it is taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Above this mean, Poisson counts come from the normal expansion of their quantiles, and so do sums of more than so many exponentials.
POISSON_SUMMED, GAMMA_SUMMED = 10, 12
#: Cumulated probabilities that are kept of a Poisson law of mean POISSON_SUMMED or less; what lies beyond is less than 2 ** -52.
POISSON_TERMS = 48

# The rational approximation of the normal quantile by P. J. Acklam (relative error 1.15e-9), numerators and denominators of its middle and its tails.
MIDDLE_OVER = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_OVER = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425


def name(*parts) -> Column:
    """The name that ``parts`` (columns or values) make; it may be the first part of a longer one."""
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def named(*parts) -> Column:
    """128 bits, as 32 hexadecimal digits, of the name that ``parts`` (columns or values) make."""
    return F.md5(name(*parts))


def uniform(digits: Column, half: int = 0) -> Column:
    """A number between 0 and 1, both out, from one of the two runs of 52 bits in ``named``'s digits."""
    return (F.conv(F.substring(digits, 1 + 13 * half, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def polynomial(factors: tuple[float, ...], x: Column) -> Column:
    total = F.lit(factors[0])
    for f in factors[1:]:
        total = total * x + F.lit(f)
    return total


def normal_quantile(u: Column) -> Column:
    """What a standard normal number is below with probability ``u``."""
    q = u - 0.5
    middle = polynomial(MIDDLE_OVER, q * q) * q / polynomial(MIDDLE_UNDER, q * q)
    t = F.sqrt(-2 * F.log(F.when(u < 0.5, u).otherwise(1 - u)))
    tail = polynomial(TAIL_OVER, t) / polynomial(TAIL_UNDER, t)
    return F.when(u < TAIL, tail).when(u > 1 - TAIL, -tail).otherwise(middle)


def poisson_table(mean: Column) -> Column:
    """Cumulated probabilities of 0, 1, ... for a mean of POISSON_SUMMED or less, an empty array for others: for ``poisson``."""
    step = lambda a, j: F.struct((a["p"] * mean / j).alias("p"), (a["upto"] + a["p"] * mean / j).alias("upto"), F.array_append(a["all"], a["upto"] + a["p"] * mean / j).alias("all"))
    none = F.exp(-mean)
    start = F.struct(none.alias("p"), none.alias("upto"), F.array(none).alias("all"))
    made = F.aggregate(F.sequence(F.lit(1.0).cast("int"), F.lit(POISSON_TERMS)), start, step, lambda a: a["all"])
    return F.when(mean <= POISSON_SUMMED, made).otherwise(F.array().cast("array<double>"))


def poisson(u: Column, w: Column, mean: Column, table: Column) -> Column:
    """A Poisson count by inversion: the number of cumulated probabilities that are not above ``u``, whose normal quantile is ``w``.

    Above POISSON_SUMMED the quantile comes from its expansion about the normal
    one, which gives a neighbouring count in less than one of a hundred draws.
    """
    root = F.sqrt(mean)
    expansion = mean + root * w + (w * w / 6 + F.lit(1 / 3)) - (w * w * w / 72 + w / 36) / root
    return F.when(mean <= POISSON_SUMMED, F.size(F.filter(table, lambda c: c <= u))).otherwise(F.greatest(F.lit(0), F.floor(expansion))).cast("long")


def exponential_sum(k: Column, w: Column, name: list) -> Column:
    """The sum of ``k`` standard exponentials drawn under ``name`` and a number: minus the sum of the logarithms of uniform numbers.

    For more than GAMMA_SUMMED the sum's quantile is the cube that Wilson and
    Hilferty give for it, from the normal quantile ``w``, which is within some
    thousandths of a standard deviation.
    """
    few = F.aggregate(F.sequence(F.lit(1), F.least(k, F.lit(GAMMA_SUMMED)).cast("int")), F.lit(0.0), lambda a, i: a - F.log(uniform(named(*name, i))))
    cube = 1 - 1 / (9 * k) + w / (3 * F.sqrt(k.cast("double")))
    return F.when(k <= GAMMA_SUMMED, few).otherwise(k * cube * cube * cube)
