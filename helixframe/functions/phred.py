"""Phred and likelihood arithmetic as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG10_2 = math.log10(2.0)
LOG10_3 = math.log10(3.0)
#: The step and reach of the tabulated log-sum, and the least error probability.
JACOBIAN_STEP = 1e-4
JACOBIAN_REACH = 8.0
LEAST_PROBABILITY = 4.9e-324


def error_probability(q: Column) -> Column:
    """10^(-q/10)."""
    return F.pow(F.lit(10.0), -q / 10.0)


def log10_error(q: Column) -> Column:
    return q * -0.1


def log10_correct(q: Column) -> Column:
    """log10(1 - 10^(-q/10)); q must be over 0."""
    return F.log10(1.0 - error_probability(q))


def phred_of_probability(p: Column) -> Column:
    """|-10 log10 p| with p held above the least double."""
    return F.abs(-10.0 * F.log10(F.greatest(p, F.lit(LEAST_PROBABILITY))))


def jacobian_sum(a: Column, b: Column) -> Column:
    """log10(10^a + 10^b), the difference rounded to the table's step and ignored from its reach on."""
    d = F.abs(a - b)
    rounded = F.floor(d / JACOBIAN_STEP + 0.5) * JACOBIAN_STEP
    return F.greatest(a, b) + F.when(d < JACOBIAN_REACH, F.log10(1.0 + F.pow(F.lit(10.0), -rounded))).otherwise(0.0)


def log10_sum(values: Column) -> Column:
    """log10 of the sum of 10^x over an array, shifted by its maximum; null for an empty array."""
    top = F.array_max(values)
    return top + F.log10(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.pow(F.lit(10.0), x - top)))


def normalised(values: Column) -> Column:
    """Log10 values as probabilities that sum to 1."""
    whole = log10_sum(values)
    return F.transform(values, lambda x: F.pow(F.lit(10.0), x - whole))


def log10_one_minus(a: Column) -> Column:
    """log10(1 - 10^a) for a <= 0, by whichever of log1p and expm1 keeps its digits."""
    natural = a * math.log(10.0)
    return F.when(natural < -math.log(2.0), F.log1p(-F.exp(natural))).otherwise(F.log(-F.expm1(natural))) / math.log(10.0)


def pl_of(gl: Column) -> Column:
    """Genotype likelihoods (log10) as phred-scaled integers whose least is 0."""
    top = F.array_max(gl)
    return F.transform(gl, lambda x: F.floor(-10.0 * (x - top) + 0.5).cast("int"))


def gl_of(pl: Column) -> Column:
    return F.transform(pl, lambda x: x / -10.0)


def genotype_quality(pl: Column) -> Column:
    """Second least minus least of the PLs; null below two."""
    ordered = F.array_sort(pl)
    return F.when(F.size(pl) > 1, ordered[1] - ordered[0])


def genotype_index(j: Column, k: Column) -> Column:
    """Index of the diploid genotype of alleles j <= k."""
    return (k * (k + 1) / 2 + j).cast("int")


def argmax(values: Column) -> Column:
    """Index of the first greatest element, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def elementwise_sum(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def elementwise_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def rank_with_ties(order_by, partition_by) -> Column:
    """Average ranks: the first rank of a tie group plus half of its size less one."""
    from pyspark.sql import Window

    ranked = Window.partitionBy(*partition_by).orderBy(order_by)
    group = Window.partitionBy(*partition_by, order_by)
    return F.rank().over(ranked) + (F.count(F.lit(1)).over(group) - 1) / 2.0
