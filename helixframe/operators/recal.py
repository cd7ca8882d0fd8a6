"""Recalibration steps from a report: a pure function of (read group, quality, covariate), so a small table.

Each datum has one possible prior: read group first, then quality, then each covariate.  The tables
are those of a report (at most read groups x 94 qualities x covariate values) and stay DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import empirical_quality


def _numbers(df: DataFrame, renamed: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(a).alias(b) for a, b in renamed.items()], F.col("Observations").cast("double").alias("n"), F.col("Errors").cast("double").alias("x"))


def _empirical(df: DataFrame, prior: Column) -> DataFrame:
    return empirical_quality(df, F.col("n"), F.col("x"), prior, "emp")


def steps(report: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``base`` (rg, q, value), ``context`` and ``cycle`` (rg, q, key, value) for ``reads.recalibrated``.

    The report's tables are RecalTable0 (read groups), RecalTable1 (qualities) and RecalTable2 (covariates);
    only substitutions (event M) are used.
    """
    zero, one, two = (report[f"RecalTable{i}"].filter("EventType = 'M'") for i in range(3))
    groups = _numbers(zero.withColumn("eq", F.col("EstimatedQReported").cast("double")), {"ReadGroup": "rg", "eq": "eq"})
    groups = _empirical(groups, F.col("eq")).select(F.col("rg").alias("g_rg"), F.col("emp").cast("double").alias("of_group"))
    quals = _numbers(one.withColumn("q0", F.col("QualityScore").cast("int")), {"ReadGroup": "rg", "q0": "q"}).join(groups, F.col("rg") == F.col("g_rg"))
    base = _empirical(quals, F.col("of_group")).select("rg", "q", F.col("emp").cast("double").alias("value"))
    cov = _numbers(two.withColumn("q0", F.col("QualityScore").cast("int")), {"ReadGroup": "rg", "q0": "q", "CovariateName": "name", "CovariateValue": "key"})
    own = base.select(F.col("rg").alias("b_rg"), F.col("q").alias("b_q"), F.col("value").alias("of_quality"))
    cov = _empirical(cov.join(own, (F.col("rg") == F.col("b_rg")) & (F.col("q") == F.col("b_q"))), F.col("of_quality"))
    cov = cov.select("rg", "q", "name", "key", (F.col("emp") - F.col("of_quality")).alias("value"))
    return {
        "base": base,
        "context": cov.filter("name = 'Context'").select("rg", "q", "key", "value"),
        "cycle": cov.filter("name = 'Cycle'").select("rg", "q", F.col("key").cast("int").alias("key"), "value"),
    }
