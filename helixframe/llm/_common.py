"""Helpers shared by the training-data operators: staging in the shared folder and batch bounds."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import shared_dir, stage  # noqa: F401 (the operators take them from here)

#: Rows in one Arrow batch.  Texts can be very long, so the library keeps batches short.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20
#: Characters that are held as lists of words at once.
CHARS_AT_ONCE = 500_000
#: Keys with more than this share of all rows are joined by broadcast: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def keyed(rows: DataFrame, answers: DataFrame, row_key: str, answer_key: str, weight: str) -> DataFrame:
    """``rows`` joined with the one answer of their key; ``weight`` is an answer's number of rows.

    A key that holds a great share of all rows would fill one task of a shuffle.  Such keys are few
    (at most 1 / HOT_SHARE), so their answers are broadcast and their rows stay where they are.
    """
    total = answers.agg(F.sum(weight).alias("n")).first()["n"] or 0
    hot = answers.filter(F.col(weight) > F.lit(HOT_SHARE * total))
    met = rows.join(F.broadcast(hot), F.col(row_key) == F.col(answer_key), "left")
    cold = met.filter(F.col(answer_key).isNull()).select(*rows.columns)
    return met.filter(F.col(answer_key).isNotNull()).unionByName(cold.join(answers.filter(F.col(weight) <= F.lit(HOT_SHARE * total)), F.col(row_key) == F.col(answer_key)))


def short_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound an Arrow batch in rows and bytes, so that a Python worker never holds thousands of long texts.

    Spark reads these bounds from the session when a query runs; they are only ever lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        number, unit = re.match(r"(-?\d+)\s*([kmg]?)", spark.conf.get(key).lower()).groups()
        now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def slices(texts: list[str], chars: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """The texts in order, cut into lists of about ``chars`` characters, so that few are held as lists of words at once."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
