"""Evidence of reads that arrive as a stream, summed by site.

Counts are additive, so the stream keeps one row per (site, class, quality) in its state store; a trigger
writes the rows that it changed, and no trigger brings the state to the driver.  Likelihoods and activity are
worked out from the sums whenever a table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import relational as rel
from ..operators.reads import LEAST_QUALITY

KEYS = ["tid", "pos", "cls", "qual"]


def histogram_stream(evidence: DataFrame) -> DataFrame:
    """A streaming aggregate of (tid, pos, cls, qual) rows."""
    return rel.quality_histogram(evidence, ["tid", "pos"], evidence["cls"], evidence["qual"], LEAST_QUALITY)


def keep_histogram(evidence: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the changed rows of each trigger as Parquet under ``path``; a trigger that is repeated replaces its own rows."""

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return histogram_stream(evidence).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()


def kept_histogram(spark: SparkSession, path: str) -> DataFrame:
    """The sums so far: counts only rise, so the greatest of a key is its last."""
    return spark.read.parquet(path).groupBy(*KEYS).agg(F.max("n").alias("n"))
