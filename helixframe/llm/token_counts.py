"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded whole and counted by length; counting is pre-aggregated before the shuffle.
Lengths are cut into ranges of ``RANGE``; running sums are made within each range and shifted by
the ranges' totals, so no task sees more than one range of lengths or the list of range totals.

For a context limit L the histogram's row with the greatest length not above L answers exactly:
documents of at most L tokens, tokens of all documents cut to L, documents cut.  See ``at_limits``.

Defined results: a null text is not counted in any length; ``null_texts``, equal in all rows, is the number of them,
so that it and all documents make up the table's rows, and where there are any a row of length 0 exists; an empty text has length 0; repeated rows
count each time; very long texts are encoded whole; no rows give no rows; other columns are never
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import documents, short_batches, stage
from .packing import word_cache

RANGE = 256


def encoded_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs, null_texts): counts of encoded lengths, and of null texts at length 0, summed in each batch before they are shuffled."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = word_cache(tokenizer)
        for b in batches:
            texts = b["text"].dropna().tolist()
            sizes = np.fromiter((len(e) // 4 for e in cache.encode(texts)), np.int64, len(texts))
            length, n = np.unique(sizes, return_counts=True)
            yield pd.DataFrame({"n_tokens": length, "n": n, "nulls": 0})
            if len(texts) < len(b):
                yield pd.DataFrame({"n_tokens": [0], "n": [0], "nulls": [len(b) - len(texts)]})

    narrow = docs.select(F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(run, "n_tokens long, n long, nulls long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"), F.sum("nulls").alias("null_texts"))


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """One row per distinct length L: documents of that length, of at most and over L, share of at most L, all tokens, tokens when all documents are cut to L, null texts."""
    counts = stage(encoded_lengths(docs, tokenizer, text_col).withColumn("part", F.floor(F.col("n_tokens") / RANGE)).withColumn("mass", F.col("n_tokens") * F.col("n_docs")), "lengths")
    parts = counts.groupBy("part").agg(F.sum("n_docs").alias("part_docs"), F.sum("mass").alias("part_mass"), F.sum("null_texts").alias("part_nulls"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shifts = stage(parts.select(F.col("part").alias("of"), F.coalesce(F.sum("part_docs").over(earlier), F.lit(0)).alias("docs_before"), F.coalesce(F.sum("part_mass").over(earlier), F.lit(0)).alias("mass_before"), F.sum("part_docs").over(every).alias("all_docs"), F.sum("part_mass").over(every).alias("all_tokens"), F.sum("part_nulls").over(every).alias("all_nulls")), "shifts")
    upto = Window.partitionBy("part").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumns({"docs_here": F.sum("n_docs").over(upto), "mass_here": F.sum("mass").over(upto)}).join(shifts, F.col("part") == F.col("of"))
    at_most = F.col("docs_before") + F.col("docs_here")
    over = F.col("all_docs") - at_most
    return run.select(
        "n_tokens",
        "n_docs",
        at_most.alias("docs_at_most"),
        over.alias("docs_over"),
        F.try_divide(at_most, F.col("all_docs")).alias("share_at_most"),
        "all_tokens",
        (F.col("mass_before") + F.col("mass_here") + over * F.col("n_tokens")).alias("tokens_cut_to"),
        F.col("all_nulls").alias("null_texts"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """The answers for any context limits: rows (context, docs_whole, docs_cut, tokens_kept, all_tokens)."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context long")
    # Each row answers for the limits from its length up to the next one's; the list of limits is the caller's.
    best = histogram.join(F.broadcast(asked), F.col("n_tokens") <= F.col("context")).groupBy("context").agg(F.max_by(F.struct("docs_at_most", "docs_over", "tokens_cut_to", "n_tokens", "all_tokens"), "n_tokens").alias("h"))
    totals = histogram.agg(F.max("all_tokens").alias("t"), F.max(F.col("docs_at_most") + F.col("docs_over")).alias("d"))
    return asked.join(best, "context", "left").join(F.broadcast(totals), F.lit(True)).select(
        "context",
        F.coalesce("h.docs_at_most", F.lit(0)).alias("docs_whole"),
        F.coalesce("h.docs_over", "d").alias("docs_cut"),
        F.coalesce(F.col("h.tokens_cut_to") + F.col("h.docs_over") * (F.col("context") - F.col("h.n_tokens")), F.col("d") * F.col("context")).alias("tokens_kept"),
        F.col("t").alias("all_tokens"),
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least each share of documents doesn't exceed."""
    aggregates = [F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens"))).alias(f"q{q:g}") for q in shares]
    return histogram.agg(*aggregates)


def op8_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return length_histogram(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
