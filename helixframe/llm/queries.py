"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import OP2_SQL, op2_query
from .gif import op9_query
from .language_id import op4_query
from .licenses import op7_query
from .mixing import OP1_SQL, op1_query
from .packing import op3_query
from .pii import op6_query
from .simhash import op10_query
from .token_counts import op8_query
from .toxicity import op5_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_query,
    "op2_pivot_join": op2_query,
    "op3_pack_windows": op3_query,
    "op4_kneser_ney": op4_query,
    "op5_fuzzy_toxicity": op5_query,
    "op6_weak_pii": op6_query,
    "op7_license_rules": op7_query,
    "op8_length_histogram": op8_query,
    "op9_gif": op9_query,
    "op10_simhash_anchors": op10_query,
}

ORACLE_SQL: dict[str, str] = {"op1_pareto_mix": OP1_SQL, "op2_pivot_join": OP2_SQL}
