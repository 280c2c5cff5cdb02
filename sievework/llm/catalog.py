"""Queries of the training-data operators, and SQL where it can express their results; tests hold all of them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op5_learned_partitions
from .bpe import op4_bpe
from .licenses import op2_licenses
from .packing import op7_best_fit_packing
from .pii import op1_pii
from .sharding import op6_sharding
from .simhash import op10_simhash
from .topk import OP3_SQL, op3_top_k
from .toxicity import op9_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_licenses, op3_top_k, op4_bpe, op5_learned_partitions, op6_sharding, op7_best_fit_packing, op8_warc, op9_toxicity, op10_simhash)
}
ORACLE_SQL: dict[str, str] = {"op3_top_k": OP3_SQL, "op8_warc": OP8_SQL}
