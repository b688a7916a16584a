"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Stage functions take (spark, docs, sf_dir) and return what they keep; all but
the last return the columns of ``documents``.

* ``quality_rules``: rejected documents go.
* ``line_dedup``: lines of recurring templates go from the texts; every document stays.
* ``simhash_near_dedup``: one document of each group of near duplicates stays.
* ``benchmark_decontamination``: contaminated documents go.
* ``sentencepiece``: adds token ids and the round-trip and parity checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetaudit.llm import decontaminate, line_dedup, pieces, quality, simhash
from fleetaudit.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("sentencepiece", pieces.stage),
]

#: The stages' hashes and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
