"""Helpers shared by the operators on training text: table reads, shared-folder tables, row keys."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetaudit.session import ensure_checkpoint_dir


BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT_BATCH = "67108864b"  # Spark's default, as the session reports it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage and survives lost executors: the files lie in the folder that
    the cluster names in ``spark.checkpoint.dir``, which every machine sees.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def text_key(col: str | Column = "text") -> Column:
    """128-bit content key of a text (null counts as empty): equal texts, equal keys."""
    return F.unhex(F.md5(text_or_empty(col)))


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names an operator is about to add (any letter case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def per_worker(key: str, build: Callable[[], Any]) -> Any:
    """``build()``, made once in each Python worker process and kept until another key is asked for."""
    kept = sys.modules.setdefault("fleetaudit_worker", types.ModuleType("fleetaudit_worker")).__dict__
    if key not in kept:
        for other in [k for k in kept if not k.startswith("__")]:
            del kept[other]
        gc.collect()  # before the next one takes its memory
        kept[key] = build()
    return kept[key]


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of texts bounded in bytes (``BATCH_BYTES``; one row at least).

    A batch lies in the executor's Arrow buffers and in the Python worker at the
    same time, once for each running task.  The bound is the session's setting,
    lowered here where the session leaves it at Spark's default.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == DEFAULT_BATCH:
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(function, schema)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that a task holds few texts as Python objects."""
    for b in batches:
        for at in range(0, max(b.num_rows, 1), rows):
            yield b.slice(at, rows)
