"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded
hash and writes them with their bucket number to the shared folder.  Pass 2
loads one bucket per task, permutes it with Spark's ``shuffle`` function (a
Fisher-Yates shuffle with a seed) and lays the buckets end to end; the global
position cuts the sequence into shards whose row counts differ by one at most
(law ``rows``).

The hash takes a row number as well as the record's key, so copies, repeated
rows and repeated or null ids scatter like any other rows and no bucket grows
with a hot key.  Because pass 1 is a written table, pass 2 may be rerun after
a lost executor and sees the same buckets.

Defined cases: an empty table gives no rows; null texts have size 1 and a null
checksum; input columns named ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import replaced, table, text_or_empty, written

LAW = "rows"


def external_shuffle(
    docs: DataFrame,
    n_shards: int = 8,
    seed: int = 42,
    key: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = 32 << 20,
) -> DataFrame:
    """All records of ``docs`` in random order, with ``shard`` and gapless ``slot`` (longs from 0).

    ``bucket_bytes`` is the text that one task of pass 2 holds in memory.
    """
    docs = replaced(docs, "shard", "slot")
    size = docs.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_or_empty(text)) + F.lit(1)).alias("b")
    ).first()  # two numbers
    n, n_buckets = size["n"], max(1, math.ceil((size["b"] or 0) / bucket_bytes))
    draw = F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id())
    scattered = written(
        docs.select(F.struct(*docs.columns).alias("record"), draw.alias("draw")).withColumn(
            "bucket", F.pmod("draw", F.lit(n_buckets)).cast("int")
        ),
        "scattered",
    )
    # one row per bucket: where it begins in the global sequence
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    # a bucket's start travels as one more row of it, so that no join moves the records again
    rows = scattered.select("bucket", F.lit(None).cast("long").alias("start"), "draw", "record").unionByName(
        starts.select("bucket", "start"), allowMissingColumns=True
    )
    loaded = (
        rows.repartitionById(n_buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", "draw")
        .groupBy("bucket")
        .agg(F.max("start").alias("start"), F.collect_list("record").alias("records"))
    )
    shuffled = loaded.select("start", F.posexplode(F.shuffle("records", seed)).alias("at", "record"))
    place = F.col("start") + F.col("at")
    shard = F.expr(f"(start + at) * {n_shards}L div {max(n, 1)}L")
    # the first position of shard s is the least p with p * n_shards >= s * n
    first = F.expr(f"(shard * {n}L + {n_shards - 1}L) div {n_shards}L")
    return shuffled.select(place.alias("place"), shard.alias("shard"), "record").select(
        "record.*", "shard", (F.col("place") - first).alias("slot")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard; rows keep ``slot`` so that a reader can restore the order."""
    shuffled.write.partitionBy("shard").parquet(path)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = external_shuffle(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + F.lit(1)).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
