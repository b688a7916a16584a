"""Exact dedup: rows grouped by a 128-bit content hash, bytes compared inside each group.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]``
is replaced by one space.  Two passes over the texts:

1. bytes: per hash, the set of different texts (partial aggregation, so a task
   sends each text once however many copies it read).  A set of one proves that
   all texts of the hash are equal byte for byte; larger sets are collisions
   and number their texts (``variant``).  Only collisions are written.
2. keys: each row gets (hash, variant), from here on without its text.  Groups
   are counted with their first row by partial aggregation, and rows find their
   group by a join that Spark can split, as groups of one row need no entry.

A group is never gathered: a third of all rows may be copies of one text.

Defined cases: null counts as empty; the row with the smallest key stays, a
null key is larger than any other, of rows with equal keys one stays (the
choice is fixed once the keys are written); an empty table gives no rows; input
columns are packed in one struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import replaced, table, text_or_empty, written

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text))


def collisions(texts: DataFrame) -> DataFrame:
    """(hash, norm, variant) of the hashes that several different texts share."""
    return (
        texts.groupBy("hash")
        .agg(F.collect_set("norm").alias("texts"))
        .where(F.size("texts") > 1)
        .select("hash", F.posexplode(F.array_sort("texts")).alias("variant", "norm"))
    )


def copies(
    docs: DataFrame,
    keep: list[str],
    key: str = "doc_id",
    text: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Columns ``keep`` of every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    rows = docs.select(
        F.struct(*keep).alias("row"), F.col(key).alias("key"), normalised(text).alias("norm")
    ).withColumn("hash", hashed(F.col("norm")))
    # written first: then Spark knows its size, which is nothing where no hash is shared
    shared = written(collisions(rows.select("hash", "norm")), "collisions")
    keyed = written(
        rows.join(shared, ["hash", "norm"], "left").select(
            "row",
            "hash",
            F.coalesce("variant", F.lit(0)).alias("variant"),
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.struct(F.col("key").isNull().alias("none"), "key", F.monotonically_increasing_id().alias("at")).alias("place"),
        ),
        "keyed",
    )
    groups = written(
        keyed.groupBy("hash", "variant")
        .agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("first"))
        .where("size > 1"),
        "groups",
    )
    first = F.coalesce("first", "place")
    return keyed.join(groups, ["hash", "variant"], "left").select(
        "row.*",
        first["key"].alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (first["at"] == F.col("place.at")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns (input columns named like the added ones are replaced)."""
    docs = replaced(docs, *ADDED)
    return copies(docs, docs.columns, key, text).where("kept").drop(*ADDED)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"), ["doc_id"])


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)"""
