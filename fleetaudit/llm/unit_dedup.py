"""Substring dedup by hashed lines or paragraphs.

Texts are cut into units: lines, paragraphs, or the sentences of each line
(a unit then also begins at a capital, so that a passage pasted into the middle
of a line starts a unit of its own).  A unit is normalised (lower case, words
only), hashed, and grouped by digest over all documents.  The occurrence that
ranks first (least document id, null last; then input order) stays; the others
are copies.  Neighbouring copies of a text form a span, and spans of
``min_words`` or more words are removed, with their offsets in the original
text kept.

``repeats`` does so for all three units in one pass: every copied line and
paragraph goes, however short, and sentence runs of ``min_words`` or more
words go from inside lines; spans that meet are one.  Lines and paragraphs are
whole sentences, so spans are counted in sentences.  ``deduplicated`` cuts the spans out.

Digests of one occurrence leave after a count; the rest is joined to its group's
first occurrence.  The units are a written table, so row numbers are stable.

Defined cases: null and empty texts have no units; repeated rows are copies of
the first of them; units without a word character are not hashed and do not
break a span; an empty table gives no rows; ids may be null or repeat, as spans
belong to numbered rows; other columns pass through ``deduplicated``, which
adds ``removed`` (in the place of a column of that name).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, sliced, table, written

MIN_WORDS = 50
CAPITAL = "A-ZÀ-ÖØ-ÞΑ-ΩА-Я"
BREAKS = {
    "line": re.compile(r"\n+"),
    "paragraph": re.compile(r"\n[^\S\n]*\n\s*"),
    "sentence": re.compile(rf"\s*\n\s*|(?<=[.!?])\s+|\s+(?=[{CAPITAL}])"),
}
NOT_WORD = re.compile(r"[\W_]+")


def units_of(text: str | None, unit: str) -> list[tuple[int, int, int, int]]:
    """(start, end, words, digest) of the units that hold a word."""
    text = text or ""
    out, start = [], 0
    for m in (*BREAKS[unit].finditer(text), None):
        end = m.start() if m else len(text)
        words = NOT_WORD.sub(" ", text[start:end].lower()).split()
        if words:
            out.append((start, end, len(words), xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)))
        if m:
            start = m.end()
    return out


def nested_units(text: str | None) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(level, first sentence, last sentence, start, end, words before, words, digest) of all units that hold a word.

    Level 0 holds the sentences, level 1 the lines and paragraphs; a line that is its whole paragraph is there once.
    """
    sentences = units_of(text, "sentence")
    starts = [s for s, *_ in sentences]
    before = [0, *accumulate(n for _, _, n, _ in sentences)]
    out = [(0, k, k, s, e, before[k], n, d) for k, (s, e, n, d) in enumerate(sentences)]
    listed = set()
    for unit in ("line", "paragraph"):
        for s, e, n, d in units_of(text, unit):
            first, last = bisect_left(starts, s), bisect_left(starts, e) - 1
            if (first, last) not in listed:
                listed.add((first, last))
                out.append((1, first, last, sentences[first][0], sentences[last][1], before[first], n, d))
    return out


NESTED = ["level", "ord", "last", "start", "end", "before", "words", "digest"]
NESTED_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]


def _nested_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 256):
        rows, cols = [], [[] for _ in NESTED]
        for i, t in enumerate(b.column(0).to_pylist()):
            found = nested_units(t)
            rows += [i] * len(found)
            for c, x in zip(cols, zip(*found)):
                c.extend(x)
        yield pa.RecordBatch.from_arrays(
            [*(c.take(pa.array(rows, pa.int32())) for c in b.columns[1:]), *map(pa.array, cols, NESTED_TYPES)],
            names=[*b.schema.names[1:], *NESTED],
        )


def repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text", row_col: str | None = None,
) -> DataFrame:
    """(row, id, start, end, n_words, n_units, first_id) of the spans to remove, in code points of the original text.

    ``row`` is ``row_col``, a unique long of a written table; without it rows are numbered in the order
    in which they are read, so that rows with one id differ.
    """
    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = docs.select(F.col(text), number.alias("row"), F.col(id_col).alias("id"))
    kind = docs.schema[id_col].dataType.simpleString()
    units = written(
        map_batches(
            rows, _nested_rows, f"row long, id {kind}, level int, ord int, last int, start long, end long, "
            "before int, words int, digest long",
        ),
        "units",
    )
    key = ["level", "digest", "words"]
    often = written(units.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "often")
    shared = written(units.join(often, key, "left_semi"), "shared-units")
    firsts = shared.groupBy(*key).agg(
        F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "row", "ord")).alias("first")
    )
    copies = shared.join(written(firsts, "firsts"), key).where("row <> first.row or ord <> first.ord").select(
        "row", "id", "level", "ord", "last", "start", "end", "before", "words", F.col("first.id").alias("first_id")
    )
    # neighbouring copied sentences are one span; lines and paragraphs are spans of their own
    number = F.row_number().over(Window.partitionBy("row", "level").orderBy("ord"))
    spans = (
        copies.withColumn("island", F.when(F.col("level") == 0, F.col("ord") - number).otherwise(F.col("ord")))
        .groupBy("row", "id", "level", "island")
        .agg(
            F.min("ord").alias("ord"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"),
            F.min("before").alias("before"), F.max(F.col("before") + F.col("words")).alias("after"),
            F.min_by("first_id", "ord").alias("first_id"),
        )
        .where((F.col("level") > 0) | (F.col("after") - F.col("before") >= min_words))
    )
    ordered = Window.partitionBy("row").orderBy("ord", F.desc("last"), "level")
    reach = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("new", (F.col("ord") > F.coalesce(reach, F.lit(-2)) + 1).cast("int"))
        .withColumn("island", F.sum("new").over(ordered))
        .groupBy("row", "id", "island")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            (F.max("after") - F.min("before")).cast("long").alias("n_words"),
            (F.max("last") - F.min("ord") + 1).cast("long").alias("n_units"),
            F.min_by("first_id", F.struct("ord", -F.col("last"), "level")).alias("first_id"),
        )
        .drop("island")
    )


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the spans cut out of ``text``, row by row, and ``removed``: (start, end) pairs in the original.

    Rows are numbered in a written table, so ids may repeat; the other columns travel in one struct.
    """
    others = F.struct(F.col(id_col), *[F.col(c) for c in docs.columns if c not in (text, id_col)])
    rows = written(
        docs.select(F.monotonically_increasing_id().alias("row"), others.alias("doc"), F.col(text).alias("text")), "numbered",
    )
    spans = repeats(rows.select("row", F.col(f"doc.`{id_col}`").alias("id"), "text"), min_words, "id", "text", "row")
    cut = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.col("removed.end"))
    starts = F.concat(F.col("removed.start"), F.array(F.length("text").cast("long")))
    pieces = F.zip_with(ends, starts, lambda s, e: F.substring(F.col("text"), (s + 1).cast("int"), (e - s).cast("int")))
    kept = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(pieces, ""))
    back = [kept.alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c.lower() != "removed"]
    return rows.join(cut, "row", "left").select(*back, "removed")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "row", "start", "end", "n_words", "n_units", F.col("first_id").alias("first_doc_id")
    )
