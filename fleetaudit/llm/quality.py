"""Quality rules by cross-document line frequency.

Every document gives the 128-bit hashes of its normalised lines (lower case,
digits as 0, white space squeezed).  Per host, a line is boilerplate if more than
``max_docs`` distinct documents hold it.  Such lines are removed, and a document
that keeps under ``min_share`` of its words is depleted and rejected.  Documents
count by content, so that copies of one text
do not make its lines boilerplate; texts that differ anywhere are distinct, near
copies too.

The base rules of the contract reject first: under 50 words, or over half of
the words in repeated 3-word windows.

Defined cases: null and empty texts have no words and are rejected; rows
without a host form one host; repeated rows get equal verdicts; documents whose
lines are all rare are never depleted and keep their text; extra columns pass
through packed in one struct, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, sliced, table, text_key, written

MAX_DOCS = 20
MIN_SHARE = 0.3
SYMBOLS = "#*$%&|<>"
DIGITS = re.compile("[0-9]+")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Number of words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    window = ids[:n]
    for i in range(1, width):  # exact: each step renumbers the (window, next word) pairs
        window = np.unique(window * len(number) + ids[i : n + i], return_inverse=True)[1]
    twice = np.bincount(window)[window] > 1
    hit = np.zeros(len(words), dtype=bool)
    for i in range(width):
        hit[i : n + i] |= twice
    return int(hit.sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def lines_by_hash(text: str | None) -> dict[bytes, list[int]]:
    """{hash of a normalised line: [words in all such lines, their line numbers from 0...]}."""
    out: dict[bytes, list[int]] = {}
    for at, line in enumerate((text or "").split("\n")):
        words = DIGITS.sub("0", line.lower()).split()
        if words:
            found = out.setdefault(xxhash.xxh3_128_digest(" ".join(words)), [0])
            found[0] += len(words)
            found.append(at)
    return out


LINES = "lines array<struct<line: binary, words: long, at: array<int>>>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64()), ("at", pa.list_(pa.int32()))]))
    for b in sliced(batches):
        texts = b.column(0).to_pylist()
        found = list(zip(*map(measures, texts))) or [()] * 5
        lines = [[{"line": h, "words": x[0], "at": x[1:]} for h, x in lines_by_hash(t).items()] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [*b.columns[1:], *(pa.array(x, pa.int64()) for x in found), pa.array(lines, kind)],
            names=[*b.schema.names[1:], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
        )


def _host(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))


def verdicts(
    docs: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id",
    max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE,
) -> DataFrame:
    """Per row of ``docs``: id, host, text key, measures, n_frequent_words, removed_lines (numbers from 0), base_failed, kept."""
    rows = docs.select(
        F.col(text).alias("text"), F.col(id_col).alias("id"), _host(host).alias("host"), text_key(text).alias("tk"), F.monotonically_increasing_id().alias("row"),
    )
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    measured = written(map_batches(rows, _measure, f"{kind}, {BASE}, {LINES}"), "measured")
    lines = measured.select("row", "host", "tk", F.explode("lines").alias("x")).select("row", "host", "tk", "x.*")
    frequent = (
        lines.select("host", "line", "tk").distinct()
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") > max_docs)
        .select("host", "line")
    )
    taken = lines.join(written(frequent, "frequent"), ["host", "line"], "left_semi").groupBy("row").agg(
        F.sum("words").alias("frequent"), F.array_sort(F.flatten(F.collect_list("at"))).alias("removed")
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("frequent", F.lit(0))
    return measured.drop("lines").join(taken, "row", "left").select(
        "id", "host", "tk", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("frequent", F.lit(0)).alias("n_frequent_words"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"),
        failed.alias("base_failed"),
        (~failed & (left >= min_share * F.col("n_words"))).alias("kept"),
    )


def accepted(docs: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rejected rows, the others without their frequent lines."""
    judged = written(  # a verdict depends on host and text only
        verdicts(docs, host, text, id_col)
        .where(~F.col("kept") | (F.size("removed_lines") > 0))
        .groupBy("host", "tk").agg(F.first("kept").alias("kept"), F.first("removed_lines").alias("cut")),
        "verdicts",
    )
    here = docs.select(F.struct(*docs.columns).alias("row"), _host(host).alias("host"), text_key(text).alias("tk"))
    left = here.join(judged, ["host", "tk"], "left").where("coalesce(kept, true)")
    said = f"row.`{text}`"
    rest = (
        f"transform(array(split({said}, '\\n', -1)), l -> "
        "array_join(transform(array_except(sequence(0, size(l) - 1), cut), i -> l[i]), '\n'))[0]"
    )
    return left.select(
        *[F.expr(f"if(cut IS NULL, {said}, {rest})").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_frequent_words", F.size("removed_lines").cast("long").alias("n_removed_lines"),
        F.array_join(F.col("removed_lines").cast("array<string>"), ",").alias("removed_lines"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs)


#: Lines are compared by their normalised text itself; \x1c-\x1f and spaces beyond ASCII part words, too.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT id, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM d),
ahead AS (SELECT id, pos, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY id ORDER BY pos)),
often AS (SELECT id, pos, count(*) OVER (PARTITION BY id, w1, w2, w3) AS n FROM ahead WHERE w3 IS NOT NULL),
hit AS (SELECT id, count(DISTINCT k) AS n FROM (SELECT id, unnest([pos, pos + 1, pos + 2]) AS k FROM often WHERE n > 1) GROUP BY id),
lines AS (SELECT id, host, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS nr FROM d),
dup AS (
  SELECT id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
said AS (
  SELECT id, host, t, nr, regexp_extract_all(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\s\x0B\x1C-\x1F\x85\p{Z}]+') AS ws FROM lines),
frequent AS (
  SELECT host, array_to_string(ws, ' ') AS line FROM said WHERE len(ws) > 0 GROUP BY ALL HAVING count(DISTINCT t) > 20),
gone AS (
  SELECT s.id, CAST(sum(len(s.ws)) AS BIGINT) AS words, count(*) AS n, string_agg(CAST(nr AS VARCHAR), ',' ORDER BY nr) AS removed
  FROM said s JOIN frequent f ON f.host = s.host AND f.line = array_to_string(s.ws, ' ') GROUP BY s.id),
m AS (
  SELECT d.id, d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(d.ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words, coalesce(gone.words, 0) AS n_frequent_words,
    coalesce(gone.n, 0) AS n_removed_lines, coalesce(gone.removed, '') AS removed_lines
  FROM d LEFT JOIN dup ON dup.id = d.id LEFT JOIN hit ON hit.id = d.id LEFT JOIN gone ON gone.id = d.id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * (n_words - n_frequent_words) >= 3 * n_words AS kept,
  n_frequent_words, n_removed_lines, removed_lines
FROM m"""
