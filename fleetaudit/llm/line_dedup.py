"""Line dedup with a log-template tree, in DataFrame functions only.

The tree has a fixed depth: a line goes to the leaf given by its number of
tokens and its leading tokens, where tokens that hold a digit count as the
variable ``<*>``.  Inside a leaf, lines are cut into at most ``SEGMENTS``
equal runs of tokens (single tokens for short lines); two lines are alike if at
least ``similarity`` of their segments agree.  From the most frequent line down,
a line that is like no leader becomes a leader, and every line joins the most
frequent leader it is like.  The differing segments are the template's variable
fields.

Alike lines are found by keys, one for each choice of the least number of
segments that must agree: two lines share a key if and only if they are alike, so
a key has one leader at most and no pair is missed or compared.  Leaders are
found in rounds: a line heavier than all undecided lines it is like leads, and
the lines like it are decided, until none is left.

A template recurs if it occurs in ``min_docs`` or more documents.  Documents
count by content, so that copies of one text do not make its lines boilerplate;
texts that differ anywhere are distinct, near copies too.  All lines of a
recurring template are dropped from all documents.

The verdict on a line depends on the document's text alone, so texts are
joined back by content key and equal rows share one verdict.

Defined cases: no document is dropped, one that loses all lines keeps an empty
text; null texts stay null; lines with fewer than ``min_tokens`` tokens always
stay; other columns pass through, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_key, written

SEGMENTS = 8
VARIABLE = r"(?<!\S)[^\s\d]*+\d\S*"


def line_occurrences(docs: DataFrame, lead: int = 3, text: str = "text") -> DataFrame:
    """One row per line: text key, line position, tokens, line hash, leaf, segments."""
    split = docs.where(F.length(text) > 0).select(text_key(text).alias("tk"), F.split(F.col(text), "\n").alias("lines"))
    lines = split.select("tk", F.posexplode("lines").alias("pos", "text"))
    masked = F.when(F.col("text").rlike(r"\d"), F.regexp_replace("text", VARIABLE, "<*>")).otherwise(F.col("text"))
    tokens = lines.select(
        "tk", "pos", F.array_remove(F.split(masked, r"[ \t\r\f\x0B]+"), "").alias("t"),
    )
    counted = tokens.select("*", F.size("t").alias("n"), F.greatest(F.least(F.size("t"), F.lit(SEGMENTS)), F.lit(1)).alias("k"))
    segment = [
        F.when(F.lit(i) < F.col("k"), F.xxhash64(F.expr(f"slice(t, {i} * n div k + 1, {i + 1} * n div k - {i} * n div k)")))
        for i in range(SEGMENTS)
    ]
    return counted.select(
        "tk", "pos", "n", F.xxhash64("t").alias("line"), F.xxhash64("n", F.slice("t", 1, lead)).alias("leaf"),
        F.array_compact(F.array(*segment)).alias("segments"),
    )


def agreement_keys(leaf: str = "leaf", segments: str = "segments", similarity: float = 0.75) -> Column:
    """Array of keys: two lines of a leaf share one if and only if at least ``similarity`` of their segments agree."""
    by_size = []
    for k in range(1, SEGMENTS + 1):
        least = next(m for m in range(k + 1) if m >= similarity * k or m == k)
        chosen = [
            F.xxhash64(F.col(leaf), F.lit(i), *(F.get(segments, F.lit(j)) for j in some))
            for i, some in enumerate(combinations(range(k), least))
        ]
        by_size.append((F.size(segments) == k, F.array(*chosen)))
    out = F.when(*by_size[0])
    for size, keys in by_size[1:]:
        out = out.when(size, keys)
    return out


def line_templates(occurrences: DataFrame, similarity: float = 0.75) -> DataFrame:
    """(line, template): each distinct line of a leaf with its template's representative line."""
    lines = written(
        occurrences.groupBy("leaf", "line").agg(
            F.count(F.lit(1)).alias("weight"), F.first("segments").alias("segments")
        ),
        "distinct-lines",
    )
    keyed = lines.select("line", "weight", F.explode(agreement_keys(similarity=similarity)).alias("key"))
    shared = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"), "shared-keys")
    alike = written(keyed.join(shared, "key", "left_semi"), "alike-lines")
    left, leaders = alike, []
    while not left.isEmpty():  # the heaviest undecided line leads, so each round decides some
        tops = written(left.groupBy("key").agg(F.max(F.struct("weight", "line")).alias("top")), "tops")
        led = written(
            left.join(tops, "key").groupBy("line").agg(F.min(F.col("line") == F.col("top.line")).alias("first")).where("first").select("line"),
            "leading",
        )
        found = written(left.join(led, "line", "left_semi"), "leaders")
        decided = written(left.join(found.select("key"), "key", "left_semi").select("line").distinct(), "decided")
        leaders.append(found)
        left = written(left.join(decided, "line", "left_anti"), "undecided")
    if not leaders:
        return lines.select("line", F.col("line").alias("template"))
    every = reduce(DataFrame.union, leaders).select("key", F.struct("weight", "line").alias("leader"))
    joined = alike.join(every, "key").groupBy("line").agg(F.max("leader").alias("best"))
    return lines.select("line").join(joined, "line", "left").select(
        "line", F.coalesce("best.line", "line").alias("template")
    )


def recurring_lines(
    occurrences: DataFrame, min_docs: int = 10, similarity: float = 0.75, min_tokens: int = 3
) -> DataFrame:
    """(line, template, n_docs) of the lines whose template recurs across documents."""
    long = occurrences.where(F.col("n") >= min_tokens)
    full = long.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= min_docs).select("leaf")
    # written, so that the join deals out both sides (or sends the few leaves) and a hot leaf can be split
    kept = written(long.join(written(full, "leaves"), "leaf", "left_semi"), "kept-lines")
    templates = written(line_templates(kept, similarity), "templates")
    seen = kept.select("line", "tk").distinct().join(templates, "line")
    counts = (
        seen.select("template", "tk").distinct()
        .groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"))
        .where(F.col("n_docs") >= min_docs)
    )
    return templates.join(counts, "template")


def drop_recurring_lines(
    docs: DataFrame, lead: int = 3, min_docs: int = 10, similarity: float = 0.75,
    min_tokens: int = 3, text: str = "text",
) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``, and ``_dropped`` (array of line numbers)."""
    occurrences = written(line_occurrences(docs, lead, text), "lines")
    recurring = written(recurring_lines(occurrences, min_docs, similarity, min_tokens), "recurring")
    drops = written(
        occurrences.select("tk", "pos", "line")
        .join(recurring.select("line"), "line", "left_semi")
        .select("tk", "pos")
        .distinct()  # copies of a text gave the same positions once each
        .groupBy(F.col("tk").alias("_tk"))
        .agg(F.sort_array(F.collect_list("pos")).alias("_dropped")),
        "drops",
    )
    # the drops grow with the documents: merged at every size, never broadcast
    joined = docs.withColumn("_tk", text_key(text)).join(drops.hint("merge"), "_tk", "left").drop("_tk")
    lines = F.split(F.col(text), "\n")
    # kept runs lie between neighbouring dropped lines; -1 and the line count close both ends
    cuts = F.concat(F.array(F.lit(-1)), F.col("_dropped"), F.array(F.size("_lines")))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("_cuts") - 2),
        lambda i: F.slice("_lines", F.get("_cuts", i) + 2, F.get("_cuts", i + 1) - F.get("_cuts", i) - 1),
    )
    cut = (
        joined.withColumn("_lines", F.when(F.col("_dropped").isNotNull(), lines))
        .withColumn("_cuts", cuts)
        .withColumn(text, F.when(F.col("_dropped").isNull(), F.col(text)).otherwise(F.array_join(F.flatten(runs), "\n")))
    )
    return cut.drop("_lines", "_cuts")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = drop_recurring_lines(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped_lines"),
        F.array_join(F.transform("_dropped", lambda x: x.cast("string")), ",").alias("dropped_lines"),
        F.length("text").cast("long").alias("n_chars_kept"),
        F.md5("text").alias("kept_md5"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The other columns travel in one struct, so that none clashes with a helper column."""
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text")
    out = drop_recurring_lines(packed)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
