"""Benchmark decontamination with one Aho-Corasick automaton.

Item texts are normalised (A-Z to lower case, runs of non-word bytes to one
space) and cut into windows of ``WINDOW`` consecutive words; an item with
fewer words is one window.  All windows, with a space at both ends, go into
one automaton.  A document is normalised the same way and scanned once; the
character ends of the matches map to word numbers and, for spans, to offsets in
the original text.

The automaton is built in each Python worker from the windows, which are sent
to the tasks only while the items' text is within ``MAX_ITEM_BYTES``.  A larger
benchmark is cut into parts of half that size by item, each part scans the
documents on its own (memory stays, time grows with the benchmark), and the hit words of the parts are united per document.

Defined cases: null texts have no words; items without words and items with a
null id match nothing that is listed (a null id still marks its words as hit);
items of one id count as one item; repeated documents give repeated rows; an
empty benchmark hits nothing; extra columns pass through (``clean``) or are not
read.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, per_worker, sliced, table, written

WINDOW = 13
MAX_ITEM_BYTES = 1 << 20  # makes an automaton of about 500 MB in each Python worker
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: A-Z to lower case; all other ASCII bytes but 0-9 and a-z to a space.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> set[str]:
    if not words:
        return set()
    return {" " + b" ".join(words[i : i + width]).decode() + " " for i in range(max(1, len(words) - width + 1))}


def automaton(items: list[tuple[str | None, str | None]], width: int = WINDOW) -> ahocorasick.Automaton:
    """Each window's value: (its number of words, its characters, ids of its items)."""
    owners: dict[str, set[str | None]] = {}
    for item_id, text in items:
        for w in windows_of(words_of(text), width):
            owners.setdefault(w, set()).add(item_id)
    tree = ahocorasick.Automaton()
    for w, ids in owners.items():
        tree.add_word(w, (w.count(" ") - 1, len(w), ids))
    if owners:
        tree.make_automaton()
    return tree


def scan(tree: ahocorasick.Automaton, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(number of words, spans of hit words [first, end), item ids)."""
    words = words_of(text)
    if not words or not len(tree):
        return len(words), [], set()
    flat = " " + b" ".join(words).decode() + " "
    ids: set[str | None] = set()
    found = []
    for end, (n, chars, owners) in tree.iter(flat):
        ids |= owners
        found.append((end + 1 - chars, n))
    if not found:
        return len(words), [], set()
    starts = [m.start() for m in re.finditer(" ", flat)]  # word k begins after the k-th space
    spans: list[list[int]] = []
    for first, n in sorted((bisect_right(starts, at) - 1, n) for at, n in found):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], first + n)
        else:
            spans.append([first, first + n])
    return len(words), [(a, b) for a, b in spans], {x for x in ids if x is not None}


def _matcher(items: Broadcast, width: int):
    key = f"items-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = per_worker(key, lambda: automaton(items.value, width))
        for b in sliced(batches):
            n_words, spans, ids, offsets = [], [], [], []
            for text in b.column(0).to_pylist():
                n, hit, who = scan(tree, text)
                n_words.append(n)
                spans.append([{"first": a, "end": e} for a, e in hit])
                ids.append(sorted(who))
                if hit:
                    at = [m.span() for m in WORD.finditer(re.sub("[A-Z]", lambda m: m[0].lower(), text))]
                    offsets.append([{"start": at[a][0], "end": at[e - 1][1]} for a, e in hit])
                else:
                    offsets.append([])
            pair = lambda x, y: pa.list_(pa.struct([(x, pa.int64()), (y, pa.int64())]))
            found = pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(spans, pair("first", "end")),
                 pa.array(ids, pa.list_(pa.string())), pa.array(offsets, pair("start", "end"))],
                names=["n_words", "hits", "items", "offsets"],
            )
            yield pa.RecordBatch.from_arrays([*b.columns[1:], found], names=[*b.schema.names[1:], "found"])

    return run


FOUND = (
    "found struct<n_words: long, hits: array<struct<first: long, end: long>>, items: array<string>, "
    "offsets: array<struct<start: long, end: long>>>"
)


def _schema(df: DataFrame) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [FOUND])


def matches(docs: DataFrame, items: DataFrame, text: str = "text", width: int = WINDOW) -> DataFrame:
    """``docs`` as struct ``record`` with struct ``found``: word count, hit word spans, item ids, character offsets."""
    spark = docs.sparkSession
    rows = docs.select(F.col(text).alias("text"), F.struct(*docs.columns).alias("record"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    parts = -(-size // MAX_ITEM_BYTES) or 1
    kind = _schema(rows.drop("text"))
    if parts == 1:  # the usual case: the items' size is within the bound
        sent = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])
        return map_batches(rows, _matcher(sent, width), kind)
    # 2x the parts, as items are dealt by hash; equal windows of several parts unite below
    parts *= 2
    numbered = written(rows.withColumn("at", F.monotonically_increasing_id()), "documents")
    scans = None
    for p in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        sent = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])
        source = numbered.select("text", "at")
        one = map_batches(source, _matcher(sent, width), _schema(source.drop("text"))).where(F.size("found.hits") > 0)
        scans = one if scans is None else scans.unionByName(one)
    per_doc = scans.groupBy("at").agg(
        F.array_sort(F.flatten(F.collect_list("found.hits"))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("found.offsets"))).alias("offsets"),
    )
    none = spark.sparkContext.broadcast([])
    counted = map_batches(numbered, _matcher(none, width), _schema(numbered.drop("text")))
    united = counted.join(per_doc, "at", "left")
    return united.select("record", F.struct(
        F.col("found.n_words"),
        _united("hits", "first", "end").alias("hits"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        _united("offsets", "start", "end").alias("offsets"),
    ).alias("found"))


def _united(col: str, a: str, b: str) -> Column:
    """Sorted spans with overlaps merged."""
    kind = f"array<struct<{a}: long, {b}: long>>"
    return F.aggregate(
        F.coalesce(col, F.array().cast(kind)),
        F.array().cast(kind),
        lambda out, s: F.when(
            (F.size(out) > 0) & (s[a] <= F.element_at(out, -1)[b]),
            F.concat(
                F.slice(out, 1, F.size(out) - 1),
                F.array(F.struct(F.element_at(out, -1)[a].alias(a), F.greatest(F.element_at(out, -1)[b], s[b]).alias(b))),
            ),
        ).otherwise(F.concat(out, F.array(s))),
    )


def n_hit() -> Column:
    return F.aggregate("found.hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def contaminated() -> Column:
    """The contract's rule: a hit word, and hit words at least a twentieth of all words."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("found.n_words"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows."""
    return matches(docs, items, text).where(~contaminated()).select("record.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = matches(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "record.doc_id",
        "found.n_words",
        n_hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))
