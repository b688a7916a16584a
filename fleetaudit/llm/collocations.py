"""Phrase collocation mining by SETM: occurrence relations, joined, counted and pruned length by length.

Texts are lower-cased (A-Z), split into pieces and these into words; everything
is counted per language.

``R1`` is the relation of word occurrences, sorted by (piece, position): one row
per *block* of about a million words of one language, with the words as codes of
the block's own dictionary and a code 0 between pieces, so that words of
different pieces are never adjacent.  ``Rk`` has the occurrences of phrases of k
words in the same order.  Each relation is written to the shared folder.  One
length after the other:

* group-count: blocks report each phrase once, with its count; the counts of all
  blocks are added up and groups under the minimum go.  A block's phrases travel
  in packed rows, dealt out by a hash of the phrase into buckets of bounded size.
* semi-join: the same bucket knows the frequent groups and answers each block
  with the ids of its frequent phrases; a block keeps only their occurrences.
* merge-join: two neighbouring occurrences of frequent phrases (positions p and
  p + 1 of one block) make one occurrence of a phrase with one word more.  A
  phrase can only be frequent if both are, so nothing is lost.

A phrase of k + 1 words is known by the ids of its first and last k words, so
equality is exact at every length; ids are unique over all languages.  A hot word
or phrase is one entry per block, whatever its count.  A text longer than a block is
cut between pieces; one piece is never cut.

Scores use decimals, so products may pass 64 bits.  The best phrases of a
language are ranked in two phases, over 256 parts first.

Defined cases: null texts count as empty, a null language as ``und``; texts
without words add nothing; an empty table gives no rows; repeated rows count each
time; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, sliced, table, text_or_empty, written

MIN_COUNT = 30
MAX_WORDS = 4
LIMIT = 2000
BLOCK = 1 << 20  # words of a block
BUCKET = 1 << 20  # phrases of a bucket, on average
_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + b"." * len(_ENDS))


class _Codes(dict):
    """Word -> code in order of first sight; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _packed(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _tokens(text: bytes) -> list[bytes]:
    """Words and, as ``.``, the ends of pieces."""
    return (text.translate(_FOLD) + b".").replace(b".", b" . ").split()


def _blocks(size: int):
    """(lang, bytes) -> R1: blocks of codes, with the block's words and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, total = TaskContext.get().partitionId(), 0, 0
        held: dict[str, tuple[_Codes, list[np.ndarray]]] = {}

        def block(lang: str) -> pa.RecordBatch:
            nonlocal made, total
            codes, arrays = held.pop(lang)
            flat = np.concatenate(arrays)
            made, total = made + 1, total - len(flat)
            counts = np.bincount(flat, minlength=len(codes))[1:]
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([lang]), pa.array([_packed(flat, "<i4")]),
                 pa.array([list(codes)[1:]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))],
                names=["block", "lang", "codes", "words", "counts"],
            )

        for b in sliced(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens, at = _tokens(text.as_py()), 0
                while at < len(tokens):  # a long text is cut between pieces
                    end = at + size
                    end = tokens.index(b".", end) + 1 if end < len(tokens) else len(tokens)
                    if lang in held and sum(map(len, held[lang][1])) + end - at > size:
                        yield block(lang)
                    codes, arrays = held.setdefault(lang, (_Codes({b".": 0}), []))
                    arrays.append(np.fromiter(map(codes.__getitem__, tokens[at:end]), np.int32, end - at))
                    total, at = total + end - at, end
                if total > 4 * size:  # many languages at once
                    yield from map(block, list(held))
        yield from map(block, list(held))

    return run


RELATION = "block long, n long, pos binary, code binary, left binary, right binary, count binary"


def _relation(block: int, pos: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Merge-join of a relation (positions ascending, phrase ids) with itself at the next position."""
    next_to = np.nonzero(pos[1:] == pos[:-1] + 1)[0]
    seen, code = np.unique(ids, return_inverse=True)
    pairs, which, count = np.unique(
        code[next_to] * len(seen) + code[next_to + 1], return_inverse=True, return_counts=True
    )
    left, right = seen[pairs // max(len(seen), 1)], seen[pairs % max(len(seen), 1)]
    packed = [(pos[next_to], "<i4"), (which, "<i4"), (left, "<i8"), (right, "<i8"), (count, "<i4")]
    return pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([len(pairs)]), *[pa.array([_packed(*v)], pa.binary()) for v in packed]],
        names=["block", "n", "pos", "code", "left", "right", "count"],
    )


def _answered(n: int, answers: list[dict]) -> np.ndarray:
    """Code -> id of the frequent phrase, -1 for the others."""
    ids = np.full(n, -1, dtype=np.int64)
    for a in answers:
        ids[np.frombuffer(a["code"], "<i4")] = np.frombuffer(a["id"], "<i8")
    return ids


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, codes, answers) -> R2 before its count."""
    for b in sliced(batches, 1):
        for row in b.to_pylist():
            codes = np.frombuffer(row["codes"], "<i4")
            ids = _answered(int(codes.max()) + 1, row["answers"])[codes]
            pos = np.nonzero(ids >= 0)[0]
            yield _relation(row["block"], pos, ids[pos])


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, n, pos, code, answers) -> the next relation before its count."""
    for b in sliced(batches, 1):
        for row in b.to_pylist():
            code, pos = np.frombuffer(row["code"], "<i4"), np.frombuffer(row["pos"], "<i4")
            ids = _answered(row["n"], row["answers"])[code]
            kept = ids >= 0
            yield _relation(row["block"], pos[kept], ids[kept])


def _spread(n_buckets: int):
    """A block's phrases -> one packed row for each bucket that gets any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            for row in b.to_pylist():
                left, right = (np.frombuffer(row[c], "<i8") for c in ("left", "right"))
                count = np.frombuffer(row["count"], "<i4")
                mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
                mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                bucket = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                full = np.nonzero(edges[1:] > edges[:-1])[0]
                parts = [order[edges[k] : edges[k + 1]] for k in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array([row["block"]] * len(full), pa.int64()),
                     *[pa.array([_packed(v[p], t) for p in parts], pa.binary())
                       for v, t in ((np.arange(len(left)), "<i4"), (left, "<i8"), (right, "<i8"), (count, "<i4"))]],
                    names=["bucket", "block", "code", "left", "right", "count"],
                )

    return run


COUNTED = "block long, code binary, id binary, left binary, right binary, count binary"


def _counted(min_count: int):
    """All packed rows of a bucket -> its frequent phrases (block null), and an answer for each block."""

    def run(rows: pa.Table) -> pa.Table:
        packed = [rows.column(c).to_pylist() for c in ("code", "left", "right", "count")]
        sizes = np.array([len(v) // 4 for v in packed[0]])
        code, left, right, count = (np.frombuffer(b"".join(v), t) for v, t in zip(packed, ("<i4", "<i8", "<i8", "<i4")))
        order = np.lexsort((right, left))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        total = np.bincount(group, weights=None if not len(count) else count.astype(np.float64)).astype(np.int64)
        frequent = total >= min_count
        ids = np.where(frequent, (rows.column("bucket")[0].as_py() << 32) + np.cumsum(frequent) - 1, -1)
        first = order[new][frequent]
        out = [(None, b"", *(_packed(v, "<i8") for v in (ids[frequent], left[first], right[first], total[frequent])))]
        of_row, blocks = ids[group], rows.column("block").to_pylist()
        for k, (s, e) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
            found = np.nonzero(of_row[s:e] >= 0)[0]
            if len(found):
                out.append((blocks[k], _packed(code[s:e][found], "<i4"), _packed(of_row[s:e][found], "<i8"), None, None, None))
        kinds = [pa.int64(), *[pa.binary()] * 5]
        return pa.Table.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["block", "code", "id", "left", "right", "count"]
        )

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 1):
        for row in b.to_pylist():
            names = ["id", "left", "right", "f"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(row[c], "<i8")) for c in ("id", "left", "right", "count")], names=names
            )


def _answers(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("answers"))


def frequent_phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    block: int = BLOCK, bucket: int = BUCKET,
) -> tuple[list[DataFrame], DataFrame]:
    """([phrases of 1 word, of 2 words, ...], words of each language); written tables.

    A phrase: ``id``, ``lang``, ``phrase``, ``last`` (its last word), ``f``, ``heads`` and ``tails`` (counts of
    its proper beginnings and endings, shortest first), ``left`` and ``right`` (ids of its first and last words
    without the last or first one).
    """
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), text_or_empty(text).cast("binary").alias("bytes"))
    r1 = written(
        map_batches(
            texts, _blocks(block), "block long, lang string, codes binary, words array<binary>, counts array<long>"
        ),
        "occurrences-1", "zstd",
    )
    entries = r1.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "e")).select(
        "block", "lang", (F.col("at") + 1).alias("code"), F.col("e.words").alias("word"), F.col("e.counts").alias("count")
    )
    totals = r1.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)).alias("n"))
    words = written(
        entries.groupBy("lang", "word")
        .agg(F.sum("count").alias("f"))
        .where(F.col("f") >= min_count)
        .withColumn("id", F.monotonically_increasing_id()),
        "phrases-1",
    )
    said = F.col("word").cast("string")
    none = F.array().cast("array<long>")
    lengths = [
        words.select("id", "lang", said.alias("phrase"), said.alias("last"), "f", none.alias("heads"), none.alias("tails"))
    ]
    found = (
        entries.join(words.select("lang", "word", "id"), ["lang", "word"])
        .groupBy("block")
        .agg(F.collect_list(F.struct("code", "id")).alias("found"))
        .select("block", F.col("found.code").alias("code"), F.col("found.id").alias("id"))
    )
    relation = written(
        map_batches(r1.select("block", "codes").join(_listed(found), "block"), _first_pairs, RELATION),
        "occurrences-2", "zstd",
    )
    for k in range(2, max_words + 1):
        n_buckets = max(64, -(-(relation.agg(F.sum("n")).first()[0] or 0) // bucket))  # one number
        spread = map_batches(
            relation.select("block", "left", "right", "count"), _spread(n_buckets),
            "bucket long, block long, code binary, left binary, right binary, count binary",
        )
        counted = written(spread.groupBy("bucket").applyInArrow(_counted(min_count), COUNTED), f"counted-{k}")
        groups = map_batches(
            counted.where("block is null").select("id", "left", "right", "count"), _unpacked,
            "id long, left long, right long, f long",
        )
        lengths.append(written(_named(groups, lengths[-1]), f"phrases-{k}"))
        if k < max_words:
            answers = _answers(counted.where("block is not null"))
            relation = written(
                map_batches(relation.select("block", "n", "pos", "code").join(answers, "block"), _longer, RELATION),
                f"occurrences-{k + 1}", "zstd",
            )
    return lengths, totals


def _listed(found: DataFrame) -> DataFrame:
    """Arrays of codes and ids as one packed answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            for k in range(b.num_rows):
                code, ids = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                answer = [{"code": _packed(code, "<i4"), "id": _packed(ids, "<i8")}]
                kind = pa.list_(pa.struct([("code", pa.binary()), ("id", pa.binary())]))
                yield pa.RecordBatch.from_arrays([b.column(0)[k : k + 1], pa.array([answer], kind)], names=["block", "answers"])

    return map_batches(found, run, "block long, answers array<struct<code: binary, id: binary>>")


def _named(groups: DataFrame, shorter: DataFrame) -> DataFrame:
    """Groups (id, left, right, f) with what their first and last words bring."""
    first = shorter.select(
        F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), F.concat("heads", F.array("f")).alias("heads")
    )
    last = shorter.select(F.col("id").alias("right"), "last", F.concat("tails", F.array("f")).alias("tails"))
    return (
        groups.join(first, "left").join(last, "right")
        .select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", "heads", "tails", "left", "right")
    )


def _decimal(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    limit: int = LIMIT, block: int = BLOCK, bucket: int = BUCKET,
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Score: 2,000,000 times the phrase's count over the sum of the counts of its two parts, at the cut where
    that is least.  Phrases that occur in four of five cases inside one longer frequent phrase are left out.
    """
    lengths, totals = frequent_phrases(docs, lang, text, min_count, max_words, block, bucket)
    scored: DataFrame | None = None
    for k in range(2, max_words + 1):
        here = lengths[k - 1]
        if k < max_words:
            longer = lengths[k]
            # a longer phrase holds this one inside a phrase of one word more that is at least as frequent
            inside = longer.select(F.col("left").alias("id"), "f").unionByName(longer.select(F.col("right").alias("id"), "f"))
            most = inside.groupBy("id").agg(F.max("f").alias("most"))
            here = here.join(most, "id", "left").where(
                F.col("most").isNull() | (_decimal(F.col("most")) * 100 < _decimal(F.col("f")) * 80)
            )
        cuts = F.transform(
            F.sequence(F.lit(1), F.lit(k - 1)),
            lambda j: F.struct(j.alias("cut"), F.element_at("heads", j).alias("l"), F.element_at("tails", F.lit(k) - j).alias("r")),
        )
        rated = here.select("lang", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("c")).select(
            "lang", "phrase", "a", "c.*",
            F.expr("cast(2000000 * cast(a as decimal(20,0)) div (cast(c.l as decimal(20,0)) + cast(c.r as decimal(20,0))) as bigint)").alias("score"),
        )
        least = rated.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("m")) if k > 2 else rated.select(
            "lang", "phrase", F.struct("score", "cut", "a", "l", "r").alias("m")
        )
        scored = least if scored is None else scored.unionByName(least)
    rows = scored.select("lang", "phrase", "m.score", "m.a", "m.l", "m.r").withColumn(
        "part", F.pmod(F.xxhash64("phrase"), F.lit(256))
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    in_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    kept = rows.withColumn("place", in_part).where(F.col("place") <= limit).drop("place", "part")
    return (
        kept.withColumn("rank", rank).where(F.col("rank") <= limit)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p
  FROM (SELECT lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)),
listed AS (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM listed),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
ahead AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4
  FROM words WINDOW p AS (PARTITION BY piece ORDER BY pos)),
f1 AS (SELECT lang, w1, count(*) AS f FROM ahead GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
f4 AS (SELECT lang, w1, w2, w3, w4, count(*) AS f FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
inside AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, concat_ws(' ', w1, w2) AS phrase, f FROM f3 UNION ALL SELECT lang, concat_ws(' ', w2, w3), f FROM f3
    UNION ALL SELECT lang, concat_ws(' ', w1, w2), f FROM f4 UNION ALL SELECT lang, concat_ws(' ', w2, w3), f FROM f4
    UNION ALL SELECT lang, concat_ws(' ', w3, w4), f FROM f4
    UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), f FROM f4 UNION ALL SELECT lang, concat_ws(' ', w2, w3, w4), f FROM f4)
  GROUP BY ALL),
cuts AS (
  SELECT c.lang, concat_ws(' ', c.w1, c.w2) AS phrase, c.f AS a, 1 AS cut, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3), c.f, 1, x.f, y.f
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3), c.f, 2, x.f, y.f
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3, c.w4), c.f, 1, x.f, y.f
  FROM f4 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1
  JOIN f3 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3 AND y.w3 = c.w4
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3, c.w4), c.f, 2, x.f, y.f
  FROM f4 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2
  JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w3 AND y.w2 = c.w4
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3, c.w4), c.f, 3, x.f, y.f
  FROM f4 c JOIN f3 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 AND x.w3 = c.w3
  JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w4),
scored AS (
  SELECT *, CAST((CAST(2000000 AS HUGEINT) * a) // (l + r) AS BIGINT) AS score FROM cuts),
least AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS k FROM scored),
ranked AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score,
    row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM least s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE s.k = 1 AND (i.most IS NULL OR 100 * i.most < 80 * s.a))
SELECT k.lang, k.rank, k.phrase, k.a, k.l, k.r, t.n, k.score
FROM ranked k JOIN totals t ON t.lang = k.lang WHERE k.rank <= 2000"""
