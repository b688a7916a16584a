"""Suffix-array dedup: repeated byte windows by a depth-limited radix sort.

A suffix array that is sorted only through ``WINDOW`` bytes has the repeated
windows as its groups of equal suffixes.  The groups are found by
most-significant-digit passes; each pass is a shuffle on a digit, and only
groups that still hold several different continuations go on to the next.

Suffixes need not be sorted one by one.  Every window has an anchor, its
``GRAM``-byte gram of least hash, and neighbouring windows share it; a *cell*
is a run of windows of one text with one anchor (about 185 windows).  Equal
windows have their anchor at the same offset, so the passes are:

1. digit = anchor gram.  A cell alone in its group has no repeated window.  If
   all cells of a group have equal content (their *hull*: all bytes that their
   windows cover), all their windows are repeated.
2. cells of mixed groups: equal hulls are repeated as in 1, and one cell of
   each hull goes on, cut into *strips* of ``STRIP`` window starts at offsets
   counted from the anchor.  Digit = the bytes common to the strip's windows.
3. strips of mixed groups: digit = the whole window.  Equal groups of this
   pass are exactly the repeated windows that are left.

No group is ever gathered: a pass sees a group's least and greatest values
only (partial aggregation), and rows find their group's verdict by a join that
Spark can split.  The first digit is a 64-bit gram hash, where a clash only
costs work; all equalities that decide use 64-bit content hashes inside an
equal gram (pass 1) or 128-bit hashes (passes 2 and 3).

Texts are known by their 128-bit content key; equal texts give equal results.

Defined cases: null counts as empty; texts shorter than a window lose nothing;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, per_worker, sliced, table, text_key, text_or_empty, written

WINDOW = 400
GRAM = 32
STRIP = 32
CHUNK = 1 << 18  # bytes hashed at once; a longer text is cut into runs of windows
BASE = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n, inverse = CHUNK + WINDOW + 1, pow(BASE, -1, 1 << 64)
    up, down = (
        np.cumprod(np.array([1] + [b] * (n - 1), dtype=np.uint64), dtype=np.uint64) for b in (BASE, inverse)
    )
    return up, down


def _anchors(data: np.ndarray, window: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: the anchor's position; for each position: its gram's hash."""
    up, down = powers
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    gram = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    # the leftmost least hash: position in the low bits, so that one minimum finds both
    low = (gram & ~np.uint64((1 << 20) - 1)) | np.arange(len(gram), dtype=np.uint64)
    width, span = window - GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & np.uint64((1 << 20) - 1)).astype(np.int64), gram


def _chunks(values: list[bytes], window: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Pieces of at most CHUNK bytes (and a window): (bytes, [(row, start in bytes, end, start in text)])."""
    parts: list[bytes] = []
    where: list[tuple[int, int, int, int]] = []
    size = 0
    for row, v in enumerate(values):
        for at in range(0, max(len(v) - window + 1, 0), CHUNK):
            piece = v[at : at + CHUNK + window - 1]
            if parts and size + len(piece) > CHUNK + window - 1:
                yield b"".join(parts), where
                parts, where, size = [], [], 0
            where.append((row, size, size + len(piece), at))
            parts.append(piece)
            size += len(piece)
    if parts:
        yield b"".join(parts), where


def text_cells(values: list[bytes], window: int = WINDOW) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk: row, anchor, first and last window start (all in the text), gram hash, hull hash."""
    powers = per_worker(f"powers-{CHUNK}", _powers)
    for data, where in _chunks(values, window):
        anchor, gram = _anchors(np.frombuffer(data, dtype=np.uint8), window, powers)
        piece = np.full(len(anchor), -1, dtype=np.int64)
        for k, (_, s, e, _) in enumerate(where):
            piece[s : e - window + 1] = k
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
        first = np.nonzero(new)[0]
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        real = piece[first] >= 0
        first, last = first[real], last[real]
        spot, k = anchor[first], piece[first]
        shape = ((spot - first) << 10) | (spot - last + WINDOW)
        hull = np.fromiter(
            (xxhash.xxh3_64_intdigest(data[s : e + window], h) for s, e, h in zip(first.tolist(), last.tolist(), shape.tolist())),
            dtype=np.uint64, count=len(first),
        )
        at = np.array([(row, start - s) for row, s, _, start in where], dtype=np.int64).reshape(-1, 2)
        shift = at[k, 1]
        yield at[k, 0], spot + shift, first + shift, last + shift, gram[spot], hull


def _cell_rows(window: int):
    """(tk, bytes) -> the text's cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            values = [v or b"" for v in b.column(1).to_pylist()]
            for row, anchor, first, last, gram, hull in text_cells(values, window):
                span = (anchor << 20) | ((anchor - first) << 10) | (anchor - last)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(span), pa.array(gram.view(np.int64)), pa.array(hull.view(np.int64))],
                    names=["tk", "cell", "gram", "hull"],
                )

    return run


def _unpack(cell: int) -> tuple[int, int, int]:
    """(anchor, first, last window start) of a packed cell."""
    anchor = cell >> 20
    return anchor, anchor - (cell >> 10 & 1023), anchor - (cell & 1023)


def _content_rows(window: int):
    """(tk, bytes, cells) -> each cell with the bytes that its windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            for k in range(b.num_rows):
                tk, v, found = (b.column(i)[k].as_py() for i in range(3))
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    content = [v[f : e + window] for _, f, e in map(_unpack, part)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([tk] * len(part), pa.binary()), pa.array(part, pa.int64()), pa.array(content, pa.binary())],
                        names=["tk", "cell", "content"],
                    )

    return run


def _halves(digests: list[int]) -> list[pa.Array]:
    return [pa.array([(d >> s & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for d in digests], pa.int64()) for s in (64, 0)]


def _strip_rows(window: int):
    """(tk, cell, content) -> the cell's strips: span of window starts, digit, hull."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows: list[int] = []
            spans, digits, hulls = [], [], []
            for k, (cell, v) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                m, first, last = _unpack(cell)
                for j in range((m - last) // STRIP, (m - first) // STRIP + 1):
                    top = m - j * STRIP  # the strip's greatest window start, and where the common bytes begin
                    s, e = max(first, top - STRIP + 1), min(last, top)
                    rows.append(k)
                    spans.append(s << 20 | e - s)
                    digits.append(xxhash.xxh3_128_intdigest(v[top - first : top - STRIP + 1 + window - first], j))
                    hulls.append(xxhash.xxh3_64_intdigest(v[s - first : e + window - first], (m - s) << 10 | (m - e)) - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int32())), b.column(1).take(pa.array(rows, pa.int32())),
                 pa.array(spans, pa.int64()), *_halves(digits), pa.array(hulls, pa.int64())],
                names=["tk", "cell", "span", "d1", "d2", "hull"],
            )

    return run


def _window_rows(window: int):
    """(tk, cell, content, spans of window starts) -> one row per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows: list[int] = []
            firsts, digits = [], []
            for k in range(b.num_rows):
                _, first, _ = _unpack(b.column(1)[k].as_py())
                v = b.column(2)[k].as_py()
                for span in b.column(3)[k].as_py():
                    s, n = (span >> 20), (span & 0xFFFFF) + 1
                    rows += [k] * n
                    firsts += range(s, s + n)
                    digits += [xxhash.xxh3_128_intdigest(v[i - first : i - first + window]) for i in range(s, s + n)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int32())), pa.array(firsts, pa.int64()), *_halves(digits)],
                names=["tk", "first", "d1", "d2"],
            )

    return run


def repeated_windows(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(tk, first, more): by text key, the runs first..first+more of window starts whose windows also start elsewhere."""
    rows = docs.select(text_key(text).alias("tk"), text_or_empty(text).cast("binary").alias("bytes"))
    # pass 1; groups are written before they are joined: then Spark deals out both sides and can split a hot digit
    found = map_batches(rows, _cell_rows(window), "tk binary, cell long, gram long, hull long")
    groups = written(
        found.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"), F.min("hull").alias("lo"), F.max("hull").alias("hi"))
        .where("n > 1")
        .select("gram", F.expr("lo <> hi").alias("mixed")),
        "grams",
    )
    shared = written(found.join(groups, "gram"), "cells")
    first = F.shiftright("cell", 20) - F.shiftright("cell", 10).bitwiseAND(F.lit(1023))
    more = F.shiftright("cell", 10).bitwiseAND(F.lit(1023)) - F.col("cell").bitwiseAND(F.lit(1023))
    of_cell = ["tk", first.alias("first"), more.alias("more")]
    same = shared.where("not mixed").select(*of_cell)
    # pass 2
    mixed = shared.where("mixed").withColumn("id", F.xxhash64("tk", "cell"))
    hulls = mixed.groupBy("gram", "hull").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    judged = written(mixed.join(written(hulls, "hulls"), ["gram", "hull"]), "judged")
    twice = judged.where("n > 1").select(*of_cell)
    chosen = judged.where("id = one").groupBy("tk").agg(F.collect_set("cell").alias("cells"))
    contents = written(
        map_batches(
            rows.dropDuplicates(["tk"]).join(chosen, "tk").select("tk", "bytes", "cells"),
            _content_rows(window), "tk binary, cell long, content binary",
        ),
        "contents",
    )
    strips = map_batches(contents, _strip_rows(window), "tk binary, cell long, span long, d1 long, d2 long, hull long")
    digit, cell_id = ["d1", "d2"], F.xxhash64("tk", "cell")
    strip_groups = (
        strips.groupBy(*digit)
        .agg(F.min(cell_id).alias("a"), F.max(cell_id).alias("b"), F.min("hull").alias("lo"), F.max("hull").alias("hi"))
        .where("a <> b")
        .select(*digit, F.expr("lo <> hi").alias("mixed"))
    )
    kept = written(strips.drop("hull").join(written(strip_groups, "strip-groups"), digit).drop(*digit), "kept-strips")
    all_equal = kept.where("not mixed").select(
        "tk", F.shiftright("span", 20).alias("first"), F.col("span").bitwiseAND(F.lit(0xFFFFF)).alias("more")
    )
    # pass 3
    left = kept.where("mixed").groupBy("tk", "cell").agg(F.collect_list("span").alias("spans"))
    windows = map_batches(
        contents.join(left, ["tk", "cell"]).select("tk", "cell", "content", "spans"),
        _window_rows(window), "tk binary, first long, d1 long, d2 long",
    )
    start_id = F.xxhash64("tk", "first")
    equal = (
        windows.groupBy(*digit)
        .agg(F.min(start_id).alias("a"), F.max(start_id).alias("b"))
        .where("a <> b")
        .select(*digit)
    )
    single = windows.join(written(equal, "equal"), digit, "left_semi").select(
        "tk", "first", F.lit(0).cast("long").alias("more")
    )
    return same.unionByName(twice).unionByName(all_equal).unionByName(single)


def _merged(ranges: list[int] | None, window: int) -> list[tuple[int, int]]:
    """Byte spans covered by runs of window starts, each packed as first << 20 | length."""
    spans: list[list[int]] = []
    for first, last in sorted((r >> 20, (r >> 20) + (r & 0xFFFFF)) for r in ranges or ()):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + window)
        else:
            spans.append([first, last + window])
    return [(s, e) for s, e in spans]


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            kept, spans = [], []
            for v, ranges in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, merged = v or b"", _merged(ranges, window)
                edges = [0, *(x for s in merged for x in s), len(v)]
                kept.append(b"".join(v[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                spans.append([{"start": s, "end": e} for s, e in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[2:], pa.array(kept, pa.binary()), pa.array(spans, kind)],
                names=[*b.schema.names[2:], "kept", "spans"],
            )

    return run


def remove_repeats(docs: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """Columns ``keep`` with ``kept`` (remaining bytes) and ``spans`` (removed byte ranges) per row of ``docs``."""
    packed = F.shiftleft("first", 20).bitwiseOR(F.col("more"))
    ranges = written(
        repeated_windows(docs, text, window)
        .select("tk", packed.alias("r"))
        .distinct()
        .groupBy("tk")
        .agg(F.collect_list("r").alias("ranges")),
        "ranges",
    )
    rows = docs.select(*keep, text_key(text).alias("tk"), text_or_empty(text).cast("binary").alias("bytes"))
    joined = rows.join(ranges, "tk", "left").select("bytes", "ranges", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[2:])
    return map_batches(joined, _cut(window), f"{schema}, kept binary, spans array<struct<start: long, end: long>>")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
