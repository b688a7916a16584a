"""SimHash near-dedup: fingerprints, bit-sliced comparison, components.

Fingerprints come from word shingles as the contract says.  Equal fingerprints
are one row from then on.  Two fingerprints at ``radius`` 3 or fewer differing
bits leave at least three of six bit fields equal, so every linked pair meets
in one of the 20 groups keyed by three fields (about 32 bits); groups of one
row are dropped after a count.

Groups are compared in blocks by bit slices: the block's fingerprints are
stored as 64 vertical bit planes, a plane holding one bit of every
fingerprint.  For a batch of queries each plane is XORed with the queries'
bits and added to carry-save counters (ones, twos, and an "over" flag for four
or more), which updates the distances of 64 fingerprints with one machine
word; a batch is abandoned as soon as all its distances are over the radius.
Small groups share a block (a link across groups is still a true link); a
group larger than a block is split by hash into parts and every pair of parts
is a block of its own, so no task holds more than ``2 * BLOCK`` rows of it.
A block emits the links of a spanning forest, not all pairs.

Components over the links are the least fixed point of large-star/small-star
rounds in Spark, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any
other; null ids do not count as the smallest id (a component without any id
has a null ``component_id``); repeated rows give repeated result rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, sliced, table, text_key, written

SHINGLE = 3
RADIUS = 3
BLOCK = 2048
QUERIES = 256
#: Six bit fields of a fingerprint: (shift, width).
FIELDS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Majority of the shingles' XXH64 bits (a bit is 1 if set in over half of the hashes)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    ones, n = np.zeros(64, dtype=np.int64), len(words) - k + 1
    for at in range(0, n, 65536):
        part = words[at : at + 65536 + k - 1]
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(k)))), dtype=np.uint64
        )
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _add_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        prints = np.array([fingerprint(t) for t in b.column(0).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*b.columns[1:], pa.array(prints.view(np.int64))], names=[*b.schema.names[1:], "print"]
        )


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``print`` (the fingerprint as a signed long)."""
    out = docs.select(F.col(text), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[1:])
    return map_batches(out, _add_fingerprints, f"{schema}, print long" if keep else "print long")


def _planes(prints: np.ndarray) -> np.ndarray:
    """64 bit planes of the fingerprints, 64 fingerprints a word, padded with zeros."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(prints) // 64) * 64), dtype=np.uint8)
    padded[:, : len(prints)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def close_pairs(queries: np.ndarray, planes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs with at most three differing bits, by bit-sliced counters."""
    shape = (len(queries), planes.shape[1])
    ones, twos, over = (np.zeros(shape, dtype=np.uint64) for _ in range(3))
    for p in range(64):
        bit = (queries >> np.uint64(p)) & np.uint64(1)
        differ = planes[p][None, :] ^ (np.uint64(0) - bit)[:, None]
        carry = ones & differ
        ones ^= differ
        over |= twos & carry  # a carry out of the twos: four or more
        twos ^= carry
        if p % 8 == 7 and p >= 15 and bool((over == np.uint64(0xFFFFFFFFFFFFFFFF)).all()):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :n]
    return np.nonzero(near)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, fingerprint) that connect just what pairs within the radius connect."""
    prints = np.unique(prints)
    planes, parent = _planes(prints), np.arange(len(prints))
    for at in range(0, len(prints), QUERIES):
        a, b = close_pairs(prints[at : at + QUERIES], planes, len(prints))
        a = a + at
        while True:
            parent = _roots(parent)
            x, y = parent[a], parent[b]
            if not (apart := x != y).any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
    linked = parent != np.arange(len(prints))
    return prints[linked], prints[parent[linked]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, print) sorted by unit: whole units fill a block, then it is compared."""

    def links(held: list[np.ndarray]) -> pa.RecordBatch:
        a, b = forest(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    done: list[np.ndarray] = []  # whole units
    n_done, tail, tail_unit = 0, [], None  # rows of the unit that may go on in the next batch
    for batch in batches:
        units = batch.column(0).to_numpy()
        prints = batch.column(1).to_numpy().view(np.uint64)
        edges = [0, *(np.nonzero(units[1:] != units[:-1])[0] + 1).tolist(), len(units)]
        for s, e in zip(edges, edges[1:]):
            if s == e:
                continue
            if units[s] != tail_unit:
                size = sum(map(len, tail))
                if done and n_done + size > BLOCK:
                    yield links(done)
                    done, n_done = [], 0
                done, n_done, tail, tail_unit = done + tail, n_done + size, [], units[s]
            tail.append(prints[s:e])
    if done or tail:
        yield links(done + tail)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column ``print``; their components are exact."""
    keys = []
    for c, fields in enumerate(combinations(range(len(FIELDS)), len(FIELDS) - RADIUS)):
        key, at = F.lit(0).cast("long"), 0
        for f in fields:
            shift, width = FIELDS[f]
            part = F.shiftrightunsigned("print", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key, at = key.bitwiseOR(F.shiftleft(part, at)), at + width
        keys.append(key.bitwiseOR(F.lit(c << 40).cast("long")))
    keyed = prints.select("print", F.explode(F.array(*keys)).alias("group"))
    sizes = written(keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    met = keyed.join(sizes, "group").select(
        "print", "group", parts.alias("parts"), F.pmod(F.xxhash64("print"), parts).cast("int").alias("part")
    )
    # a row of part p goes to the blocks (0, p) .. (p, p) .. (p, last): each pair of parts meets once
    blocks = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.least(q, F.col("part")) * F.col("parts").cast("long") + F.greatest(q, F.col("part")),
    )
    units = met.select("print", "group", F.explode(blocks).alias("block")).select(
        F.xxhash64("group", "block").alias("unit"), "print"
    )
    return (
        units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compare, "a long, b long").distinct()
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes of ``edges``."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (state["n"], state["h"]):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = (state["n"], state["h"])
        # large star: every larger neighbour of u points to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, "least")  # so that the join deals out both sides and a hub can be split
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u itself, point to the least neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text key, print, component_id) per document; ``component_id`` is the least id reachable."""
    found = written(
        fingerprints(docs.select(F.col(id_col).alias("id"), text_key(text).alias("tk"), F.col(text).alias("text")), ["id", "tk"]),
        "prints",
    )
    least = written(found.groupBy("print").agg(F.min("id").alias("least")), "distinct-prints")
    roots = components(links(least.select("print")))
    ends = least.join(roots, least["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    smallest = ends.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = ends.join(smallest, "root").select("print", "component_id", "root")
    return found.join(of_print, "print")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the least id (null last), then the least text key.

    Rows with equal id and text are the same document and give one row.
    """
    found = written(near_duplicates(docs, id_col, text).select("id", "tk", "root"), "components")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tk")).alias("best"))
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  null is an id, too
    best = best.select(known("best.id").alias("_id"), F.col("best.tk").alias("_tk"))
    here = docs.withColumns({"_id": known(id_col), "_tk": text_key(text)})
    kept = here.join(best, ["_id", "_tk"], "left_semi").dropDuplicates(["_id", "_tk"])
    return kept.select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns travel in one struct, so that none clashes with a helper column."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    return one_per_group(packed).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
