"""Merkle dataset manifest: a digest tree over every row, stored in van Emde Boas order.

Every row is a leaf; per group, leaves ascend by key, and while several nodes
remain, every ``RUN`` consecutive ones become one.  What remains is the group's
subroot; subroots ascend by group name and likewise give the root.

Leaves are digested where they are read; from then on a row is about a hundred
bytes.  They are sorted once by range partitions, and a leaf's position is its
place in its partition plus the rows of the group in the partitions before: one
small row per partition and group, so a group of any size is spread.

The tree is cut into aligned subtrees (*blocks*) of ``HEIGHT`` levels, 729
leaves; a block is one row, built in one task, and its root is a leaf of the
next tier, so a tier has a 729th of the rows of the one before.  A block keeps
its nodes in one array in van Emde Boas order: the tree is split at half its
height, the top part is stored first and then the bottom parts from left to
right, each by the same rule.  ``addresses`` computes where a node lies; the
builder and the sibling retrieval use nothing else.

Proofs go the other way: a block's root receives its siblings up to the root
from the tier above and hands them to each of its leaves with the siblings
inside the block.  ``folded`` recomputes a root from a leaf and its siblings in
Spark expressions, apart from the builder.

Defined cases: null fields digest as ``-``; a null key sorts first, equal keys
by digest, and equal rows give equal leaves at neighbouring places; a null group
comes first among the groups; a group of one leaf is its own subroot; an empty
table gives no rows; input columns are packed in one struct, so their names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, sliced, table, written

RUN = 3
HEIGHT = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DIGEST = 32
ADDED = ["leaf", "subroot", "root", "siblings", "turns"]


def _part(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: list[str | Column]) -> Column:
    """Hex digest of a row's fields: ``-`` for null, else byte count, colon, value."""
    return F.sha2(F.concat(*[_part(F.col(f) if isinstance(f, str) else f) for f in fields]), 256)


# --- van Emde Boas order ---------------------------------------------------------------------


def tree_size(levels: int) -> int:
    """Nodes of a complete tree with so many levels of nodes."""
    return (RUN**levels - 1) // (RUN - 1)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` of a depth (the root's is 0) lie in a tree with ``levels`` levels of nodes."""
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return addresses(top, depth, index)
    bottom, wide = levels - top, RUN ** (depth - top)
    return tree_size(top) + index // wide * tree_size(bottom) + addresses(bottom, depth - top, index % wide)


@lru_cache(maxsize=None)
def _places(height: int) -> list[list[int]]:
    """Addresses by level above the leaves, of a tree of this height."""
    return [
        addresses(height + 1, height - up, np.arange(RUN ** (height - up))).tolist() for up in range(height + 1)
    ]


def steps(nodes: int) -> int:
    """Levels until one node remains."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // RUN), n + 1
    return n


def _built(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """(nodes in van Emde Boas order, root) of a block."""
    places = _places(height)
    nodes = bytearray(DIGEST * tree_size(height + 1))
    level = leaves
    for up in range(height + 1):
        for at, digest in zip(places[up], level):
            nodes[at * DIGEST : (at + 1) * DIGEST] = digest
        if up < height:
            level = [
                sha256("".join([d.hex() for d in level[i : i + RUN]]).encode()).digest()
                for i in range(0, len(level), RUN)
            ]
    return bytes(nodes), level[0]


def _siblings(nodes: bytes, n: int, height: int) -> Iterator[tuple[str, list[int]]]:
    """Per leaf of a block: hex digests of its siblings upwards, and a turn per level."""
    places = _places(height)
    above: list[list[tuple[str, list[int]]]] = []  # by level, what each node adds
    for up in range(height):
        count = -(-n // RUN**up)
        texts = [nodes[a * DIGEST : (a + 1) * DIGEST].hex() for a in places[up][:count]]
        added = []
        for i in range(count):
            own, first = i % RUN, i - i % RUN
            run = texts[first : first + RUN]
            added.append(("".join(run[:own] + run[own + 1 :]), [own * RUN + len(run) - 1]))
        above.append(added)
    paths: list[tuple[str, list[int]]] = [("", [])]
    for added in reversed(above):
        paths = [(text + paths[i // RUN][0], turn + paths[i // RUN][1]) for i, (text, turn) in enumerate(added)]
    yield from paths


# --- positions -------------------------------------------------------------------------------


def positioned(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos`` (from 0 in ascending ``order`` within ``grp``) and ``n`` (rows of the group)."""
    placed = written(
        rows.repartitionByRange("grp", *order)
        .sortWithinPartitions("grp", *order)
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}),
        "sorted",
    )
    runs = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    every, before = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("part")
    offsets = written(
        runs.select(
            "grp",
            "part",
            (F.sum("rows").over(before) - F.col("rows") - F.col("first")).alias("shift"),
            F.sum("rows").over(every).alias("n"),
        ),
        "offsets",
    )
    return placed.join(offsets, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


# --- building --------------------------------------------------------------------------------


def _build(height: int):
    """Blocks with their entries by position, their nodes and root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 16):
            entries = b.column("entries")
            sizes = np.array([len(e) for e in entries], dtype=np.int64)
            flat, of_block = entries.flatten(), np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat.field("pos").to_numpy(zero_copy_only=False), of_block))
            flat, ends = flat.take(pa.array(order)), np.concatenate([[0], np.cumsum(sizes)])
            digests = flat.field("digest").to_pylist()
            made = [
                _built(digests[s:e], min(height, steps(n)))
                for n, s, e in zip(b.column("n").to_pylist(), ends[:-1], ends[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("grp", "n", "block")),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=entries.type),
                 pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())],
                names=["grp", "n", "block", "entries", "nodes", "root"],
            )

    return run


def blocks(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Tiers of blocks over (grp, n, pos, digest, item), from the leaves up; each tier is a written table.

    A block: ``grp``, ``n`` (nodes of the group in this tier), ``block``, ``entries`` (its leaves by
    position: pos, digest, item), ``nodes`` (in van Emde Boas order) and ``root``.
    """
    wide = RUN**height
    tiers: list[DataFrame] = []
    while True:
        gathered = (
            leaves.groupBy("grp", "n", F.expr(f"pos div {wide}").alias("block"))
            .agg(F.collect_list(F.struct("pos", "digest", "item")).alias("entries"))
        )
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in gathered.schema.fields)
        tier = written(map_batches(gathered, _build(height), f"{schema}, nodes binary, root binary"), "blocks")
        tiers.append(tier)
        more = tier.where(F.col("n") > wide)
        if more.isEmpty():
            return tiers
        leaves = more.select(
            "grp", F.expr(f"(n + {wide - 1}) div {wide}").alias("n"), F.col("block").alias("pos"),
            F.col("root").alias("digest"), F.lit(None).cast(tier.schema["entries"].dataType.elementType["item"].dataType).alias("item"),
        )


def _handed(height: int):
    """A row per leaf of each block: its siblings in the block, then those of the block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 8):
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                grp, n, rest, turns, tops = (row.column(c)[0].as_py() for c in ("grp", "n", "siblings", "turns", "tops"))
                entries = row.column("entries")[0].values
                size = len(entries)
                texts, ways = [], []
                for text, turn in _siblings(row.column("nodes")[0].as_py(), size, min(height, steps(n))):
                    texts.append(text + rest)
                    ways.append(turn + turns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * size, pa.string()), *(entries.field(f) for f in ("pos", "item", "digest")),
                     pa.array(texts, pa.string()), pa.array(ways, pa.list_(pa.int32())),
                     pa.array([tops] * size, pa.list_(pa.binary()))],
                    names=["grp", "pos", "item", "digest", "siblings", "turns", "tops"],
                )

    return run


def proofs(tiers: list[DataFrame], tops: DataFrame | None = None, height: int = HEIGHT) -> DataFrame:
    """Per leaf: ``siblings`` (hex digests joined, leaf upwards), ``turns`` and ``tops`` (roots above, outermost first).

    A turn is ``RUN`` times the own place in the run plus the number of siblings.  ``tops`` continues the
    groups' roots: (grp, siblings, turns, tops); without it the only group's root is the outermost one.
    """
    wide = RUN**height
    item = tiers[0].schema["entries"].dataType.elementType["item"].dataType.simpleString()
    schema = f"grp string, pos long, item {item}, digest binary, siblings string, turns array<int>, tops array<binary>"
    above: DataFrame | None = None
    for tier in reversed(tiers):
        done = tier.where(F.col("n") <= wide)
        if tops is None:
            ready = done.select(
                "*", F.lit("").alias("siblings"), F.array().cast("array<int>").alias("turns"), F.array("root").alias("tops")
            )
        else:
            joined = done.join(tops, "grp")
            ready = joined.withColumn("tops", F.concat("tops", F.array("root")))
        if above is not None:
            links = above.select("grp", F.col("pos").alias("block"), "siblings", "turns", "tops")
            ready = ready.unionByName(tier.where(F.col("n") > wide).join(links, ["grp", "block"]))
        above = map_batches(
            ready.select("grp", "n", "entries", "nodes", "siblings", "turns", "tops"), _handed(height), schema
        )
    return above


def folded(start: Column, siblings: Column, turns: Column) -> Column:
    """The root that a leaf's hex digest and its siblings lead to."""
    hexes = 2 * DIGEST

    def step(acc: Column, turn: Column) -> Column:
        before = F.floor(turn / RUN).cast("int")
        after = turn % RUN - before
        cut = lambda skip, count: F.substring(siblings, acc["at"] + skip * hexes + 1, count * hexes)
        node = F.sha2(F.concat(cut(F.lit(0), before), acc["node"], cut(before, after)), 256)
        return F.struct(node.alias("node"), (acc["at"] + (turn % RUN) * hexes).alias("at"))

    begin = F.struct(start.alias("node"), F.lit(0).alias("at"))
    return F.aggregate(turns, begin, step, lambda acc: acc["node"])


def manifest(
    docs: DataFrame, keep: list[str], fields: list[str] | None = None, group: str = "source", key: str = "doc_id",
    height: int = HEIGHT,
) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(rows, blocks by tier, blocks over the subroots): the whole manifest of ``docs``.

    A row: columns ``keep`` (without those named like the added ones), ``leaf``, ``subroot``, ``root`` (hex), ``siblings`` and ``turns`` (its proof).
    """
    fields, keep = fields or FIELDS, [c for c in keep if c.lower() not in ADDED]
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # bytewise: null first
    leaves = written(
        docs.select(
            name.alias("grp"), F.unhex(leaf(fields)).alias("digest"),
            F.struct(F.struct(*keep).alias("row"), F.col(key).alias("key")).alias("item"),
        ),
        "leaves",
    )
    placed = positioned(leaves, [F.col("item.key").asc_nulls_first(), F.col("digest")])
    tiers = blocks(placed, height)
    ends = [t.where(F.col("n") <= RUN**height).select("grp", F.col("root").alias("digest")) for t in tiers]
    subroots = ends[0]
    for e in ends[1:]:
        subroots = subroots.unionByName(e)
    named = subroots.select(F.lit("").alias("grp"), "digest", F.struct(F.col("grp").alias("name")).alias("item"))
    over = blocks(positioned(named, [F.col("item.name")]), height)
    tops = written(proofs(over, height=height).select(F.col("item.name").alias("grp"), "siblings", "turns", "tops"), "tops")
    rows = proofs(tiers, tops, height)
    as_hex = lambda c: F.lower(F.hex(c))
    return (
        rows.select(
            "item.row.*", as_hex(F.col("digest")).alias("leaf"), as_hex(F.col("tops")[1]).alias("subroot"),
            as_hex(F.col("tops")[0]).alias("root"), "siblings", "turns",
        ),
        tiers,
        over,
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    cut = leaf(["doc_id", "source", "lang", "n_chars", F.translate("text", "\n", "")])
    changed = F.when(even & F.contains("text", F.lit("\n")), F.unhex(cut))
    rows, _, _ = manifest(docs.select(*FIELDS, changed.alias("changed")), ["doc_id", "changed"])
    start = F.coalesce(F.lower(F.hex("changed")), F.col("leaf"))
    ended = rows.withColumn("folded_root", folded(start, F.col("siblings"), F.col("turns")))
    return ended.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


#: CRC-32 bit by bit: its low bit decides which documents are tampered with.
_CRC = (
    "list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: "
    "list_transform(range(8), lambda b: (ord(c) >> b) & 1))), "
    "lambda s, x: xor(s >> 1, (xor(s, x) & 1) * 3988292384), 4294967295)"
)


def _said(*fields: str) -> str:
    return "sha256(" + " || ".join(
        f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || {f}, '-')" for f in fields
    ) + ")"


def _levels(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (g, pos, n, d): level by level until one remains."""
    return f"""{name} AS (
  SELECT g, 0 AS level, pos, n, d FROM {leaves}
  UNION ALL
  SELECT g, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY g, level, pos // 3, n)"""


def _runs(name: str, nodes: str) -> str:
    """Per node its run: digests of the siblings before and after it."""
    side = "coalesce((SELECT string_agg(o.d, '' ORDER BY o.pos) FROM {n} o WHERE o.g = x.g AND o.level = x.level AND o.pos // 3 = x.pos // 3 AND o.pos {s} x.pos), '')"
    return f"{name} AS (SELECT g, level, pos, {side.format(n=nodes, s='<')} AS l, {side.format(n=nodes, s='>')} AS r FROM {nodes} x WHERE n > 1)"


SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {_said(*FIELDS)} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_said('doc_id', 'source', 'lang', 'n_chars', "replace(text, chr(10), '')")}
      ELSE {_said(*FIELDS)} END AS start
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n, leaf AS d
  FROM docs),
{_levels('nodes', 'placed')},
{_runs('runs', 'nodes')},
subroots AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, d FROM nodes WHERE n = 1),
{_levels('tops', 'subroots')},
{_runs('topruns', 'tops')},
low AS (
  SELECT doc_id, g, 0 AS level, pos, start AS node, '' AS said FROM placed
  UNION ALL
  SELECT w.doc_id, w.g, w.level + 1, w.pos // 3, sha256(r.l || w.node || r.r), w.said || r.l || r.r
  FROM low w JOIN runs r ON r.g = w.g AND r.level = w.level AND r.pos = w.pos),
mid AS (
  SELECT w.doc_id, w.g, s.pos, s.d AS subroot, w.node, w.said
  FROM low w JOIN (SELECT doc_id, max(level) AS level FROM low GROUP BY doc_id) m USING (doc_id, level)
  JOIN subroots s ON s.name = w.g),
high AS (
  SELECT doc_id, 0 AS level, pos, node, said FROM mid
  UNION ALL
  SELECT w.doc_id, w.level + 1, w.pos // 3, sha256(r.l || w.node || r.r), w.said || r.l || r.r
  FROM high w JOIN topruns r ON r.level = w.level AND r.pos = w.pos)
SELECT p.doc_id, p.leaf, m.subroot, t.d AS root, sha256(h.said) AS proof_sha256, h.node AS folded_root, h.node = t.d AS verified
FROM placed p JOIN mid m USING (doc_id)
JOIN high h USING (doc_id) JOIN (SELECT doc_id, max(level) AS level FROM high GROUP BY doc_id) x ON x.doc_id = h.doc_id AND x.level = h.level
CROSS JOIN (SELECT d FROM tops WHERE n = 1) t"""
