"""Phrase collocations, Merkle manifest and exact dedup: brute force on small tables, and awkward inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fleetaudit.llm import catalog, collocations, exact_dedup, merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(14)] + ["Été", "of", "The", "x\x0by", "ß"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(140):
        said = []
        for w in rng.choices(words, weights, k=rng.randint(0, 120)):
            said.append("in spite of the" if rng.random() < 0.05 else w)
            said.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!\r\n"]))
        rows.append((i * 7 % 1000, "".join(said), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", "B", None]), rng.choice([None, i])))
    rows += [(2000 + i, rows[3][1].replace(" ", "  "), "en", "hot", i) for i in range(90)]
    rows += [
        (3000, None, None, None, None), (3001, "", "", "", 0), (3002, " \t\n", "en", "a", 3), (3003, " ", "en", "a", 1),
        (3004, "a b c " * 9000, "en", "a", 1), (3005, "Same", "en", "a", 1), (3005, "Same", "en", "a", 1),
        (3005, "Same ", "en", "a", 1), (3005, "Same", "fr", "b", 1), (None, "Same", "en", "a", 1), (None, None, None, None, None),
        (None, None, None, None, None), (-5, "x.y,z;w:v!u?t\x0bs\x0cr\rq", "en", "a", 1), (10**15, "Same", "en", "\x00", 1),
    ]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.table({n: pa.array(c) for n, c in zip(NAMES, zip(*ROWS))}), f"{at}/documents.parquet")
    return str(at)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- exact dedup -----------------------------------------------------------------------------


def brute_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, digest(text)) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def test_exact_dedup_equals_brute_force(spark, sf_dir):
    assert rows_of(catalog.QUERIES["op13_exact_dedup"](spark, sf_dir)) == brute_copies(ROWS)


@pytest.mark.parametrize("bits", [0, 3])
def test_colliding_hashes_are_told_apart_by_bytes(spark, bits):
    few = ROWS[:60] + ROWS[-20:]
    weak = lambda c: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(c), F.lit(2**bits))), 32, "0"))
    out = exact_dedup.copies(spark.createDataFrame(few, COLUMNS), ["doc_id"], hashed=weak)
    assert rows_of(out) == brute_copies(few)


def test_exact_dedup_keeps_columns_of_any_name(spark):
    rows = [(*r, 1, "v", 2, {"k": 1}) for r in ROWS]
    docs = spark.createDataFrame(rows, COLUMNS + ", hash int, norm string, size int, row map<string, int>")
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted((r[0] for r in brute_copies(ROWS) if r[3]), key=repr)
    assert exact_dedup.copies(docs.limit(0), ["doc_id"]).collect() == []


# --- Merkle manifest -------------------------------------------------------------------------


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(leaves):
    """(root, for each leaf its (siblings before, siblings after) upwards)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            first = i - i % 3
            path.append((level[first:i], level[i + 1 : first + 3]))
            i //= 3
        paths.append(path)
    return levels[-1][0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        leaf = digest("".join(field(r[k]) for k in (0, 3, 2, 4, 1)))
        start = leaf
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            text = None if r[1] is None else r[1].replace("\n", "")
            start = digest("".join(field(x) for x in (r[0], r[3], r[2], r[4], text)))
        groups[r[3]].append((r[0] is not None, r[0], leaf, start))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[s] = brute_tree([x[2] for x in groups[s]])
    root, above = brute_tree([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (_, i, leaf, start), path in zip(groups[s], trees[s][1]):
            node, said = start, ""
            for before, after in path + above[k]:
                node = digest("".join(before) + node + "".join(after))
                said += "".join(before + after)
            out.append((i, leaf, trees[s][0], root, digest(said), node, node == root))
    return sorted(out, key=repr)


def test_manifest_equals_brute_force(spark, sf_dir):
    got = rows_of(catalog.QUERIES["op12_merkle_manifest"](spark, sf_dir))
    assert got == brute_manifest(ROWS)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("height", [1, 2, 3])
def test_blocks_of_any_height_give_the_same_proofs(spark, height):
    docs = spark.createDataFrame(ROWS, COLUMNS)
    rows, tiers, over = merkle.manifest(docs, ["doc_id"], height=height)
    out = rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("p"), merkle.folded(F.col("leaf"), F.col("siblings"), F.col("turns")).alias("f"),
    )
    assert rows_of(out) == sorted(((*r[:5], r[3]) for r in brute_manifest(ROWS)), key=repr)
    assert len(tiers) == -(-merkle.steps(max(Counter(r[3] for r in ROWS).values())) // height)


def test_manifest_of_one_row_and_of_none(spark):
    docs = spark.createDataFrame(ROWS[:1], COLUMNS).withColumns({"leaf": F.lit(1), "grp": F.lit("x"), "pos": F.lit(2)})
    only = merkle.manifest(docs, docs.columns)[0].collect()[0]
    assert only["leaf"] == only["subroot"] == only["root"] and only["siblings"] == "" and only["turns"] == [] and only["grp"] == "x"
    assert merkle.manifest(docs.limit(0), ["doc_id"])[0].collect() == []


@pytest.mark.parametrize("levels", range(1, 8))
def test_van_emde_boas_order(levels):
    places = [merkle.addresses(levels, d, np.arange(3**d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.tree_size(levels)))
    top = levels // 2
    for k in range(3**top if top else 0):  # each bottom subtree lies in one run
        own = np.concatenate([places[d][k * 3 ** (d - top) : (k + 1) * 3 ** (d - top)] for d in range(top, levels)])
        assert own.max() - own.min() + 1 == len(own) == merkle.tree_size(levels - top)


# --- collocations ----------------------------------------------------------------------------


def brute_phrases(rows, min_count, limit):
    counts, n = defaultdict(Counter), Counter()
    for r in rows:
        lang = r[2] if r[2] is not None else "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        rated = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rated)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out, key=repr)


def test_collocation_query_equals_brute_force(spark, sf_dir):
    want = brute_phrases(ROWS, 30, 2000)
    assert rows_of(catalog.QUERIES["op11_phrase_collocations"](spark, sf_dir)) == want
    assert {len(r[2].split(" ")) for r in want} == {2, 3, 4}


@pytest.mark.parametrize("block, bucket, limit", [(1, 1, 2000), (150, 40, 7)])
def test_collocations_in_small_blocks(spark, block, bucket, limit):
    docs = spark.createDataFrame(ROWS, COLUMNS).withColumns({"block": F.lit(1), "codes": F.lit("x")}).repartition(3)
    out = collocations.collocations(docs, min_count=4, limit=limit, block=block, bucket=bucket)
    assert rows_of(out) == brute_phrases(ROWS, 4, limit)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "", 0), (3, "a b", "en", "", 0)], COLUMNS)
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(docs.limit(0)).collect() == []
