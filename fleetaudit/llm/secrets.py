"""Secret scans: fixed patterns and a randomness test battery.

The base kinds (assign, access, hex) are regular expressions.  Other tokens of
``LEAST`` and more characters with at least two classes of characters (lower case,
upper case, digits) are candidates; shorter tokens leave the tests no power.  The
encoding is inferred from the characters (upper-case hex, base32, base36, base62,
base64, base64url), and four tests ask whether the symbols look drawn at random
from its alphabet: chi-squared uniformity over the symbols, and over the classes of
characters, which sees short identifiers; the runs test above and below the
alphabet's middle; and the lag-1 serial correlation.  A token's p-value is the
Bonferroni combination of the four.

Per class (encoding and length class) over the whole corpus, two limits on p hold, and
a candidate above both is a secret.

* Missed keys: randomness is rejected at level ``q`` for a token by itself, so at most
  ``q`` of the truly random ones are lost here.
* False secrets: of the tokens above the limit, the share that is not random must be
  ``q`` or less as estimated.  Random tokens have p = 1 with a known frequency, so the
  tokens with p = 1 tell how many random ones lie above any limit; what lies there
  beyond them is not random.  Short classes, whose tests are weak, so get a higher limit.

Both run on counts of distinct tokens per class and binned p-value, which are few
however large the corpus is.  A token counts once however often it occurs, so copies of a
document that holds a key do not make the key look ordinary; an identifier that passes
the tests is reported wherever it stands.

A token with slashes may be a path, so its long segments are candidates too; a
segment is left out where the whole token is a secret.

Defined cases: null texts count as empty; candidates that overlap a base span
are left to it; offsets are code points, ends exclusive; repeated rows give
repeated rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, sliced, table, written

# Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # maximal runs, as [0-9a-f]+ finds them, of 16 or more
KINDS = ["assign", "access", "hex", "random"]

LEAST = 20
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
SEGMENT = re.compile(rf"[A-Za-z0-9+_-]{{{LEAST},}}={{0,2}}")  # of a path
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings from the smallest alphabet up; the first that holds all characters is taken.
ALPHABETS = {
    "HEX": DIGIT + "ABCDEF",
    "base32": UPPER + "234567",
    "base36": DIGIT + LOWER,
    "BASE36": DIGIT + UPPER,
    "base62": DIGIT + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGIT + "+/",
    "base64url": UPPER + LOWER + DIGIT + "-_",
}
P_BINS = 10_000
TESTS = 4


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _p_chi(chi: float, d: int) -> float:
    """Upper tail of chi-squared with ``d`` degrees of freedom, by the Wilson-Hilferty approximation."""
    return _tail(((chi / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def p_random(token: str, alphabet: str) -> float:
    """p-value of the hypothesis that the characters of ``token`` are independent and uniform over ``alphabet``."""
    k, n = len(alphabet), len(token)
    x = np.array([alphabet.index(c) for c in token])
    p_chi = _p_chi(float(((np.bincount(x, minlength=k) - n / k) ** 2).sum() * k / n), k - 1)
    sizes = np.array([sum(c in part for c in alphabet) for part in (LOWER, UPPER, DIGIT)])
    seen = np.array([sum(c in part for c in token) for part in (LOWER, UPPER, DIGIT)])
    sizes, seen = np.append(sizes, k - sizes.sum()), np.append(seen, n - seen.sum())
    seen, expected = seen[sizes > 0], sizes[sizes > 0] * n / k
    p_class = _p_chi(float(((seen - expected) ** 2 / expected).sum()), len(seen) - 1) if len(seen) > 1 else 1.0
    # runs above and below the middle of the alphabet
    high = x >= k / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    # serial correlation of neighbours
    dev = x - x.mean()
    power = float((dev * dev).sum())
    p_serial = 2 * _tail(abs(float((dev[1:] * dev[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    return min(1.0, TESTS * min(p_chi, p_class, p_runs, p_serial))


def encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token; None if only one class of characters occurs."""
    chars = set(token)
    if sum(bool(chars & set(c)) for c in (LOWER, UPPER, DIGIT)) < 2:
        return None
    return next((name for name, a in ALPHABETS.items() if chars <= set(a)), None)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    found = []
    low = text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Tokens outside the base spans with inferred encoding, length class and p-value bin."""
    out = []
    for m in TOKEN.finditer(text):
        for start, end in [m.span(), *(x.span() for x in SEGMENT.finditer(text, *m.span()) if x.span() != m.span())]:
            token = text[start:end].rstrip("=")
            name = encoding(token)
            if name is None or any(s < end and start < e for s, _, e in base):
                continue
            p = p_random(token, ALPHABETS[name])
            size = min(4, max(0, int(math.log2(len(token) / LEAST))))
            out.append({"start": start, "end": end, "encoding": name, "size": size, "p": int(p * P_BINS), "token": xxhash.xxh3_64_intdigest(token) - (1 << 63)})
    return out


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
TRIED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("size", pa.int32()), ("p", pa.int32()), ("token", pa.int64())]))
COLUMNS = (
    "base array<struct<start: long, kind: int, end: long>>, base_sha256 string, "
    "tried array<struct<start: long, end: long, encoding: string, size: int, p: int, token: long>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        bases, digests, tried = [], [], []
        for text in b.column(0).to_pylist():
            spans = base_spans(text or "")
            said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            digests.append(hashlib.sha256(said.encode()).hexdigest())
            tried.append(candidates(text or "", spans))
        yield pa.RecordBatch.from_arrays(
            [*b.columns[1:], pa.array(bases, SPAN), pa.array(digests, pa.string()), pa.array(tried, TRIED)],
            names=[*b.schema.names[1:], "base", "base_sha256", "tried"],
        )


def thresholds(tokens: DataFrame, q: float = 0.05) -> DataFrame:
    """(encoding, size, limit): p-value bins up to ``limit`` are not random.  At most 35 rows.

    With R random tokens in a class, about ``R * (1 - p / TESTS) ** TESTS`` of them lie above p < 1,
    and ``R * (1 - 1 / TESTS) ** TESTS`` at p = 1.  A class without a token at p = 1 is too small to
    tell, or holds none that is random; it keeps the limit of level ``q``.
    """
    lost = int(q * P_BINS) - 1
    bins = tokens.groupBy("encoding", "size", F.greatest(F.col("p"), F.lit(lost)).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("encoding", "size")
    ranked = bins.select(
        "encoding", "size", "p",
        F.sum("n").over(of.orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, -1)).alias("above"),
        F.sum(F.when(F.col("p") >= P_BINS, F.col("n"))).over(of).alias("certain"),
        F.sum("n").over(of).alias("m"), F.min("p").over(of).alias("least"),
    )
    share = lambda p: F.pow(1 - p / TESTS, F.lit(TESTS))
    scale = F.col("certain") / share(F.lit(1.0))
    clean = F.col("above") - scale * share((F.col("p") + 1) / P_BINS) <= q * F.col("above")
    whole = F.col("m") - scale * share(F.lit(q)) <= q * F.col("m")  # all that level q leaves
    return (
        ranked.groupBy("encoding", "size")
        .agg(
            F.min(F.when(clean, F.col("p"))).alias("limit"),
            F.max((F.col("certain").isNull()) | ((F.col("least") > lost) & whole)).alias("open"),
        )
        .select("encoding", "size", F.when(F.col("open"), F.lit(lost)).otherwise(F.col("limit")).cast("int").alias("limit"))
    )


def scan(docs: DataFrame, keep: list[str], text: str = "text", q: float = 0.05) -> DataFrame:
    """``keep`` with ``base``, ``base_sha256`` and ``spans``: array of (start, kind number, end, encoding)."""
    rows = docs.select(F.col(text), *keep)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    scanned = written(map_batches(rows, _scan, f"{kind}, {COLUMNS}"), "scanned")
    tokens = scanned.select(F.inline("tried")).select("encoding", "size", "p", "token").distinct()
    limits = thresholds(tokens, q).collect()  # a number per class
    table_of = {f"{r['encoding']}/{r['size']}": r["limit"] for r in limits}
    limit = F.create_map(*[F.lit(x) for kv in (table_of or {"": -1}).items() for x in kv])
    passed = F.filter("tried", lambda t: t["p"] > F.coalesce(
        F.try_element_at(limit, F.concat(t["encoding"], F.lit("/"), t["size"].cast("string"))), F.lit(-1)
    ))
    within = lambda t, o: (o["start"] <= t["start"]) & (t["end"] <= o["end"]) & (o["end"] - o["start"] > t["end"] - t["start"])
    scanned = scanned.withColumn("passed", passed)
    random = F.transform(
        F.filter("passed", lambda t: ~F.exists("passed", lambda o: within(t, o))),
        lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"), t["encoding"].alias("encoding")),
    )
    base = F.transform("base", lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(None).cast("string").alias("encoding")
    ))
    return scanned.select(*keep, "base", "base_sha256", F.array_sort(F.concat(base, random)).alias("spans"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    names = F.array(*map(F.lit, KINDS))
    said = F.transform("spans", lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    ))
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        "base_sha256", F.array_join(said, ",").alias("spans"),
    )
