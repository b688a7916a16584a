"""SentencePiece encoding and decoding with the tokenizers library.

The model file's protobuf is parsed here (wire format, the few fields needed)
and rebuilt as a ``tokenizers`` pipeline: the normaliser (character map, extra
spaces, dummy prefix, the metaspace marker), the model, and the decoder with
byte fallback.  Unigram models keep their scores; BPE models get their merges
ranked by piece score.

Words repeat, so texts are cut before runs of the marker and each distinct
chunk is encoded and decoded once, many at a time (``encode_batch`` with
``THREADS`` threads).  A worker remembers the chunks it has seen, up to
``KEPT`` characters of them, and then begins anew.  The cut is exact if no piece holds the marker after
another character, which is tested when the model is loaded; a model without
that property has its texts encoded whole.

Parity with the sentencepiece library is verified for every distinct chunk, and
for every whole text, which the library encodes and whose ids it decodes; what
differs takes the library's ids and decoding, and the document's ``parity`` is false (seen for runs of spaces:
their pieces share one score, and merge ranks cannot say "leftmost first").  Every document is put
together again from its decoded chunks and compared with the text
(``round_trip``).

Defined cases: null and empty texts give no ids and an empty decoding; repeated rows give
repeated rows; columns named like a result column are replaced.
"""

from __future__ import annotations

import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import map_batches, per_worker, replaced, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
GROUP = 1000  # chunks in one string of a batch
STRINGS = 16  # strings that are encoded at a time
MARK = "▁"
CHUNK = f"{MARK}*[^{MARK}]+|{MARK}+"
CHUNKS = re.compile(CHUNK)
KEPT = 12_000_000  # characters (with CHUNK_COST for each chunk) of the chunks that a worker remembers
CHUNK_COST = 10
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(field number, value) of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield key >> 3, struct.unpack("<d" if kind == 1 else "<f", data[at : at + n])[0]
            at += n
        else:
            raise ValueError(f"wire type {kind} in a SentencePiece model")


class PieceModel:
    """Pieces, scores and normaliser of a SentencePiece model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.unk_surface = UNIGRAM, False, " ⁇ "
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
            elif field == 2:
                t = dict(_fields(value))
                self.kind, self.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
                self.unk_surface = t.get(44, self.unk_surface.encode()).decode()
            elif field == 3:
                n = dict(_fields(value))
                self.charsmap = n.get(2, b"")
                self.dummy_prefix, self.squeeze, self.escape = (bool(n.get(k, 1)) for k in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are rebuilt")
        self.unk = next(i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN)
        plain = [p for p, _, k in self.pieces if k in (NORMAL, USER, UNUSED)]
        self.cuts = self.escape and not any(MARK in p.lstrip(MARK) for p in plain) and not any(k == USER for _, _, k in self.pieces)

    def normalizer(self) -> normalizers.Normalizer:
        steps: list[normalizers.Normalizer] = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        return normalizers.Sequence(steps)

    def tokenizer(self) -> Tokenizer:
        """The model alone: its input is normalised text."""
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=self.unk, byte_fallback=self.byte_fallback)
        else:
            ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            joins = {p for p, _, k in self.pieces if k in (NORMAL, USER)}
            merges = sorted(
                (-s, k, p[:k], p[k:])
                for p, s, kind in self.pieces if kind in (NORMAL, USER)
                for k in range(1, len(p)) if p[:k] in joins and p[k:] in joins
            )
            model = models.BPE(
                vocab=ids, merges=[(a, b) for _, _, a, b in merges], unk_token=self.pieces[self.unk][0],
                fuse_unk=True, byte_fallback=self.byte_fallback,
            )
        out = Tokenizer(model)
        out.decoder = decoders.Sequence([
            decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(),
            *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []),
        ])
        return out


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, data: bytes):
        self.model = PieceModel(data)
        self.normalizer, self.tokenizer = self.model.normalizer(), self.model.tokenizer()
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.plain = not self.model.charsmap and not self.model.squeeze
        self.leads = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.cuts = self.model.cuts and self.plain and self.model.dummy_prefix
        if self.cuts:
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(CHUNK), "isolated")
        self._forget()

    def _forget(self) -> None:
        """Begin with no remembered chunks."""
        self.number: defaultdict[str, int] = defaultdict(count().__next__)  # chunk: its place in the arrays
        self.held = 0
        self.store = np.empty(0, np.int32)  # ids of all chunks
        self.begins, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.equal, self.same = np.empty(0, bool), np.empty(0, bool)

    def _numbers(self, cut: list[list[str]]) -> np.ndarray:
        """The place of every chunk; those not yet known are encoded and compared first."""
        if self.held > KEPT:
            self._forget()
        before = len(self.number)
        every = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), dtype=np.int64, count=sum(map(len, cut)))
        new = [*islice(self.number, before, None)]
        if new:
            ids, begins, *rest = self._chunks(new)
            found = (ids, begins + len(self.store), *rest)
            names = ("store", "begins", "lengths", "equal", "same")
            for name, x in zip(names, found):
                setattr(self, name, np.concatenate([getattr(self, name), x]))
            self.held += sum(map(len, new)) + CHUNK_COST * len(new)
        return every

    def normalized(self, text: str) -> str:
        if not self.plain:
            return self.normalizer.normalize_str(text)
        text = " " + text if text and self.model.dummy_prefix else text
        return text.replace(" ", MARK) if self.model.escape else text

    def expected(self, text: str) -> str:
        """What decoding must give back: the text as normalised, without prefix and marker."""
        if self.plain and self.model.escape and MARK not in text:
            return text
        back = self.normalized(text).replace(MARK, " ")
        return back[1:] if self.model.dummy_prefix and back.startswith(" ") else back

    def _alone(self, chunks: list[str]) -> Iterator[tuple[list[int], bool, bool]]:
        """(ids, equal to the library's, decoded to the chunk) of chunks encoded one by one."""
        mine = [e.ids for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]
        # the library puts a marker in front by itself; the marker alone is what a space adds to a text before it
        theirs = self.peer.encode([c.replace(MARK, " ").removeprefix(" ") for c in chunks], num_threads=THREADS)
        before, after = (self.peer.encode(t) for t in ("a", "a "))
        for c, a, b in zip(chunks, mine, theirs):
            b = after[len(before) :] if c == MARK else b
            back = self.tokenizer.decode(b, skip_special_tokens=False)  # without the prefix that a text has
            yield b, a == b, " " + back == c.replace(MARK, " ")

    def _strings(self, groups: list, joined: list[str], texts: list[str]) -> Iterator[tuple]:
        """(group, text, own ids, the library's ids, decoded) per string, a few strings in memory at a time."""
        for i in range(0, len(groups), STRINGS):
            some = slice(i, i + STRINGS)
            mine = [e.ids for e in self.tokenizer.encode_batch_fast(joined[some], add_special_tokens=False)]
            theirs = self.peer.encode([t[1:] for t in texts[some]], num_threads=THREADS)
            back = self.tokenizer.decode_batch(mine, skip_special_tokens=False)
            yield from zip(groups[some], texts[some], mine, theirs, back)

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all chunks, begin and length of each chunk's, equal to the library's, decoded to the chunk).

        Chunks with one marker in front go together in strings of many, where a
        piece with the marker begins a chunk; the others, and strings that
        differ somewhere, go one by one.
        """
        n = len(chunks)
        begins, lengths, equal, same = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool), np.ones(n, bool)
        single = np.array([len(c) > 1 and c[0] == MARK and c[1] != MARK for c in chunks], dtype=bool)
        kept, at, rest = [], 0, [np.nonzero(~single)[0]]
        order = np.nonzero(single)[0]
        groups = [order[i : i + GROUP] for i in range(0, len(order), GROUP)]
        joined = ["".join([chunks[i] for i in g.tolist()]) for g in groups]
        texts = [j.replace(MARK, " ") for j in joined]
        for group, text, a, b, back in self._strings(groups, joined, texts):
            ids = np.array(a, dtype=np.int32)
            starts = np.nonzero(self.leads[ids])[0]
            if a != b or " " + back != text or len(starts) != len(group):
                rest.append(group)
                continue
            begins[group], lengths[group] = at + starts, np.diff(starts, append=len(ids))
            kept.append(ids)
            at += len(ids)
        alone = np.concatenate(rest)
        for i, (ids, e, s) in zip(alone.tolist(), self._alone([chunks[i] for i in alone.tolist()]) if len(alone) else ()):
            begins[i], lengths[i], equal[i], same[i] = at, len(ids), e, s
            kept.append(np.array(ids, dtype=np.int32))
            at += len(ids)
        return np.concatenate([np.empty(0, np.int32), *kept]), begins, lengths, equal, same

    def run(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[bool]]:
        """(all ids, number of ids per text, decoded texts, parity per text)."""
        if not self.cuts:
            mine = [e.ids for e in self.tokenizer.encode_batch([self.normalized(t) for t in texts], add_special_tokens=False)]
            ids = self.peer.encode(texts, num_threads=THREADS)  # no cut, no drawing: all texts are compared
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
            return np.array([i for x in ids for i in x], np.int32), sizes, back, [a == b for a, b in zip(mine, ids)]
        flat = [self.normalized(t) for t in texts]
        cut = [CHUNKS.findall(t) for t in flat]
        every = self._numbers(cut)
        reps = self.lengths[every]
        ids = self.store[np.repeat(self.begins[every] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))]
        edges = np.cumsum([0, *map(len, cut)])  # chunks of text k: edges[k] to edges[k + 1]
        ends = np.concatenate([[0], np.cumsum(reps)])[edges]
        bad, differ = (np.concatenate([[0], np.cumsum(~x[every])])[edges] for x in (self.same, self.equal))
        back = []
        for k, t in enumerate(flat):
            if bad[k + 1] > bad[k]:  # some chunk does not decode to itself
                back.append(self.tokenizer.decode(ids[ends[k] : ends[k + 1]].tolist(), skip_special_tokens=False))
            else:
                back.append(t.replace(MARK, " ")[1:])
        parity = (differ[1:] == differ[:-1]).tolist()
        every_id = []
        for k, text in enumerate(texts):
            theirs = self.peer.encode(text, return_type="numpy")
            decoded = self.peer.decode(theirs)
            parity[k] = parity[k] and np.array_equal(ids[ends[k] : ends[k + 1]], theirs) and decoded == back[k]
            every_id.append(theirs)
            back[k] = decoded
        return np.concatenate([np.empty(0, np.int32), *every_id]), np.fromiter(map(len, every_id), np.int64, len(every_id)), back, parity


RESULT = "token_ids array<int>, n_tokens long, decoded string, round_trip boolean, parity boolean"
NAMES = ["token_ids", "n_tokens", "decoded", "round_trip", "parity"]
CHARS = 2_000_000  # of the texts that are encoded at a time: bounds the Python objects a worker holds


def _portions(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbouring texts of about CHARS characters in all."""
    first = total = 0
    for k, n in enumerate(sizes):
        if k > first and total + n > CHARS:
            yield first, k - first
            first, total = k, 0
        total += n
    yield first, len(sizes) - first


def _codec(data: bytes) -> Codec:
    os.environ["RAYON_NUM_THREADS"] = str(THREADS)
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    return Codec(data)


def _encode(data: bytes):
    key = f"pieces-{xxhash.xxh3_64_hexdigest(data)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_worker(key, lambda: _codec(data))
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker left
        for whole in batches:
            lengths = pc.fill_null(pc.binary_length(whole.column(0)), 0).to_pylist()
            for at, n in _portions(lengths):
                b = whole.slice(at, n)
                texts = [t or "" for t in b.column(0).to_pylist()]
                ids, sizes, back, parity = codec.run(texts)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(sizes),
                     pa.array(back, pa.string()), pa.array([x == codec.expected(t) for x, t in zip(back, texts)], pa.bool_()),
                     pa.array(parity, pa.bool_())],
                    names=[*b.schema.names[1:], *NAMES],
                )

    return run


def encoded(docs: DataFrame, model: str = MODEL, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) with the ids, their decoding, and both checks."""
    with open(model, "rb") as f:  # on the driver; the bytes go along with the tasks
        data = f.read()
    docs = replaced(docs, *NAMES)
    own = "_text" + "_" * max(map(len, docs.columns))  # longer than any column's name
    rows = docs.select(F.col(text).alias(own), *(docs.columns if keep is None else keep))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_batches(rows, _encode(data), f"{kind}, {RESULT}" if kind else RESULT)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encoded(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", "token_ids", "round_trip", "parity", F.md5("decoded").alias("decoded_md5"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded(docs).drop("decoded")
