"""Token counts without token ids: pieces are counted once per distinct pre-token.

Documents are read in blocks. A block lists its distinct pre-tokens with their frequencies in each
of its documents, dealt by a hash of the pre-token into one packed row per partition. The task that
gets a pre-token counts its pieces once, joins the count to the frequencies of every block, and adds
up the products per document before anything moves on; the sums of a block meet in its own task.
A pre-token that is in many documents of a block is dealt by hash and block, so that no task gets
all of its list (it is then counted once in each of SALTS tasks at most).

Added tokens of the tokenizer are found first, as the library does by default; each is one token.
Nulls: a null text is empty and has no tokens. Repeated rows are each answered; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.common import partitions, table, texts

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
BLOCK_DOCS = 16_384
BLOCK_TOKENS = 4_000_000
#: A pre-token in more than this share of a block's documents is dealt to up to SALTS partitions.
COMMON = 1 / 32
SALTS = 64
#: Pre-tokens whose counts a task remembers, and sums it holds before it hands them on.
KNOWN = 1_500_000
HELD = 4_000_000


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _added(path: str) -> tuple[str, ...]:
    found = tokenizer(path).get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in found):
        raise ValueError("added tokens that take in their surroundings are not supported")
    return tuple(sorted((t.content for t in found), key=len, reverse=True))


def pre_tokens(text: str, split, added: re.Pattern | None) -> list[str]:
    if added is None or not added.search(text):
        return split(text)
    out = []
    for part in added.split(text):
        out += [part] if added.fullmatch(part) else split(part)
    return out


def _pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    sizes = np.array([a.nbytes for a in arrays], "<u8")
    return zstandard.ZstdCompressor(level=level).compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, "<u8", len(kinds)).tolist()
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of many ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)


def _dealt(words: list[str], docs: list[np.ndarray], block: int, n_parts: int) -> Iterator[tuple[int, bytes]]:
    """Packed rows (partition, data) of a block."""
    ids = np.concatenate([*docs, np.zeros(0, np.int32)]).astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    key, freq = np.unique(ids << 16 | doc, return_counts=True)
    parts = -(-freq // 65_535)  # frequencies are stored in 16 bits; larger ones are split
    if parts.max(initial=1) > 1:
        key, whole = np.repeat(key, parts), np.repeat(freq, parts)
        k = _ranges(np.zeros(len(parts), np.int64), parts)
        freq = np.minimum(whole - k * 65_535, 65_535)
    size = np.bincount(key >> 16, minlength=len(words))
    raw = [w.encode() for w in words]
    h = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
    common = size > COMMON * len(docs)
    if len(docs) > 64:
        h[common] += np.uint64(1) + np.uint64((block * 0x9E3779B97F4A7C15 >> 7) % SALTS)
    to = (h % np.uint64(n_parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    start = np.cumsum(size) - size
    length = np.array([len(r) for r in raw], np.int64)
    edges = np.searchsorted(to[order], np.arange(n_parts + 1))
    for p in range(n_parts):
        mine = order[edges[p] : edges[p + 1]]
        if len(mine):
            at = _ranges(start[mine], size[mine])
            joined = np.frombuffer(b"".join([raw[i] for i in mine.tolist()]), np.uint8)
            yield p, _pack(length[mine].astype("<u4"), size[mine].astype("<u4"), (key[at] & 0xFFFF).astype("<u2"), freq[at].astype("<u2"), joined)


def _blocks(path: str, pattern: str, n_parts: int):
    """Rows (part, block, data). part -1: the documents of the block themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        names = _added(path)
        added = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, docs, i = batch.column(0), batch.column(1), 0
            while i < len(docs):
                block, n = task << 32 | n, n + 1
                words: dict[str, int] = defaultdict()
                words.default_factory = words.__len__
                first, got, n_bytes, size = i, [], [], 0
                while i < len(docs) and len(got) < BLOCK_DOCS and size < BLOCK_TOKENS:
                    text = docs[i].as_py()
                    got.append(np.fromiter(map(words.__getitem__, pre_tokens(text, split, added)), np.int32))
                    n_bytes.append(len(text.encode()))
                    size += len(got[-1])
                    i += 1
                own = ids.slice(first, i - first)
                meta = _pack(np.array(own.fill_null(0), "<i8"), np.array(own.is_null()).astype("u1"), np.array(n_bytes, "<i8"))
                for part, data in [(-1, meta), *_dealt(list(words), got, block, n_parts)]:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["part", "block", "data"])

    return run


class Counter:
    """Numbers of pieces, counted once for each pre-token that is seen."""

    def __init__(self, path: str):
        self.encode, self.added, self.known = tokenizer(path).encode_batch_fast, set(_added(path)), {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > KNOWN:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.known.update((w, 1 if w in self.added else len(e)) for w, e in zip(part, self.encode(part, add_special_tokens=False), strict=True))
        return np.array([self.known[w] for w in words], np.int64)


def _summed(path: str):
    """Rows (block, meta, data): sums of each block's documents, over the pre-tokens of this task."""

    def flush(sums: dict[int, list]) -> pa.RecordBatch:
        rows = []
        for block, parts in sums.items():
            doc, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            total = np.bincount(doc, n)  # exact: far below 2**53
            some = np.flatnonzero(total)
            rows.append((block, _pack(some.astype("<u2"), total[some].astype("<i8"))))
        blocks, data = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([False] * len(rows), pa.bool_()), pa.array(data, pa.binary())], ["block", "meta", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, held = Counter(path), defaultdict(list), 0
        for batch in batches:
            for part, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([True]), pa.array([data], pa.binary())], ["block", "meta", "data"])
                    continue
                length, size, doc, freq, raw = _unpack(data, "<u4", "<u4", "<u2", "<u2", "u1")
                ends, text = np.cumsum(length, dtype=np.int64).tolist(), raw.tobytes()
                words = [text[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
                sums[block].append((doc.astype(np.int64), np.repeat(count(words), size) * freq))
                held += len(doc)
                if held > HELD:
                    yield flush(sums)
                    sums, held = defaultdict(list), 0
        yield flush(sums)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one block follow each other, its documents first."""
    meta, total = None, np.zeros(0, np.int64)

    def done() -> pa.RecordBatch:
        ids, null, n_bytes = meta
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(n_bytes, pa.int64()), pa.array(total, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for is_meta, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if is_meta:
                if meta is not None:
                    yield done()
                meta = _unpack(data, "<i8", "u1", "<i8")
                total = np.zeros(len(meta[0]), np.int64)
            else:
                doc, n = _unpack(data, "<u2", "<i8")
                total[doc] += n
    if meta is not None:
        yield done()


def token_counts(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document, for a byte-level BPE tokenizer
    file whose pre-tokens are the matches of pattern."""
    where = path or public_tokenizers.path(VOCABULARY)
    n = partitions(docs.sparkSession)
    dealt = texts(docs).mapInArrow(_blocks(where, pattern, 4 * n), "part int, block long, data binary")
    to = F.when(F.col("part") < 0, F.col("block")).otherwise(F.col("part").cast("long"))
    sums = dealt.repartition(n, to).mapInArrow(_summed(where), "block long, meta boolean, data binary")
    own = sums.repartition(n, "block").sortWithinPartitions("block", F.desc("meta"))
    return own.mapInArrow(_answers, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
