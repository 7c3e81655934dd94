"""Byte-level BPE encoding and decoding by corpus-level merge replay.

1. Documents are read in blocks. A block keeps the sequence of its documents' pre-tokens, as numbers,
   and asks for the ids of its distinct ones: they are dealt by hash.
2. A task gets its share of the corpus's distinct pre-tokens from all blocks and replays the merges on
   all of them together, each once: their bytes lie in one array of linked symbols, and an inverted
   index holds, for each rank, the positions of the pairs that have it. Ranks are popped in order; a
   merge is applied at all its positions at once and touches only the two neighbouring pairs.
3. The answers meet the sequences of their blocks; ids are put in the documents' order and decoded.

What a task holds of step 2 is its share of the vocabulary; the requests that wait for a replay are
bounded by WAITING. Step 1 is written to the shared folder, and read by steps 2 and 3.

Nulls: a null text is empty (no ids). Very long texts are encoded whole. Repeated rows are each
answered, an empty table gives no rows, further columns are not read.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclattice.llm.common import partitions, stored, table, texts, tidy
from doclattice.llm.tokens import _pack, _ranges, _unpack

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Documents and pre-tokens of a block (a longer document is a block of its own).
BLOCK_DOCS = 16_384
BLOCK_TOKENS = 8_000_000
#: Of the compression of what is stored and shuffled.
LEVEL = 3
#: Pre-tokens asked for, by all blocks together, after which a task replays those that are new.
WAITING = 1_000_000

NONE = np.iinfo(np.int64).max


class Replay:
    """Encoder for one vocabulary file of lines `base64 rank`."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = self.ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.digits = {i: str(i) for i in self.bytes}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every pair of tokens that makes a token, by the key first << 32 | second.
        pairs = sorted((ranks[a] << 32 | ranks[b], r) for t, r in ranks.items() for i in range(1, len(t)) if (a := t[:i]) in ranks and (b := t[i:]) in ranks)
        self.keys, self.makes = np.array(pairs, np.int64).T.copy()

    def pair(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        """Rank of the token that each pair makes, NONE where there is none (or where a or b is an end)."""
        key = np.left_shift(np.asarray(a, np.int64), 32) | b
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == key, self.makes[i], NONE)

    def one(self, word: bytes) -> list[int]:
        """A single pre-token: always the leftmost pair of the lowest rank."""
        ids = self.byte_id[list(word)]
        while len(ids) > 1:
            ranks = self.pair(ids[:-1], ids[1:])
            i = int(ranks.argmin())
            if ranks[i] == NONE:
                break
            ids[i] = ranks[i]
            ids = np.delete(ids, i + 1)
        return ids.tolist()

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each distinct pre-token, all merged together in rank order."""
        out: list[list[int] | None] = [[self.ranks[w]] if w in self.ranks else None for w in words]
        todo = [k for k, ids in enumerate(out) if ids is None]
        if not todo:
            return out  # type: ignore[return-value]
        sizes = np.array([len(words[k]) for k in todo])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        sym = np.full(int((sizes + 1).sum()), -1, np.int64)  # -1 after each word: no pair reaches over it
        sym[np.arange(len(sym)) - np.repeat(starts, sizes + 1) < np.repeat(sizes, sizes + 1)] = self.byte_id[np.frombuffer(b"".join(words[k] for k in todo), np.uint8)]
        nxt, prv = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        rank = np.full(len(sym) + 1, NONE)
        rank[: len(sym) - 1] = self.pair(sym[:-1], sym[1:])
        found = np.flatnonzero(rank < NONE)
        found = found[np.argsort(rank[found], kind="stable")]
        values, first = np.unique(rank[found], return_index=True)
        index: dict[int, list[int]] = {int(v): p.tolist() for v, p in zip(values, np.split(found, first[1:]), strict=False)}
        alive = np.ones(len(sym), bool)
        heap = list(index)
        heapify(heap)
        odd: set[int] = set()
        while heap:
            r = heappop(heap)
            at = np.array(index.pop(r), np.int64)
            at.sort()
            fresh = rank[at] == r  # else a neighbour has been merged meanwhile
            fresh[1:] &= at[1:] != at[:-1]
            at = at[fresh]
            if not len(at):
                continue
            second = nxt[at]
            if (rank[second] == r).any():  # overlapping pairs: leftmost first
                keep, taken = [], -1
                for p, q in zip(at.tolist(), second.tolist(), strict=True):
                    if p != taken:
                        keep.append(p)
                        taken = q
                at = np.array(keep, np.int64)
                second = nxt[at]
            after = nxt[second]
            was = sym[after]
            sym[at], nxt[at], prv[after] = r, after, at
            before = prv[at]
            rank[second], alive[second] = NONE, False
            right = self.pair(r, sym[after])
            left = np.where(before >= 0, self.pair(sym[before], r), NONE)
            rank[at] = right
            rank[before[before >= 0]] = left[before >= 0]
            # What a merge makes with its neighbours, also if those change in the same step.
            low = (np.minimum(right, left) < r) | (self.pair(r, was) < r)
            if low.any():
                odd.update(at[low].tolist())
            new, where = np.concatenate([right, left]), np.concatenate([at, before])
            for v, p in zip(new[new < NONE].tolist(), where[new < NONE].tolist(), strict=True):
                if v in index:
                    index[v].append(p)
                else:
                    index[v] = [p]
                    heappush(heap, v)
        alive &= sym >= 0
        left_of = np.concatenate([[0], np.cumsum(alive)])
        ids, ends = sym[alive].tolist(), left_of[starts + sizes].tolist()
        for k, a, b in zip(todo, left_of[starts].tolist(), ends, strict=True):
            out[k] = ids[a:b]
        # A merge that makes a pair of a lower rank than its own: within one word that pair comes
        # first, so such words are done alone.
        for j in {int(np.searchsorted(starts, p, side="right")) - 1 for p in odd}:
            out[todo[j]] = self.one(words[todo[j]])
        return out  # type: ignore[return-value]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.cache
def encoder(path: str) -> Replay:
    return Replay(path)


@functools.cache
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)])))


#: Streams of bytes that a column of numbers below 2**28 is stored in.
STREAMS = ["u1"] * 4


def _streams(x: np.ndarray) -> list[np.ndarray]:
    """Seven bits of each number, lowest first, with a mark where more follow; the further bits of
    those alone in the next stream. Small numbers take little room, and streams compress well."""
    out = []
    for _ in STREAMS:
        more = x >= 128
        out.append((x & 127 | more * 128).astype("u1"))
        x = x[more] >> 7
    if len(x):
        raise ValueError("numbers of 2**28 and more can't be stored")
    return out


def _whole(streams: list[np.ndarray]) -> np.ndarray:
    x = np.zeros(0, np.int32)
    for s in reversed(streams):
        now = (s & 127).astype(np.int32)
        now[s >= 128] |= x << 7
        x = now
    return x


def _blocks(pattern: str, n_parts: int):
    """Rows (part, block, data). part -1: ids and sequences of the block's documents; else a request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _pattern(pattern).findall
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, docs, i = batch.column(0), batch.column(1), 0
            while i < len(docs):
                block, n = task << 32 | n, n + 1
                words: dict[str, int] = defaultdict()
                words.default_factory = words.__len__
                first, got, size = i, [], 0
                while i < len(docs) and len(got) < BLOCK_DOCS and size < BLOCK_TOKENS:
                    got.append(array("i", map(words.__getitem__, split(docs[i].as_py()))))
                    size += len(got[-1])
                    i += 1
                flat = np.concatenate([np.frombuffer(x, np.int32) for x in got if len(x)] or [np.zeros(0, np.int32)])
                to = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) % np.uint64(n_parts)
                raw = pa.array(words.keys(), pa.string())
                alphabetic, number = np.empty((2, len(raw)), np.int32)
                alphabetic[np.array(pc.sort_indices(raw))] = np.arange(len(raw))
                # Small numbers for common ones; of those that are equally common, a part's lie together in order.
                number[np.lexsort((alphabetic, to, -np.bincount(flat, minlength=len(raw))))] = np.arange(len(raw))
                own = ids.slice(first, i - first)
                sizes = np.array([len(x) for x in got], "<i8")
                meta = _pack(np.array(own.fill_null(0), "<i8"), np.array(own.is_null()).astype("u1"), sizes, *_streams(number[flat]), level=LEVEL)
                rows = [(-1, meta)]
                for p in np.unique(to).tolist():
                    mine = np.flatnonzero(to == p)
                    mine = mine[np.argsort(number[mine])]
                    _, ends, data = raw.take(pa.array(mine)).buffers()
                    ends = np.frombuffer(ends, np.int32, len(mine) + 1)
                    rows.append((int(p), _pack(*_streams(np.diff(number[mine], prepend=0)), *_streams(np.diff(ends)), np.frombuffer(data, "u1", ends[-1]), level=LEVEL)))
                parts, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array(data, pa.binary())], ["part", "block", "data"])

    return run


class Known:
    """Ids of the pre-tokens that a task has replayed, each once."""

    def __init__(self, bpe: Replay):
        self.bpe, self.number, self.ids, self.end = bpe, {}, array("i"), array("q", [0])

    def learn(self, words: list[bytes]) -> None:
        was = gc.isenabled()
        gc.disable()  # millions of live lists and no cycles
        try:
            for w, ids in zip(words, self.bpe.replay(words), strict=True):
                self.number[w] = len(self.number)
                self.ids.extend(ids)
                self.end.append(len(self.ids))
        finally:
            if was:
                gc.enable()

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each has, and all of them, one after the other."""
        k = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        end = np.frombuffer(self.end, np.int64)
        size = end[k + 1] - end[k]
        return size, np.frombuffer(self.ids, np.int32)[_ranges(end[k], size)] if len(self.ids) else np.zeros(0, np.int32)


ANSWERS = "block long, meta boolean, data binary"


def _replayed(path: str):
    """Answers (numbers in the block, sizes and ids) to the requests of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(encoder(path))
        held: list[tuple[int, list[np.ndarray], list[bytes]]] = []
        fresh: dict[bytes, None] = {}
        waiting = 0

        def answered() -> pa.RecordBatch:
            known.learn(list(fresh))
            data = []
            for _, number, words in held:
                size, ids = known(words)
                data.append(_pack(*number, *_streams(size), *_streams(ids), level=LEVEL))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held], pa.int64()), pa.array([False] * len(held), pa.bool_()), pa.array(data, pa.binary())], ["block", "meta", "data"])

        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                *streams, raw = _unpack(data, *STREAMS, *STREAMS, "u1")
                number, ends, text = streams[:4], np.cumsum(_whole(streams[4:]), dtype=np.int64).tolist(), raw.tobytes()
                words = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
                held.append((block, number, words))
                fresh.update((w, None) for w in words if w not in known.number)
                waiting += len(words)
                if waiting > WAITING:
                    yield answered()
                    held, fresh, waiting = [], {}, 0
        yield answered()

    return run


def _encoded(path: str, with_ids: bool):
    """Rows of one block follow each other, its documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        meta, answers = None, []

        def done() -> Iterator[pa.RecordBatch]:
            doc, null, sizes, *streams = meta
            words = _whole(streams)
            number, size, ids = (np.concatenate(x) for x in zip(*answers, strict=True)) if answers else (np.zeros(0, np.int64),) * 3
            at = np.zeros(len(number) + 1, np.int64)
            length = np.zeros(len(number), np.int64)
            start = np.cumsum(size, dtype=np.int64) - size
            at[number], length[number] = start, size
            ends = np.cumsum(sizes).tolist()
            for i in range(0, len(doc), 1024):
                n, s1, s2, seqs = [], [], [], []
                for a, b in zip([0, *ends][i : i + 1024], ends[i : i + 1024], strict=False):
                    w = words[a:b]
                    seq = ids[_ranges(at[w], length[w])] if b > a else np.zeros(0, np.int32)
                    listed = seq.tolist()
                    n.append(len(listed))
                    s1.append(hashlib.sha256(" ".join(map(bpe.digits.__getitem__, listed)).encode()).hexdigest())
                    s2.append(hashlib.sha256(bpe.decode(listed)).hexdigest())
                    if with_ids:
                        seqs.append(seq.astype(np.int32))
                own = slice(i, i + len(n))
                columns = [pa.array(doc[own], pa.int64(), mask=null[own].astype(bool)), pa.array(n, pa.int64()), pa.array(s1, pa.string()), pa.array(s2, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns, names = [*columns, _lists(seqs)], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for is_meta, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if is_meta:
                    if meta is not None:
                        yield from done()
                    meta, answers = _unpack(data, "<i8", "u1", "<i8", *STREAMS), []
                else:
                    streams = _unpack(data, *STREAMS, *STREAMS, *STREAMS)
                    answers.append((np.cumsum(_whole(streams[:4])), _whole(streams[4:8]), _whole(streams[8:])))
        if meta is not None:
            yield from done()

    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, with_ids: bool = True) -> DataFrame:
    """For each document: n_tokens, the hashes of its ids and of their decoding, and the ids."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    where = path or public_tokenizers.path(VOCABULARY)
    n = partitions(docs.sparkSession)
    blocks = stored(texts(docs).mapInArrow(tidy(_blocks(pattern, 4 * n)), "part int, block long, data binary"))
    asked = blocks.filter("part >= 0").repartition(n, "part").select("block", "data")
    answers = asked.mapInArrow(tidy(_replayed(where)), ANSWERS)
    own = blocks.filter("part < 0").select("block", F.lit(True).alias("meta"), "data")
    met = own.unionByName(answers).repartition(n, "block").sortWithinPartitions("block", F.desc("meta"))
    return met.mapInArrow(tidy(_encoded(where, with_ids)), schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text. Bytes that are not
    UTF-8 become the replacement character."""
    where = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(where)
        for batch in batches:
            out = [bpe.decode(ids or []).decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, schema)


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
