"""Removal of long repeated byte strings by a sparse suffix array with bucket-pointer refinement.

A byte goes if a 400-byte string that covers it also starts anywhere else in the corpus. Passages of
over 50 words that also start in another document are found beside that, in the same passes, by the same
steps over the texts' words instead of their bytes (UNITS); they are counted, nothing is removed for them.

1. Each window of 400 bytes (or 51 words) has an anchor: the leftmost of its smallest q-gram hashes. Equal
   windows have their anchors at the same place, so only suffixes near anchors are sorted. An anchor
   owns a run of consecutive windows; together they span its context.
2. Anchors fall into initial buckets by their q-gram. Anchors that are alone in a bucket are done;
   anchors whose whole contexts are equal are repeated throughout. Both are told by hashes, equal
   ones within a task before the shuffle. What is left are contexts that differ near the q-gram.
3. Of these the bytes are fetched (one of each set of equal ones), and the bucket of each position
   is refined by sorting on the bucket of the position one depth further: from 100 bytes to 200, and
   with the refined buckets again to 400 (words: 13, 26, 51). Windows that share a bucket then are repeated.
   A q-gram with more than HOT contexts isn't gathered: its windows are dealt by their own hashes.

Words, buckets of the first depth and contexts are named by hashes (64 bits beside the q-gram's 64; hot windows
by 128). Texts travel as compressed packs with many documents each.

Nulls: a null text is empty; null ids are answered as such. Repeated rows are documents of their
own, so that a repeated long text goes as a whole; for passages, rows of one doc_id and text are one
document. Texts under 400 bytes lose nothing. Empty
tables give no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.common import partitions, stored, table, texts, tidy
from doclattice.llm.tokens import _pack, _ranges, _unpack

LENGTH = 400


@dataclass(frozen=True)
class Unit:
    """What windows are made of: symbols in a window, in its q-grams and in the first buckets."""

    length: int
    qgram: int
    depth: int
    kind: str

    @property
    def width(self) -> int:
        """q-grams in a window."""
        return self.length - self.qgram + 1


BYTES, WORDS = 0, 1
UNITS = (Unit(LENGTH, 128, 100, "u1"), Unit(51, 8, 13, "<u8"))
CHUNK = 120_000  # symbols that are hashed at once; what is left of them may come to it
MOST = 1 << 18  # symbols that a Rolling can have
HOT = 20_000  # contexts of one q-gram that are gathered at most
HOT_CONTEXTS = 350  # whose windows are hashed at once; they have less than MOST symbols
NONE = -(1 << 63)  # stands for a null doc_id
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

CLASS, COVER, ACTIVE = 0, 1, 2
ROWS = "kind byte, h long, f long, doc long, text long, at long"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


@functools.cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    def up(b: int) -> np.ndarray:
        out = np.full(MOST, b, U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return up(base), up(pow(base, -1, 1 << 64))


class Rolling:
    """Hashes of any ranges of an array, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, x: np.ndarray, base: int):
        powers, self.inverse = _powers(base)
        self.sums = np.zeros(len(x) + 1, U)
        np.cumsum((x.astype(U) + U(1)) * powers[: len(x)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        z = (self.sums[end] - self.sums[start]) * self.inverse[start]
        z ^= z >> U(32)
        z *= U(0xD6E8FEB86659FD93)
        z ^= z >> U(29)
        return z


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word of a text."""
    if len(raw) > MOST:  # in pieces that end before a blank
        out, a = [], 0
        while a < len(raw):
            b = a + MOST
            while b < len(raw) and (cut := max(raw.rfind(b" ", a + 1, b), raw.rfind(b"\n", a + 1, b))) < 0:
                b += MOST
            b = len(raw) if b >= len(raw) else cut
            out.append(_word_hashes(raw[a:b]))
            a = b
        return np.concatenate(out)
    return _word_hashes(raw)


@functools.cache
def _places() -> np.ndarray:
    return _powers(BASES[2])[0][: 1 << 16]


def _word_hashes(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8)
    solid = (x != 32) & ((x < 9) | (x > 13))
    edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return np.zeros(0, U)
    at = _ranges(start, size)
    z = np.add.reduceat((x[at].astype(U) + U(1)) * _places()[at - np.repeat(start, size) & 0xFFFF], np.cumsum(size) - size)
    z ^= size.astype(U) * U(BASES[0])
    z ^= z >> U(31)
    return z * U(0xD6E8FEB86659FD93)


def symbols(raw: bytes, unit: int) -> np.ndarray:
    return word_hashes(raw) if unit else np.frombuffer(raw, np.uint8)


def anchors(x: np.ndarray, ends: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Of texts that lie one after the other in x: h, f, first and last owned window of each anchor.
    ends: where texts end."""
    n = len(x) - unit.length + 1
    if n < 1:
        return (np.zeros(0, U),) * 2 + (np.zeros(0, np.int64),) * 2
    grams = np.arange(len(x) - unit.qgram + 1)
    rolling = Rolling(x, BASES[0])
    h = rolling(grams, grams + unit.qgram)
    key = (h & U(0xFFFFFFFF00000000)) | grams.astype(U)
    padded = np.full(-(-len(key) // unit.width) * unit.width, U(2**64 - 1))
    padded[: len(key)] = key
    rows = padded.reshape(-1, unit.width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    best = (np.minimum(behind[:n], ahead[unit.width - 1 : unit.width - 1 + n]) & U(0xFFFFFFFF)).astype(np.int64)
    inside = np.ones(n + 1, bool)
    inside[n] = False
    for e in ends.tolist():
        inside[max(0, e - unit.length + 1) : e] = False
    new = inside[:n].copy()
    new[1:] &= (best[1:] != best[:-1]) | ~inside[: n - 1]
    first = np.flatnonzero(new)
    last_of = inside[:n] & (np.append(new[1:], True) | ~inside[1:])
    last = np.flatnonzero(last_of)
    f = Rolling(x, BASES[1])(first, last + unit.length) ^ (last - first).astype(U)
    return h[best[first]], f, first, last


def _part(doc: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    mixed = text.view(U) ^ (doc.view(U) * U(BASES[0]))
    return ((mixed ^ (mixed >> U(33))) % U(n)).astype(np.int64)


def _merged(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges joined where they touch; in order of group, start, and ends that don't fall in a group."""
    if not len(start):
        return group, start, end
    new = np.append(True, (group[1:] != group[:-1]) | (start[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return group[at], start[at], end[np.append(at[1:], len(start)) - 1]


def _at(lo, unit, span, dup) -> np.ndarray:
    """Place, unit, windows beside the first, and whether it is known to be repeated, in one number."""
    return lo << 13 | unit << 12 | span << 1 | dup


def _from_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, unit and span."""
    return at >> 13, at >> 12 & 1, at >> 1 & 0x7FF


LENGTHS = np.array([u.length for u in UNITS])


def _rows(kind: int, h, f, doc, text, at) -> pa.RecordBatch:
    n = len(doc)
    cols = [np.full(n, kind, np.int8), *(np.broadcast_to(np.asarray(v), n) for v in (h, f, doc, text, at))]
    return pa.RecordBatch.from_arrays([pa.array(cols[0])] + [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols[1:]], NAMES)


def _key(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    doc = np.array(batch.column(0).fill_null(NONE), np.int64)
    raw = [t.as_py().encode() for t in batch.column(1)]
    return doc, raw, np.fromiter(map(xxhash.xxh64_intdigest, raw), U, len(raw)).view(np.int64)


def _chunks(raw: list[bytes], most: int, unit: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Pieces (row, offset in its text), their joined symbols and ends. Long texts come in pieces that
    overlap so that each window is in one of them."""
    pieces, parts, size = [], [], 0
    length = UNITS[unit].length
    for i, text in enumerate(raw):
        t = symbols(text, unit)
        for a in range(0, len(t) - length + 1, most):
            piece = t[a : a + most + length - 1]
            pieces.append((i, a))
            parts.append(piece)
            size += len(piece)
            if size >= most:
                yield pieces, np.concatenate(parts), np.cumsum([len(p) for p in parts])
                pieces, parts, size = [], [], 0
    if parts:
        yield pieces, np.concatenate(parts), np.cumsum([len(p) for p in parts])


def _several(start: np.ndarray, size: np.ndarray, doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each group of rows that follow each other is of several documents."""
    first = np.repeat(start, size)
    return np.logical_or.reduceat((doc != doc[first]) | (text != text[first]), start) if len(start) else np.zeros(0, bool)


def _owners(doc: np.ndarray, text: np.ndarray, dup: np.ndarray) -> np.ndarray:
    """A number for each document; what is known to be in several ones has a number of its own."""
    order = np.lexsort((text, doc))
    d, t = doc[order], text[order]
    out = np.empty(len(doc), np.int64)
    out[order] = np.cumsum(np.append(False, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))[: len(d)])
    out[dup == 1] = -1 - np.arange(int((dup == 1).sum()))
    return out


def _shared(name: np.ndarray, owner: np.ndarray | None) -> np.ndarray:
    """Whether each name is there twice or, with owners, has two of them."""
    if owner is None:
        return np.bincount(name)[name] > 1
    out = np.zeros(len(name), bool)
    if len(name):
        order = np.argsort(name, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(name[order]) != 0))
        low, high = np.minimum.reduceat(owner[order], start), np.maximum.reduceat(owner[order], start)
        out[order] = np.repeat(low != high, np.diff(np.append(start, len(name))))
    return out


def _bucketed(chunk: int):
    """Anchors of documents. Those with equal contexts in a batch are settled; one of them goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, raw, text = _key(batch)
            for unit in (BYTES, WORDS):
                yield from bucketed(doc, raw, text, unit)

    def bucketed(doc: np.ndarray, raw: list[bytes], text: np.ndarray, unit: int) -> Iterator[pa.RecordBatch]:
        found = []
        for pieces, joined, ends in _chunks(raw, chunk, unit):
            h, f, first, last = anchors(joined, ends, UNITS[unit])
            row, offset = np.array(pieces).T
            k = np.searchsorted(ends, first, side="right")
            begin = np.append(0, ends[:-1])
            found.append((h, f, row[k], first - begin[k] + offset[k], last - first))
        if not found:
            return
        h, f, row, lo, span = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((lo, row, f, h))
        hs, fs = h[order], f[order]
        new = np.append(True, (hs[1:] != hs[:-1]) | (fs[1:] != fs[:-1]))[: len(hs)]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(hs)))
        found_twice = _several(start, size, doc[row[order]], text[row[order]]) if unit else size > 1
        twice = np.repeat(found_twice, size)
        go = new | ~twice
        one = order[go]
        yield _rows(CLASS, h[one], f[one], doc[row[one]], text[row[one]], _at(lo[one], unit, span[one], twice[go]))
        known = np.sort(order[twice])
        known = known[np.lexsort((lo[known], row[known]))]
        r, a, b = _merged(row[known], lo[known], lo[known] + span[known] + UNITS[unit].length)
        yield _rows(COVER, unit, b, doc[r], text[r], a)

    return run


def _settled(hot: int):
    """From anchors in order of h and f: what is repeated as a whole, and what must be looked into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        hot_h: int | None = None
        waited = 0

        def settle(cols: list[np.ndarray], on: bool) -> Iterator[pa.RecordBatch]:
            """on: the last bucket goes on in further batches, as a hot one."""
            nonlocal held, hot_h
            h, f, doc, text, at = cols
            if not len(h):
                return
            class_new = np.append(True, (h[1:] != h[:-1]) | (f[1:] != f[:-1]))
            start = np.flatnonzero(class_new)
            size = np.diff(np.append(start, len(h)))
            lo, unit, span = _from_at(at)
            twice = np.where(unit[start] == WORDS, _several(start, size, doc, text), size > 1)
            dup = twice | (np.add.reduceat(at & 1, start) > 0)
            of = np.cumsum(class_new) - 1
            whole = dup[of] & (at & 1 == 0)
            yield _rows(COVER, unit[whole], (lo + span + LENGTHS[unit])[whole], doc[whole], text[whole], lo[whole])
            bucket = np.cumsum(np.append(True, h[start][1:] != h[start][:-1])) - 1
            many = np.bincount(bucket)[bucket]
            if hot_h is not None:
                many = np.where(h[start] == hot_h, hot + 1, many)
            go = many > 1
            if on:
                hot_h = int(h[-1])
                many = np.where(h[start] == hot_h, hot + 1, many)
                go[h[start] == hot_h] = True
                go[-1] = False  # the last class may go on too
                kept = slice(start[-1], start[-1] + 1 if dup[-1] else len(h))
                held = [c[kept].copy() for c in cols]
                held[4] |= int(dup[-1])
            # One of each class that is settled goes on, and all of others.
            s = np.flatnonzero(go[of] & (class_new | ~dup[of]))
            yield _rows(ACTIVE, h[s], (many[of[s]] > hot).astype(np.int64), doc[s], text[s], (at[s] & ~1) | dup[of[s]])

        for batch in batches:
            kind = np.array(batch.column(0))
            cols = [np.array(c) for c in batch.columns[1:]]
            if (cover := kind == COVER).any():
                yield _rows(COVER, *[c[cover] for c in cols])
                cols = [c[~cover] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [c[cut:] for c in cols]
            yield from settle([c[:cut] for c in cols], False)
            if len(held[0]) > hot and len(held[0]) > waited:
                yield from settle(held, True)
                waited = 2 * len(held[0])  # the rows of one class stay; don't look at them too often
        if held is not None:
            yield from settle(held, False)

    return run


def _packs(n: int):
    """Documents, packed by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, raw, text = _key(batch)
            part = _part(doc, text, n)
            size = np.array([len(r) for r in raw], np.int64)
            for p in np.unique(part).tolist():
                i = np.flatnonzero(part == p)
                data = _pack(doc[i], text[i], size[i], np.frombuffer(b"".join([raw[k] for k in i.tolist()]), np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([True]), pa.array([data], pa.binary())], ["part", "last", "data"])

    return run


def _notes(n: int):
    """Rows on documents (doc, text and three numbers), packed by the documents' partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, f, doc, text, at = (np.array(c) for c in batch.columns[1:])
            part = _part(doc, text, n)
            order = np.argsort(part, kind="stable")
            values, first = np.unique(part[order], return_index=True)
            for p, i in zip(values.tolist(), np.split(order, first[1:]), strict=False):
                data = _pack(doc[i], text[i], h[i], f[i], at[i])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([False]), pa.array([data], pa.binary())], ["part", "last", "data"])

    return run


PACK = "part long, last boolean, data binary"


def _met(notes: DataFrame, docs: DataFrame, reader, schema: str) -> DataFrame:
    """Run reader over each partition's notes and then its documents."""
    n = partitions(docs.sparkSession)
    packs = docs.mapInArrow(tidy(_packs(4 * n)), PACK)
    rows = notes.select(*NAMES).mapInArrow(tidy(_notes(4 * n)), PACK).unionByName(packs)
    return rows.repartition(n, "part").sortWithinPartitions("part", "last").mapInArrow(tidy(reader), schema)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[int, int, bytes]]]]:
    """For each pack of documents: notes by (doc, text) as arrays h, f, at, and the documents."""
    part, notes = None, []
    by: dict[tuple[int, int], list[np.ndarray]] | None = None
    for batch in batches:
        for p, last, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                part, notes, by = p, [], None
            if not last:
                notes.append(_unpack(data, "<i8", "<i8", "<i8", "<i8", "<i8"))
                continue
            if by is None:
                by = {}
                if notes:
                    cols = [np.concatenate(c) for c in zip(*notes, strict=True)]
                    order = np.lexsort((cols[4], cols[1], cols[0]))
                    cols = [c[order] for c in cols]
                    new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
                    at = np.append(np.flatnonzero(new), len(order))
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                        by[int(cols[0][a]), int(cols[1][a])] = [c[a:b] for c in cols[2:]]
            doc, text, size, raw = _unpack(data, "<i8", "<i8", "<i8", "u1")
            ends, raw = np.cumsum(size).tolist(), raw.tobytes()
            yield by, [(d, t, raw[a:b]) for d, t, a, b in zip(doc.tolist(), text.tolist(), [0, *ends], ends, strict=False)]


def _contexts(n: int):
    """The bytes of active anchors' contexts, packed by q-gram; hashes of hot ones' windows, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for by, docs in _documents(batches):
            plain: tuple[list, list] = ([], [])
            hot: tuple[list, list] = ([], [])
            for d, t, raw in docs:
                if (found := by.get((d, t))) is None:
                    continue
                texts = [None, None]
                for h, f, at in zip(*(c.tolist() for c in found), strict=True):
                    lo, unit, span = _from_at(at)
                    if texts[unit] is None:
                        texts[unit] = symbols(raw, unit)
                    context = texts[unit][lo : lo + span + UNITS[unit].length].copy()
                    (hot if f else plain)[unit].append((h, d, t, lo, span, at & 1, context))
            for unit in (BYTES, WORDS):
                if plain[unit]:
                    h, d, t, lo, span, dup, parts = zip(*plain[unit], strict=True)
                    to = np.array(h, np.int64).view(U) % U(n)
                    cols = [np.array(c, np.int64) for c in (d, t, lo, span, dup)]
                    for p in np.unique(to).tolist():
                        i = np.flatnonzero(to == p)
                        yield packed(2 * int(p) + unit, False, *[c[i] for c in cols], np.concatenate([parts[k] for k in i.tolist()]))
                for a in range(0, len(hot[unit]), HOT_CONTEXTS):
                    yield from windows(hot[unit][a : a + HOT_CONTEXTS], unit)

    def windows(some: list, unit: int) -> Iterator[pa.RecordBatch]:
        h, d, t, lo, span, dup, parts = zip(*some, strict=True)
        length = UNITS[unit].length
        x, count = np.concatenate(parts), np.array(span) + 1
        start = np.cumsum(count + length - 1) - (count + length - 1)
        at = _ranges(start, count)
        w = [Rolling(x, b)(at, at + length) for b in BASES[:2]]
        cols = [np.repeat(np.array(c, np.int64), count) for c in (d, t, dup)]
        s = np.repeat(np.array(lo, np.int64), count) + at - np.repeat(start, count)
        to = w[0] % U(n)
        for p in np.unique(to).tolist():
            i = np.flatnonzero(to == p)
            yield packed(2 * int(p) + unit, True, *[c[i] for c in cols], s[i], w[0][i], w[1][i])

    def packed(part: int, last: bool, *cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([last]), pa.array([_pack(*cols)], pa.binary())], ["part", "last", "data"])

    return run


def refined(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    """New buckets of positions: in order of their bucket and of the bucket at the later offset."""
    order = np.lexsort((later, bucket))
    b, t = bucket[order], later[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.append(False, (b[1:] != b[:-1]) | (t[1:] != t[:-1])))
    return out


def repeated_windows(x: np.ndarray, spans: np.ndarray, unit: Unit, owner: np.ndarray | None = None) -> np.ndarray:
    """Whether each window of the contexts in x (of span + length symbols each) is there twice; with
    the contexts' owners, whether it has two."""
    size = spans + unit.length
    start = np.cumsum(size) - size
    # Buckets of the first depth, at the places that windows lead to.
    at = _ranges(start, spans + 1 + unit.length - unit.depth)
    bucket, h = np.zeros(len(x), np.int64), []
    step = MOST // 2 // (unit.width + unit.length)
    for k in range(0, len(spans), step):
        begin, part = start[k], size[k : k + step]
        own = _ranges(start[k : k + step] - begin, part - unit.depth + 1)
        h.append(Rolling(x[begin : begin + part.sum()], BASES[2])(own, own + unit.depth))
    _, bucket[at] = np.unique(np.concatenate(h), return_inverse=True)
    depth = unit.depth
    while depth < unit.length:
        further = min(depth, unit.length - depth)
        at = _ranges(start, spans + 1 + unit.length - depth - further)
        bucket[at] = refined(bucket[at], bucket[at + further])
        depth += further
    windows = bucket[_ranges(start, spans + 1)]
    return _shared(windows, None if owner is None else np.repeat(owner, spans + 1))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of the contexts that meet in a part, as ranges of their documents."""

    def plain(packs: list, unit: int) -> pa.RecordBatch:
        doc, text, lo, span, dup, x = (np.concatenate(c) for c in zip(*packs, strict=True))
        hit = repeated_windows(x, span, UNITS[unit], _owners(doc, text, dup) if unit else None)
        context = np.repeat(np.arange(len(span)), span + 1)
        at = np.repeat(lo, span + 1) + _ranges(np.zeros(len(span), np.int64), span + 1)
        hit &= dup[context] == 0
        c, a, b = _merged(context[hit], at[hit], at[hit] + UNITS[unit].length)
        return _rows(COVER, unit, b, doc[c], text[c], a)

    def hot(packs: list, unit: int) -> pa.RecordBatch:
        doc, text, dup, s, w0, w1 = (np.concatenate(c) for c in zip(*packs, strict=True))
        name = refined(w0.view(np.int64), w1.view(np.int64))
        hit = np.flatnonzero(_shared(name, _owners(doc, text, dup) if unit else None) & (dup == 0))
        hit = hit[np.lexsort((s[hit], text[hit], doc[hit]))]
        same = np.cumsum(np.append(False, (doc[hit][1:] != doc[hit][:-1]) | (text[hit][1:] != text[hit][:-1])))[: len(hit)]
        length = UNITS[unit].length
        _, a, b = _merged(same, s[hit], s[hit] + length)
        at = np.flatnonzero(np.append(True, (same[1:] != same[:-1]) | (s[hit][1:] > s[hit][:-1] + length)))[: len(a)] if len(hit) else hit
        return _rows(COVER, unit, b, doc[hit][at], text[hit][at], a)

    held: dict[tuple[int, bool], list] = defaultdict(list)

    def flush() -> Iterator[pa.RecordBatch]:
        for (p, is_hot), packs in held.items():
            yield (hot if is_hot else plain)(packs, p & 1)
        held.clear()

    part = None
    for batch in batches:
        for p, last, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p != part:
                yield from flush()
                part = p
            held[p, last].append(_unpack(data, *(["<i8"] * 4 + ["<u8"] * 2 if last else ["<i8"] * 5 + [UNITS[p & 1].kind])))
    yield from flush()


def covers(docs: DataFrame, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """Repeated ranges [at, f) of each document (doc, text hash), in the units that h tells; they may
    overlap."""
    if hot < 1:
        raise ValueError("hot is at least 1")
    n = partitions(docs.sparkSession)
    rows = docs.mapInArrow(tidy(_bucketed(chunk)), ROWS)
    dealt = rows.repartition(n, F.when(F.col("kind") == CLASS, F.col("h")).otherwise(F.col("text"))).sortWithinPartitions("kind", "h", "f")
    told = stored(dealt.mapInArrow(tidy(_settled(hot)), ROWS))
    contexts = _met(told.filter(F.col("kind") == ACTIVE), docs, _contexts(4 * n), PACK)
    looked = contexts.repartition(n, "part").sortWithinPartitions("part").mapInArrow(tidy(_found), ROWS)
    return told.filter(F.col("kind") == COVER).unionByName(looked)


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long"


def _spans(found: list[np.ndarray] | None, unit: int) -> list[list[int]]:
    """Ranges in the unit, joined where they touch."""
    spans: list[list[int]] = []
    if found is not None:
        mine = found[0] == unit
        for a, b in zip(found[2][mine].tolist(), found[1][mine].tolist(), strict=True):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
    return spans


def _cut(raw: bytes, spans: list[list[int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for by, docs in _documents(batches):
        out = []
        for d, t, raw in docs:
            found = by.get((d, t))
            spans = _spans(found, BYTES)
            kept = _cut(raw, spans)
            out.append((None if d == NONE else d, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(_spans(found, WORDS))))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in REPORT.split(", ")])


def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for by, docs in _documents(batches):
        out = [(None if d == NONE else d, _cut(raw, _spans(by.get((d, t)), BYTES))) for d, t, raw in docs]
        ids, kept = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "kept"])


def kept_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and kept, the bytes that are left of each document."""
    docs = texts(docs)
    return _met(covers(docs), docs, _kept_texts, "doc_id long, kept binary")


def report(docs: DataFrame, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """Digest columns for each document; n_passages: maximal runs of words that 51-word windows cover
    which also start in another document."""
    docs = texts(docs)
    return _met(covers(docs, hot, chunk), docs, _reported, REPORT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


#: Windows are compared by their MD5; bytes are pairs of hexadecimal digits.
ORACLE_SQL = r"""
with d as (select row_number() over () as k, doc_id, hex(encode(coalesce(text, ''))) as x, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
w as (select k, unnest(range(length(x) // 2 - 399)) as i, x from d where length(x) >= 800),
h as (select k, i, md5_number(substr(x, 2 * i + 1, 800)) as h from w),
r as (select k, i from (select k, i, count(*) over (partition by h) as n from h) where n > 1),
s as (select k, i, coalesce(i > max(i) over (partition by k order by i rows between unbounded preceding and 1 preceding) + 400, true) as new from r),
g as (select k, i, sum(new::int) over (partition by k order by i rows unbounded preceding) as g from s),
spans as (select k, g, min(i) as a, max(i) + 400 as b from g group by k, g),
cuts as (select k, b, lag(b, 1, 0) over (partition by k order by a) as begin, a as "end", b - a as size from spans),
kept as (select k, string_agg(substr(x, 2 * begin + 1, 2 * ("end" - begin)), '' order by begin) || substr(any_value(x), 2 * max(b) + 1) as x, sum(size) as n_removed, count(*) as n_spans from cuts join d using (k) group by k),
o as (select k, dense_rank() over (order by doc_id, x) as owner from d),
pw as (select k, i, md5_number(array_to_string(words[i + 1:i + 51], ' ')) as h from (select k, words, unnest(range(len(words) - 50)) as i from d where len(words) > 50)),
pr as (select k, i from (select k, i, min(owner) over (partition by h) as low, max(owner) over (partition by h) as high from pw join o using (k)) where low <> high),
ps as (select k, count(*) as n_passages from (select k, coalesce(i > lag(i) over (partition by k order by i) + 51, true) as new from pr) where new group by k)
select doc_id, cast(length(d.x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.x, d.x))) as kept_sha256, coalesce(n_passages, 0) as n_passages
from d left join kept using (k) left join ps using (k)
"""
