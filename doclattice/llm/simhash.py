"""SimHash near-duplicates found through a segment-popcount embedding.

A fingerprint of 64 bits is cut into segments; its embedding is its vector of bits set per segment. The
Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints, so texts
within `most` bits lie within that distance on the grid. A range join on the grid with radius 2 meets
in the middle: each fingerprint is put into its own cell and into those one step away, and two vectors
within distance 2 share a cell. Pairs in a cell are then verified on the whole fingerprint.

Only distinct fingerprints take part. A cell's members are compared without listing pairs: small
cells by shifted comparison, large ones by looking every member's neighbours up among the members,
and only a spanning forest of the links of each batch leaves a task. Components come from
alternating large-star and small-star steps on the remaining links.

`deduplicated` links texts whose sets of shingles have a Jaccard similarity of at least `least`, found
in the same way on longer fingerprints and then checked on the sets. A fingerprint has bits for each of
several bands, and bits for a check. Texts are candidates if in some band the first bits agree, the
popcount vectors of the others are within Manhattan distance 2 on the grid, and the bits for the check
differ in `most` places at most. Pairs that can't be similar by the parities of their sets (an exact
bound, see `possible`) are no candidates. Candidates that hang together are a cell, and every pair of a
cell that isn't joined yet is verified on the sets; large cells are dealt to parts.

Nulls: a null text has no words; texts without words have fingerprint zero and link like any other.
Repeated rows are each answered, and a null doc_id is never a component's id unless it is alone.
Empty tables give no rows. Further columns are not read by `components`; `deduplicated` keeps them.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.common import counted, partitions, stored, table, texts

BLANK = re.compile(rb"[\x20\x09-\x0D]+")
U = np.uint64
#: The bits of a byte, each in a byte of its own.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").view(U).ravel()
#: Mix the bits of a hash; odd.
MULTIPLIER, MULTIPLIER_2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)
#: Members up to which a cell is compared pair by pair.
SMALL_CELL = 256
#: Bits of a fingerprint of `deduplicated` that are for the check alone.
CHECK = 128
#: Parities of a set of shingles; with the set's size in 16 bits they are two words.
PARITIES = 112
#: Rows whose grid cells are made at once, and rows that a bucket of regions has about.
AT_ONCE, BUCKET = 50_000, 500_000
#: Members of a cell of shingle sets that are compared in one task.
CELL = 1000


@dataclass(frozen=True)
class Plan:
    """shingle: words; segment: bits; most: differing bits of a link, 1 or 2."""

    shingle: int = 3
    segment: int = 4
    most: int = 2

    def __post_init__(self) -> None:
        if self.most not in (1, 2) or not 1 <= self.segment <= 16 or (self.segment + 3) ** (-(-64 // self.segment)) >= 1 << 61:
            raise ValueError("links have 1 or 2 differing bits, and cells fit into 61 bits")


@dataclass(frozen=True)
class Near:
    """shingle: words; bands of `rows` segments of `segment` bits, of which the first quarter agrees and
    the others are a grid; most: differing bits of the check; least: Jaccard similarity of a link."""

    shingle: int = 5
    bands: int = 104
    rows: int = 15
    segment: int = 2
    most: int = 40
    least: float = 0.8

    def __post_init__(self) -> None:
        if not 1 <= self.rows <= 15 or not 1 <= self.segment <= 2 or not 1 <= self.bands < 256:
            raise ValueError("bands have 1 to 15 segments of 1 or 2 bits, and there are up to 255")

    @property
    def grid(self) -> int:
        """Segments of the grid."""
        return self.rows - self.rows // 4


#: The contract of op10, and near copies for pipelines: five words and similarity 0.8. A bit of two
#: sets of that similarity differs with probability 0.1515, so a band has such a pair with probability
#: 0.119, and bands and check miss one with probability 0.0000033.
EXACT = Plan()
NEAR = Near()


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of the ASCII-lower-cased words, repeats included."""
    raw = text.encode().lower()
    w = BLANK.split(raw.strip(b" \t\n\v\f\r"))
    if w == [b""]:
        return np.zeros(0, U)
    if len(w) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], U)
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]).tolist()
    starts = [0, *ends]
    h, k = xxhash.xxh64_intdigest, shingle - 1
    return np.fromiter((h(joined[a : b - 1], 42) for a, b in zip(starts, ends[k:], strict=False)), U, len(w) - k)


def fingerprint(h: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes; no hashes: zero."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), 16320):
        lanes = LANES[h[a : a + 16320].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # no byte overflows
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id and fp, the fingerprint as bytes, the lowest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(shingle_hashes(t.as_py(), plan.shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(np.array(fp, U))], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp binary")


def _popcounts(fp: np.ndarray, segment: int) -> np.ndarray:
    mask = U((1 << segment) - 1)
    return np.stack([np.bitwise_count((fp >> U(i)) & mask) for i in range(0, 64, segment)], axis=1).astype(np.int64)


#: What a fingerprint is in a cell: at its centre, one step up from the cell, or one step down.
CENTRE, ABOVE, BELOW = 0, 1, 2


def _cells(fp: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells (the counts and the role in one number) and the rows in them."""
    rows, v = np.arange(len(fp)), _popcounts(fp, plan.segment)
    scale = np.array([(plan.segment + 3) ** i for i in range(v.shape[1])], np.int64) * 4
    own = (v + 1) @ scale
    yield own + CENTRE, rows
    for i in range(v.shape[1]):
        has, free = v[:, i] > 0, v[:, i] < plan.segment
        yield own[has] - scale[i] + ABOVE, rows[has]
        if plan.most > 1:
            yield own[free] + scale[i] + BELOW, rows[free]


def _binary(fp: np.ndarray) -> pa.Array:
    """64-bit words as bytes."""
    offsets = np.arange(0, 8 * len(fp) + 1, 8, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(fp), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(fp))])


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U)


def _placed(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _words(batch.column(0))
            for a in range(0, len(whole), 4096):
                fp = whole[a : a + 4096]
                for cell, rows in _cells(fp, plan):
                    yield pa.RecordBatch.from_arrays([pa.array(cell), _binary(fp[rows])], ["cell", "fp"])

    return run


class Forest:
    """Spanning forest of links between fingerprints, or names, each named by the smallest of its tree."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def link(self, x, y) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> list[tuple]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def _large(fp: np.ndarray, plan: Plan, forest: Forest) -> None:
    """Links among the members of a large cell, in time that is linear in their number: each member's
    neighbours are looked up among the members."""
    key = np.unique(fp)
    bits = [U(1 << i) for i in range(64)]
    pairs = (a ^ b for a, b in itertools.combinations(bits, 2)) if plan.most > 1 else ()
    for flip in itertools.chain(bits, pairs):
        other = key ^ flip
        i = np.searchsorted(key, other)
        i[i == len(key)] = 0
        for j in np.flatnonzero((key[i] == other) & (key < other)).tolist():
            forest.link(int(key[j]), int(other[j]))


def _linked(plan: Plan):
    roles = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 0]], bool)  # centre and above with each other
    if plan.most > 1:
        roles[ABOVE, BELOW] = roles[BELOW, ABOVE] = True

    def groups(cell: np.ndarray, role: np.ndarray, fp: np.ndarray, forest: Forest) -> None:
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        size = np.diff(edge)
        for a, n in zip(edge[:-1][size > SMALL_CELL].tolist(), size[size > SMALL_CELL].tolist(), strict=True):
            _large(fp[a : a + n], plan, forest)
        small = np.repeat((size > 1) & (size <= SMALL_CELL), size)
        cell, role, fp = cell[small], role[small], fp[small]
        for o in range(1, SMALL_CELL):
            same = np.flatnonzero(cell[o:] == cell[:-o])
            if not len(same):
                break
            same = same[roles[role[same], role[same + o]]]
            far = np.bitwise_count(fp[same] ^ fp[same + o])
            good = same[(far <= plan.most) & (far > 0)]
            for x, y in zip(fp[good].tolist(), fp[good + o].tolist(), strict=True):
                forest.link(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = [np.array(batch.column(0)), _words(batch.column(1))]
                held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if held is not None and len(held[0]):
                # The last cell may go on in the next batch.
                cell = held[0] >> 2
                cut = len(cell) if batch is None else int(np.searchsorted(cell, cell[-1]))
                if cut:
                    groups(cell[:cut], held[0][:cut] & 3, held[1][:cut], forest)
                    held = [x[cut:] for x in held]
            if batch is None or len(forest.up) > 200_000:
                links = forest.links()
                yield pa.RecordBatch.from_arrays([_binary(np.array([x[i] for x in links], U)) for i in (0, 1)], ["a", "b"])
                forest = Forest()

    return run


def links(distinct: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) that hold every component of the distinct fingerprints `fp` together."""
    placed = distinct.select("fp").mapInArrow(_placed(plan), "cell long, fp binary")
    dealt = placed.repartition(partitions(distinct.sparkSession), F.shiftright("cell", 2)).sortWithinPartitions("cell")
    return dealt.mapInArrow(_linked(plan), "a binary, b binary")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): large-star and small-star steps until nothing
    changes. Steps shuffle the links alone, and split the hubs'; each round is written to the shared folder."""
    pairs = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(pairs(edges))
    sums = (F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    mark = edges.agg(*sums).first()
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count_if(F.col("b") > F.col("a")).alias("copies")).select("a", F.least("a", "m").alias("m"), "copies")
        large = counted(both.filter("b > a"), least, ["a"], mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(pairs(large))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("copies"))
        small = counted(large, least, ["a"], mark[0])
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        edges = stored(pairs(small))
        now = edges.agg(*sums).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(distinct: DataFrame, links: DataFrame) -> DataFrame:
    """distinct with the root of each fp."""
    roots = connected(links)
    return distinct.join(roots, distinct.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def components(docs: DataFrame, plan: Plan = EXACT) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that can be reached over links."""
    marked = stored(fingerprints(docs, plan))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    named = stored(_rooted(distinct, links(distinct, plan)))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("copies"))
    label = stored(counted(named, least, ["root"], named.count()).select("fp", "component_id", F.col("n").alias("copies")))
    return counted(marked, label, ["fp"], marked.count()).select("doc_id", "fp", "component_id")


def _set(text: str, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _name(found: np.ndarray) -> bytes:
    """The name of a set of hashes: equal sets alone have equal names."""
    return xxhash.xxh3_128_digest(found.tobytes())


def _set_bits(hashes: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, after they are mixed once for each word of a fingerprint."""
    total = np.zeros(64 * len(salt), np.int64)
    for a in range(0, len(hashes), 255):  # no byte of the lanes overflows
        x = (hashes[a : a + 255, None] ^ salt) * MULTIPLIER
        x = (x ^ (x >> U(32))) * MULTIPLIER_2
        x ^= x >> U(29)
        total += LANES[x.view(np.uint8)].sum(axis=0).view(np.uint8)
    return total


def near_bits(found: np.ndarray, near: Near, salt: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of a sorted set that isn't empty: two words for the check, and a number
    for each band. A bit is set if it is in over half of the hashes; in ties, which few hashes often
    have, the successor of the smallest hash decides, so that half of the bits are set on average."""
    bits = _set_bits(found, salt) * 2 + _set_bits(found[:1] + U(1), salt) > len(found)
    width = near.rows * near.segment
    bands = bits[CHECK : CHECK + near.bands * width].reshape(near.bands, width) @ (1 << np.arange(width))
    return np.concatenate([np.packbits(bits[:CHECK], bitorder="little").view(np.int64), bands])


def parities(found: np.ndarray) -> bytes:
    """For each of PARITIES classes of hashes whether the set has an odd number of them, then the set's
    size in 16 bits; 0 stands for a size that doesn't fit."""
    odd = np.packbits(np.bincount(((found >> U(32)) % U(PARITIES)).view(np.int64), minlength=PARITIES) & 1, bitorder="little")
    return odd.tobytes() + (len(found) if len(found) < 2**16 else 0).to_bytes(2, "little")


def possible(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether sets may have a Jaccard similarity of at least least, by the two words of their parities.
    A class whose parities differ has a hash that is in one set only. Of sets of that similarity
    (1 - least) / (1 + least) of the sum of their sizes at most are such hashes, so none of them is lost."""
    size = [(w[:, 1] >> U(48)).astype(np.int64) for w in (x, y)]
    differ = x ^ y
    differ[:, 1] &= U(2**48 - 1)
    apart = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    return (apart * (1 + least) <= (size[0] + size[1]) * (1 - least) + 1e-6) | (size[0] == 0) | (size[1] == 0)


def salts(near: Near) -> np.ndarray:
    """What hashes are xored with before they are mixed, for each word of a fingerprint."""
    return np.random.default_rng(42).integers(0, 2**64, -(-(CHECK + near.bands * near.rows * near.segment) // 64), U, endpoint=False)


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, key (a hash of the text), fp, the name of its set of shingles, its cells: the SimHash
    fingerprint as in near_bits, the place in each band's grid; no words: no cells; and its parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = salts(near)
        for batch in batches:
            sets = [_set(t.as_py(), near.shingle) for t in batch.column(1)]
            cells = [near_bits(x, near, salt) if len(x) else [] for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(map(_name, sets), pa.binary()), pa.array(cells, pa.list_(pa.int64())), pa.array(map(parities, sets), pa.binary())], ["doc_id", "key", "fp", "cells", "parities"])

    return texts(docs, _key().alias("key")).mapInArrow(run, "doc_id long, key long, fp binary, cells array<long>, parities binary")


#: Columns of a row in a band: its band and bits there, the two words of its name, the check's two, those of its parities.
PLACE, NAME, BITS, ODD = 0, slice(1, 3), slice(3, 5), slice(5, 7)
WIDTH = 7


def _regions(near: Near, buckets: int):
    """The bands' rows of (fp, cells, parities), packed by buckets of regions. A region is a band with the bits
    that agree. Without parities any pair may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.slice(a, 2048)
                cells = np.array(part.column(1).flatten()).reshape(len(part), 2 + near.bands)
                rows = np.zeros((len(part), near.bands, WIDTH), np.int64)
                rows[:, :, PLACE] = cells[:, 2:] | (np.arange(near.bands) << 32)
                rows[:, :, NAME] = _words(part.column(0)).view(np.int64).reshape(-1, 1, 2)
                rows[:, :, BITS] = cells[:, None, :2]
                if part.num_columns > 2:
                    rows[:, :, ODD] = _words(part.column(2)).view(np.int64).reshape(-1, 1, 2)
                rows = rows.reshape(-1, WIDTH)
                region = (rows[:, PLACE] >> near.grid * near.segment).view(U)
                bucket = ((region * MULTIPLIER >> U(32)) % U(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                rows, bucket = rows[order], bucket[order]
                edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
                packs = [rows[i:j].tobytes() for i, j in itertools.pairwise(edge)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(packs, pa.binary())], ["bucket", "pack"])

    return run


def _grid_cells(place: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells (with the kind of step in the lowest five bits), and the rows in them: a row's own
    cell and those one step around it. Kinds are 0, then a step down in each segment, then up."""
    n, m = near.grid, near.segment
    at = (place[:, None] >> np.arange(0, n * m, m)) & ((1 << m) - 1)
    v = np.bitwise_count(at).astype(np.int64)
    scale = (m + 3) ** np.arange(n, dtype=np.int64)
    own = (place >> n * m) * (m + 3) ** n + (v + 1) @ scale
    cells, rows = [own << 5], [np.arange(len(place))]
    for i in range(n):
        for has, step, kind in ((v[:, i] > 0, -scale[i], 1 + i), (v[:, i] < m, scale[i], 1 + n + i)):
            rows.append(np.flatnonzero(has))
            cells.append((own[rows[-1]] + step) << 5 | kind)
    return np.concatenate(cells), np.concatenate(rows)


def _candidates(rows: np.ndarray, near: Near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that hold everything together whose vectors are within distance 2 in a region, whose
    check differs in near.most bits at most, and whose sets may be similar by their parities."""
    bits, odd, n = rows[:, BITS].view(U), rows[:, ODD].view(U), near.grid

    def close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        good = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= near.most
        at = np.flatnonzero(good)
        good[at] = possible(odd[x[at]], odd[y[at]], near.least)
        return good

    cell, at = _grid_cells(rows[:, PLACE], near)
    order = np.argsort(cell)
    cell, at = cell[order], at[order]
    kind, cell = cell & 31, cell >> 5
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    size = np.diff(edge)
    for a, k in zip(edge[:-1][size > SMALL_CELL].tolist(), size[size > SMALL_CELL].tolist(), strict=True):
        # Trees grow from a member at a time, so that a group of copies takes linear time.
        todo, queue = np.unique(at[a : a + k]), []
        while len(todo):
            if not queue:
                queue, todo = [todo[0]], todo[1:]
                continue
            p = queue.pop()
            good = close(np.full(len(todo), p), todo)
            if good.any():
                yield np.full(int(good.sum()), p), todo[good]
                queue.extend(todo[good])
                todo = todo[~good]
    for low, high in itertools.pairwise((1, 8, 32, SMALL_CELL)):
        some = np.repeat((size > low) & (size <= high), size)
        c, k, r = cell[some], kind[some], at[some]
        for o in range(1, high):
            i = np.flatnonzero(c[o:] == c[:-o])
            if not len(i):
                break
            x, y = k[i], k[i + o]  # x <= y
            # Own cells, one step apart, and two steps apart; rows of one vector meet in their own cell.
            i = i[(x <= n) & ((x == 0) & (y <= n) | (x > 0) & (x != y))]
            x, y = r[i], r[i + o]
            good = close(x, y)
            yield x[good], y[good]


def _components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows is joined to by the pairs (x, y)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            return label
        before = label.copy()
        np.minimum.at(label, before[x], low)
        np.minimum.at(label, before[y], low)
        label = np.minimum(label, label[label])


def _grid_groups(near: Near):
    """cell and fp of the members of each group of candidates, from packs that are sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for _, bucket in itertools.groupby(packs, key=lambda x: x[0]):
            rows = np.frombuffer(b"".join(x[1] for x in bucket), np.int64).reshape(-1, WIDTH)
            rows = rows[np.argsort(rows[:, PLACE], kind="stable")]
            region = rows[:, PLACE] >> near.grid * near.segment
            a = 0
            while a < len(rows):  # whole regions
                b = int(np.searchsorted(region, region[min(a + AT_ONCE, len(rows)) - 1], "right"))
                yield groups(rows[a:b])
                a = b

    def groups(rows: np.ndarray) -> pa.RecordBatch:
        pairs = list(_candidates(rows, near))
        x, y = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
        label = _components(len(rows), x, y)
        live = np.flatnonzero(np.isin(np.arange(len(rows)), np.concatenate([x, y])))
        live = live[np.lexsort((rows[live, 2], rows[live, 1], label[live]))]
        names = np.ascontiguousarray(rows[live, NAME])
        edge = np.flatnonzero(np.diff(label[live], prepend=-1, append=-1))
        ids = np.array([xxhash.xxh64_intdigest(names[i:j].tobytes(), 42) for i, j in itertools.pairwise(edge)], U).view(np.int64)
        offsets = np.arange(0, 16 * len(names) + 1, 16, dtype=np.int32)
        fp = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(names)])
        return pa.RecordBatch.from_arrays([fp, pa.array(np.repeat(ids, np.diff(edge)))], ["fp", "cell"])

    return run


def candidate_cells(distinct: DataFrame, near: Near) -> DataFrame:
    """fp and cell of distinct (fp, cells, and parities if they are there): a cell is what hangs together in a
    region by candidate pairs of the grid, named by its members. Every candidate pair is in some cell."""
    n = partitions(distinct.sparkSession)
    placed = distinct.filter("size(cells) > 0").select("fp", "cells", *[c for c in distinct.columns if c == "parities"])
    buckets = max(4 * n, distinct.count() * near.bands // BUCKET)
    packs = placed.mapInArrow(_regions(near, buckets), "bucket int, pack binary")
    return packs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_grid_groups(near), "fp binary, cell long").distinct()


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def shingle_sets(docs: DataFrame, near: Near) -> DataFrame:
    """fp and its set of shingles as bytes, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                sets = [_set(t.as_py(), near.shingle) for t in batch.column(1).slice(a, 512)]
                yield pa.RecordBatch.from_arrays([pa.array(map(_name, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["fp", "shingles"])

    return texts(docs).mapInArrow(run, "fp binary, shingles binary")


def _similar(names: list[bytes], sets: list[np.ndarray], least: float, forest: Forest) -> None:
    """Link the members of a cell whose sets are similar. Trees grow from a member at a time; each
    is compared with all members that are in no tree yet, so no similar pair stays apart."""
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    mark = np.zeros(int(ids.max()) + 1, bool)
    todo, flat, queue = np.arange(1, len(sets)), ids[at[1] :], [0]
    while len(todo):
        if not queue:
            queue, flat, todo = [int(todo[0])], flat[size[todo[0]] :], todo[1:]
            continue
        p = queue.pop()
        mark[ids[at[p] : at[p + 1]]] = True
        n = size[todo]
        shared = np.add.reduceat(mark[flat], np.cumsum(n) - n, dtype=np.int64)
        mark[ids[at[p] : at[p + 1]]] = False
        good = shared >= least * (n + size[p] - shared) - 1e-9
        if good.any():
            for j in todo[good].tolist():
                forest.link(names[p], names[j])
                queue.append(j)
            flat, todo = flat[np.repeat(~good, n)], todo[~good]


def _verified(near: Near, keys: int):
    """Links among rows (keys, fp, shingles) that agree in their keys and follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        rows = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, members in itertools.groupby(rows, key=lambda x: x[:keys]):
            cell = {x[-2]: x[-1] for x in members}
            if len(cell) > 1:
                _similar(list(cell), [np.frombuffer(s, U) for s in cell.values()], near.least, forest)
            if len(forest.up) > 200_000:
                yield found(forest)
                forest = Forest()
        yield found(forest)

    def found(forest: Forest) -> pa.RecordBatch:
        links = forest.links()
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return run


def similar_links(docs: DataFrame, distinct: DataFrame, near: Near, most: int = CELL) -> DataFrame:
    """Links (a, b) between names of shingle sets, that hold every component of similar sets together.
    Their cells are groups of candidates of the grid. Cells with the same members are verified once. A cell of more than `most` members is dealt to
    parts, each cell in its own way; sets of different parts are mostly held together by other cells
    then. Where a cell's members are still in several components, those outside its largest one meet
    every part of it, so no similar pair stays apart; what a task holds is bounded by twice `most`."""
    n = partitions(docs.sparkSession)
    cells = stored(candidate_cells(distinct, near))
    groups = cells.groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.sum(F.xxhash64("fp").cast("decimal(20,0)")).alias("s")).filter("n > 1")
    chosen = stored(groups.groupBy("n", "x", "s").agg(F.min("cell").alias("cell")).select("cell", F.col("n").alias("copies"), F.ceil(F.col("n") / most).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("cell", "fp"), F.col("parts")).cast("int").alias("part")
    live = stored(counted(cells, chosen, ["cell"], cells.count()).select("cell", "fp", "parts", part))
    ids = stored(distinct.join(live.select("fp").distinct(), "fp", "left_semi").select("first.*").withColumnsRenamed({"doc_id": "_id", "key": "_key"}).distinct())
    few = docs.select("doc_id", "text").hint("merge").join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (_key() == F.col("_key")), "left_semi")

    def verified(rows: DataFrame, *keys: str) -> DataFrame:
        sets = shingle_sets(few, near).dropDuplicates(["fp"])
        dealt = rows.hint("merge").join(sets, "fp").select(*keys, "fp", "shingles").repartition(n, *keys).sortWithinPartitions(*keys)
        return stored(dealt.mapInArrow(_verified(near, len(keys)), "a binary, b binary"))

    links = verified(live, "cell", "part")
    if not chosen.filter("parts > 1").head(1):
        return links
    roots = connected(links)
    large = live.filter("parts > 1").join(roots, F.col("fp") == F.col("node"), "left").select("cell", "fp", "parts", "part", F.coalesce("root", "fp").alias("root"))
    large = stored(large)
    trees = large.groupBy("cell", "root").agg(F.count("*").alias("n"))
    split = trees.groupBy("cell").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.count("*").alias("trees"), F.sum("n").alias("copies"), F.max("n").alias("most"))
    split = stored(split.filter("trees > 1").select("cell", "largest", "copies", F.ceil((F.col("copies") - F.col("most")) / most).cast("int").alias("chunks")))
    if not split.head(1):
        return links
    apart = stored(counted(large, split, ["cell"], large.count()))
    chunk = F.pmod(F.xxhash64("fp", "cell"), F.col("chunks")).cast("int")
    probes = apart.filter("root <> largest").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), chunk.alias("chunk"), "fp")
    members = apart.select("cell", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "fp")
    return links.unionByName(verified(probes.unionByName(members).distinct(), "cell", "part", "chunk"))


def kept_keys(docs: DataFrame, near: Near = NEAR) -> DataFrame:
    """_id and _key (a hash of the text) of one document of each group, the one with the smallest doc_id
    and then key. A group is what can be reached over pairs of sets whose Jaccard similarity is at
    least near.least. Documents without an id stand after the others."""
    marked = stored(sketches(docs, near))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    distinct = stored(marked.groupBy("fp").agg(F.min(place).alias("first"), F.first("cells").alias("cells"), F.first("parities").alias("parities")))
    named = _rooted(distinct.drop("cells", "parities"), similar_links(docs, distinct, near))
    one = named.groupBy("root").agg(F.min("first").alias("first"))
    return one.select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))


def deduplicated(docs: DataFrame, near: Near = NEAR) -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id. Rows that share a doc_id are
    judged by their texts: unlike ones are groups of their own and stay, of like ones the one whose
    text has the smallest hash stays, and of rows with the same doc_id and text one. Rows whose doc_id
    is null are kept as they are."""
    keep = stored(kept_keys(docs, near).filter(F.col("_id").isNotNull()))
    ided = docs.filter(F.col("doc_id").isNotNull()).withColumn("_near_id", F.col("doc_id").cast("long")).withColumn("_near_key", _key())
    chosen = ided.hint("merge").join(keep, (F.col("_near_id") == F.col("_id")) & (F.col("_near_key") == F.col("_key")), "left_semi").dropDuplicates(["_near_id", "_near_key"])
    return chosen.drop("_near_id", "_near_key").unionByName(docs.filter(F.col("doc_id").isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    digits = F.concat(*[F.substring(F.hex("fp"), i, 2) for i in range(15, 0, -2)])
    return found.select("doc_id", F.lower(digits).alias("fingerprint"), "component_id")
