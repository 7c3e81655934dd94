"""Benchmark decontamination by a distributed positional inverted index.

`index` reads the corpus once and stores, in the shared folder, a row for each shard (a block of
documents): the sorted list of token positions of each word, and where its documents lie. A test
phrase is found by taking the list of its rarest word and intersecting it with the offset-adjusted
lists of the other words, from rare to common, until it is empty or all words are met; proximity
matches are places of a phrase's first word with every other word at most so many words away in the
same document, by the same lists in the same order. As matches
never cross documents, shards are searched where they lie, without a shuffle, by each block of the
benchmark (of a bounded size) in turn; texts aren't read again.

Words that are not in the benchmark are left out of the lists if its vocabulary is small enough to be
sent to the tasks (VOCABULARY_BYTES); otherwise all words have lists.

Nulls: a null text has no words; items whose id is null are left out. Empty tables give no rows
(documents) or no hits (benchmark). Repeated rows are each answered; items that repeat an id count
as one item. Further columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclattice.llm.common import ship, stored, table, texts
from doclattice.llm.tokens import _pack, _unpack

WINDOW = 8
MIN_ITEMS = 2
SHARD_BYTES = 4 << 20
#: The driver holds, and each task gets, at most about this many bytes of benchmark at once.
BLOCK_BYTES = 8 << 20
#: Longer items are taken in pieces.
PIECE_BYTES = 1 << 20
#: Words of a benchmark up to this many bytes are sent to the tasks that make an index.
VOCABULARY_BYTES = 16 << 20
#: Found documents (16 bytes each) that are broadcast at most.
BROADCAST_DOCS = 500_000

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_key", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def words(text: str | None) -> list[bytes]:
    """Words of a text: ASCII letters lower-cased; ASCII digits, letters and all beyond ASCII."""
    return WORD.findall((text or "").encode().lower())


def windows(text: str | None, n: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words(text)
    if len(w) < n:
        return [tuple(w)] if w else []
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


class Phrases:
    """Distinct phrases of a block of items over a vocabulary of term numbers."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows(text, n):
                found.setdefault(w, set()).add(item)
        self.terms = {t: i for i, t in enumerate(sorted({t for w in found for t in w}))}
        self.words = [np.array([self.terms[t] for t in w], np.int64) for w in found]
        self.items = list(found.values())
        self.longest = max(map(len, self.words), default=1)
        # Padded with the phrase's own first word, to look up all counts at once.
        self.padded = np.array([np.pad(w, (0, self.longest - len(w)), mode="wrap") for w in self.words], np.int64).reshape(-1, self.longest)


def _built(wanted: frozenset[bytes] | None):
    """A row for each shard: its documents, and its words with their positions. A place without a word
    lies between two documents, so that no phrase reaches from one into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, docs in blocks_of(batch.column(0).to_pylist(), batch.column(1).to_pylist(), SHARD_BYTES):
                number: dict[bytes, int] = defaultdict()
                number.default_factory = number.__len__
                found = [array("i", map(number.__getitem__, words(text))) for text in docs]
                size = np.array([len(w) for w in found], "<i8")
                base = np.cumsum(size + 1) - (size + 1)
                flat = np.concatenate([np.frombuffer(w, np.int32) for w in found if len(w)] or [np.zeros(0, np.int32)])
                at = np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)
                if wanted is not None:
                    known = np.fromiter((w in wanted for w in number), bool, len(number))
                    at, flat = at[known[flat]], flat[known[flat]]
                terms, count = np.unique(flat, return_counts=True)
                listed = list(number)
                raw = [listed[t] for t in terms.tolist()]
                null = np.array([i is None for i in ids], "u1")
                own = _pack(np.array([i or 0 for i in ids], "<i8"), null, np.array([_key(x) for x in docs], "<i8"), size, base.astype("<i8"))
                lists = _pack(np.array([len(w) for w in raw], "<u4"), np.frombuffer(b"".join(raw), "u1"), count.astype("<u4"), at[np.argsort(flat, kind="stable")].astype("<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([lists], pa.binary())], ["docs", "lists"])

    return run


def index(docs: DataFrame, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """The stored index of docs; wanted: the only words that have lists."""
    return stored(texts(docs).mapInArrow(_built(wanted), "docs binary, lists binary"))


class Shard:
    """Lists of a shard's positions, for the terms of a block of phrases."""

    def __init__(self, docs: bytes, lists: bytes, phrases: Phrases):
        self.ids, self.null, self.key, self.n_words, self.base = _unpack(docs, "<i8", "u1", "<i8", "<i8", "<i8")
        size, raw, count, self.positions = _unpack(lists, "<u4", "u1", "<u4", "<u4")
        self.positions = self.positions.astype(np.int64)
        ends, raw = np.cumsum(size, dtype=np.int64).tolist(), raw.tobytes()
        first = np.cumsum(count, dtype=np.int64) - count
        self.count, self.start = np.zeros(len(phrases.terms), np.int64), np.zeros(len(phrases.terms), np.int64)
        get = phrases.terms.get
        term = np.fromiter((get(raw[a:b], -1) for a, b in zip([0, *ends], ends, strict=False)), np.int64, len(ends))
        known = term >= 0
        self.count[term[known]], self.start[term[known]] = count[known], first[known]

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.start[term] : self.start[term] + self.count[term]]

    def phrase(self, phrase: np.ndarray) -> np.ndarray:
        """Positions at which the phrase starts."""
        order = np.argsort(self.count[phrase], kind="stable")
        at = self.postings(phrase[order[0]]) - order[0]
        for k in order[1:]:
            if not len(at):
                break
            other = self.postings(phrase[k])
            i = np.searchsorted(other, at + k)
            i[i == len(other)] = 0
            at = at[other[i] == at + k]
        return at

    def near(self, phrase: np.ndarray, within: int) -> np.ndarray:
        """Positions of the phrase's first word with every other word at most `within` words away; the
        rarest word is looked for first."""
        at = self.postings(phrase[0])
        for k in np.argsort(self.count[phrase], kind="stable"):
            if not len(at):
                break
            other = self.postings(phrase[k])
            doc = np.searchsorted(self.base, at, side="right") - 1
            low, high = np.maximum(at - within, self.base[doc]), np.minimum(at + within, self.base[doc] + self.n_words[doc] - 1)
            i = np.searchsorted(other, low)
            at = at[(i < len(other)) & (other[np.minimum(i, len(other) - 1)] <= high)]
        return at


def _key(text: str) -> int:
    """As Spark's xxhash64 of the text."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _search(shard: Shard, phrases: Phrases, within: int | None) -> tuple[dict, dict]:
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    for j in np.flatnonzero((shard.count[phrases.padded] > 0).all(axis=1)) if len(phrases.words) else ():
        p = phrases.words[j]
        at = shard.phrase(p) if within is None else shard.near(p, within)
        if not len(at):
            continue
        docs = np.searchsorted(shard.base, at, side="right") - 1
        begin = at - shard.base[docs]
        for a, d in zip(begin.tolist(), docs.tolist(), strict=True):
            spans.setdefault(d, []).append((a, a + (len(p) if within is None else 1)))
            items.setdefault(d, set()).update(phrases.items[j])
    return spans, items


def blocks_of(ids: list, docs: list[str], most: int) -> Iterator[tuple[list, list[str]]]:
    i = 0
    while i < len(ids):
        j, size = i, 0
        while j < len(ids) and (j == i or size + len(docs[j]) <= most):
            size += len(docs[j])
            j += 1
        yield ids[i:j], docs[i:j]
        i = j


def _searcher(phrases: Phrases, within: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, lists in zip(*batch.columns, strict=True):
                shard = Shard(docs.as_py(), lists.as_py(), phrases)
                spans, items = _search(shard, phrases, within)
                every = range(len(shard.ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.ids, pa.int64(), mask=shard.null.astype(bool)),
                        pa.array(shard.key, pa.int64()),
                        pa.array(shard.n_words, pa.int64()),
                        pa.array([_merged(spans.get(d, [])) for d in every], pa.list_(pa.list_(pa.int64()))),
                        pa.array([sorted(items.get(d, ())) for d in every], pa.list_(pa.string())),
                    ],
                    HITS.names,
                )

    return run


def _regroup(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        spans = [_merged([tuple(s) for part in x for s in part]) for x in batch.column("spans").to_pylist()]
        items = [sorted({i for part in x for i in part}) for x in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), batch.column("n_words"), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))],
            HITS.names,
        )


def _pieces(n: int, most: int):
    """Texts of over `most` bytes in pieces, in which each of their phrases of n words lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out, w, a = [text], [], 0
                if len(text) > most or len(text.encode()) > most:
                    w = [x.decode(errors="replace") for x in words(text)]
                    ends = np.cumsum([len(x.encode()) + 1 for x in w]) if w else np.zeros(0, np.int64)
                    out = []
                    while a < len(w):
                        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")), a + 2 * n)
                        out.append(" ".join(w[a:b]))
                        a = len(w) if b >= len(w) else b - n + 1
                for i in range(0, len(out), 64):
                    part = out[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.string())], ["item", "text"])

    return run


def _items(benchmark: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Items with an id, long ones in pieces, and their bytes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).alias("text")).filter("item is not null")
    ship(benchmark.sparkSession)
    items = items.mapInArrow(_pieces(n, PIECE_BYTES), "item string, text string")
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    return items, total


def _vocabulary(items: DataFrame, total: int) -> frozenset[bytes] | None:
    """The benchmark's words, gathered from its texts, or none if they may take too many bytes."""
    if total > VOCABULARY_BYTES:
        return None
    return frozenset(w for r in items.select("text").distinct().toLocalIterator() for w in words(r.text))


def matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, within: int | None = None) -> DataFrame:
    """For each document: its number of words, the word ranges [start, end) that test phrases cover,
    and the ids of the items whose phrases occur. within: proximity matches instead of exact
    phrases; then a range is the position of the phrase's first word."""
    items, total = _items(benchmark, n)
    n_blocks = 1 + total // BLOCK_BYTES
    stored_index = index(docs, _vocabulary(items, total))
    out = None
    for b in range(n_blocks):
        block = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)
        phrases = Phrases([(r.item, r.text) for r in block.collect()], n)
        found = stored_index.mapInArrow(_searcher(phrases, within), HITS)
        out = found if out is None else out.unionByName(found)
    if n_blocks == 1:
        return out
    # A group has a row for each block and each repetition of the document; the repetitions come back.
    grouped = out.groupBy("doc_id", "text_key", "n_words").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    again = F.explode(F.array_repeat(F.lit(0), (F.size("spans") / n_blocks).cast("int"))).alias("again")
    return grouped.select("*", again).drop("again").mapInArrow(_regroup, HITS)


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """The rows of docs in which fewer than min_items items occur, with their columns."""
    found = matches(docs, benchmark, n).filter(F.size("items") >= min_items).select("doc_id", "text_key").distinct()
    found = stored(found.withColumnsRenamed({"doc_id": "_found_id", "text_key": "_found_key"}))
    if found.count() <= BROADCAST_DOCS:
        found = F.broadcast(found)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_found_id")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("_found_key"))
    return docs.join(found, same, "left_anti")


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """Digest columns for each document; contaminated: at least min_items items occur in it."""
    joined = F.array_join("items", ",")
    return matches(docs, benchmark, n).select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s[1] - s[0])").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(joined, 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark where item_id is not null),
p as (select distinct item, n, array_to_string(words[i + 1:i + n], ' ') as phrase from (select *, unnest(range(len(words) - n + 1)) as i from (select *, least(len(words), 8) as n from b where len(words) > 0))),
w as (select k, n, i, array_to_string(words[i + 1:i + n], ' ') as phrase from (select k, words, n, unnest(range(len(words) - n + 1)) as i from d, (select distinct n from p) where len(words) >= n)),
m as (select k, i, w.n, item from w join p on w.n = p.n and w.phrase = p.phrase),
h as (select k, count(*) as n_hit from (select distinct k, unnest(range(i, i + n)) as j from m) group by k),
t as (select k, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct k, item from m) group by k)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join h using (k) left join t using (k)
"""
