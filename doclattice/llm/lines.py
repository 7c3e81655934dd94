"""Line dedup: runs of lines that occurred before are deleted.

The corpus is a sequence of line ids for each document; lines without a word are left out of it (and
stay in the text). Suffixes get ranks by distributed prefix doubling: the rank at depth 2d is that of
the pair of ranks, at depth d, of the suffix and of the suffix d lines on. Suffixes whose rank is
theirs alone are dropped before each step, so what is left at a depth are the intervals of the suffix
array whose longest common prefix reaches that depth, each with its first place. Depths between two
powers of two come from two ranks that overlap.

Every place of an interval but the first is a later copy of so many lines. A copy counts from
MIN_LINES lines on, or with fewer if they have MIN_WORDS words. Later copies that overlap or touch
make up the maximal runs, which are deleted whole. Doubling ends at MIN_LINES: a longer common prefix
is covered by its windows of MIN_LINES lines, all of which are in intervals of that depth, so greater
depths would delete nothing more. "Before" is by doc_id, then by place.

Nulls: a null text is empty; a null doc_id comes after all others. Repeated rows (same doc_id and
text) are one document with several copies, all treated alike. Empty tables give no rows.
`deduplicated` keeps further columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclattice.llm.common import counted, ship, stored, table, tidy

MIN_LINES = 4
MIN_WORDS = 50
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\r\v\f"
LAST = (1 << 63) - 1
PLACE = ["doc", "h", "at"]


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(_text()).alias("h")]


def _has_word(line: Column) -> Column:
    return F.translate(line, BLANKS, "") != ""


def _least(words: np.ndarray) -> np.ndarray:
    """For each line of a text, the fewest lines from there on that count; none: MIN_LINES."""
    out = np.full(len(words), MIN_LINES, np.int32)
    total = np.concatenate([[0], np.cumsum(words)])
    for n in range(MIN_LINES - 1, 0, -1):
        if len(words) >= n:
            enough = total[n:] - total[:-n] >= MIN_WORDS
            out[: len(enough)][enough] = n
    return out


def suffixes(docs: DataFrame) -> DataFrame:
    """doc, h, at, the line's id (a, b) and n, the fewest lines from here on that count."""

    def rows(doc: int, h: int, text: str) -> tuple[np.ndarray, ...] | None:
        found = [(x, n) for x in text.encode().split(b"\n") if (n := len(x.split()))]  # bytes split at the six blanks
        if not found:
            return None
        ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x, _ in found]), np.int64).reshape(-1, 2)
        k = len(found)
        return np.full(k, doc), np.full(k, h), np.arange(k, dtype=np.int32), ids[:, 0], ids[:, 1], _least(np.array([n for _, n in found]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                got = [r for x in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True) if (r := rows(*x)) is not None]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got, strict=True)], [*PLACE, "a", "b", "n"])

    ship(docs.sparkSession)
    return docs.select(*_keys(), _text().alias("text")).mapInArrow(tidy(run), "doc long, h long, at int, a long, b long, n int")


def _ranked(df: DataFrame, once: bool = True) -> DataFrame:
    """Of those rows whose prefix, told by (a, b), occurs at more than one place: place, n, rank (in the
    order of a and b) and later, whether another place comes before. once: no place comes twice."""
    df = stored(df)
    groups = df.groupBy("a", "b").agg(F.min(F.struct(*PLACE)).alias("first"), F.max(F.struct(*PLACE)).alias("last"), F.count("*").alias("copies"))
    repeated = stored(groups.filter("first <> last").drop("last"))
    ranks = stored(repeated.orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()))
    later = (F.col("first") != F.struct(*PLACE)).alias("later")
    live = counted(df, ranks, ["a", "b"], df.count()).select(*PLACE, "n", "rank", later)
    return stored(live if once else live.dropDuplicates(PLACE))


def _follows(live: DataFrame, ahead: int) -> DataFrame:
    """live with the rank `ahead` lines on. If the lines between are repeated together, so is each of
    their places, and the wanted one is so many rows on."""
    w = Window.partitionBy("doc", "h").orderBy("at")
    found = live.withColumn("next", F.lead("rank", ahead).over(w)).withColumn("there", F.lead("at", ahead).over(w))
    return found.filter(F.col("there") == F.col("at") + ahead).select(*PLACE, "n", F.col("rank").alias("a"), F.col("next").alias("b"))


def later_copies(docs: DataFrame) -> DataFrame:
    """doc, h and the ranges [at, end) of lines that are later copies and count; they may overlap."""
    level = _ranked(suffixes(docs), once=False)
    depth, found = 1, []

    def copies(live: DataFrame, lines: int) -> None:
        counts = F.lit(True) if lines >= MIN_LINES else F.col("n") <= lines
        found.append(live.filter(F.col("later") & counts).select("doc", "h", "at", (F.col("at") + lines).alias("end")))

    copies(level, depth)
    while depth < MIN_LINES:
        for lines in range(depth + 1, min(2 * depth, MIN_LINES) + 1):
            live = _ranked(_follows(level, lines - depth))
            copies(live, lines)
        level, depth = live, lines
    return reduce(DataFrame.unionByName, found)


def later_runs(docs: DataFrame) -> DataFrame:
    """doc, h and runs: the maximal runs [at, end) of its lines that are later copies."""
    w = Window.partitionBy("doc", "h").orderBy("at")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("at") <= F.col("reach"), 0).otherwise(1)
    marked = later_copies(docs).withColumn("reach", reach).withColumn("run", F.sum(new).over(w))
    runs = marked.groupBy("doc", "h", "run").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    return runs.groupBy("doc", "h").agg(F.collect_list(F.struct("at", "end")).alias("runs"))


def _without(runs: Column) -> Column:
    """The text less the lines of runs."""

    def kept(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull())
        gone = _let(places, lambda p: F.flatten(F.transform(runs, lambda r: F.slice(p, r["at"] + 1, r["end"] - r["at"]))))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return F.when(runs.isNull(), _text()).otherwise(_let(F.split(_text(), "\n"), kept))


def _with_runs(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its columns under new names, beside text, doc_id and runs; and the new names."""
    names = [f"_own_{i}" for i in range(len(docs.columns))]
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], "doc_id", "text")
    return renamed.select("*", *_keys()).join(later_runs(docs), ["doc", "h"], "left"), names


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the later copies deleted from text (a null text stays null)."""
    joined, names = _with_runs(docs)
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(_without(F.col("runs")))
    return joined.select(*[(text if c == "text" else F.col(n)).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines with a word, n_removed, n_runs and kept_sha256 of each document."""
    joined, _ = _with_runs(docs.select("doc_id", "text"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["at"])
    return joined.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size(F.filter(F.split(_text(), "\n"), _has_word)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.sha2(_without(F.col("runs")).cast("binary"), 256).alias("kept_sha256"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _windows_sql(lines: int) -> str:
    line = ["line"] + [f"l{k}" for k in range(2, lines + 1)]
    words = " + ".join(["w"] + [f"w{k}" for k in range(2, lines + 1)])
    counts = "true" if lines >= MIN_LINES else f"{words} >= {MIN_WORDS}"
    return f"select doc_id, seq, {lines} as n, concat_ws(chr(10), {', '.join(line)}) as run from n where {line[-1]} is not null and {counts}"


_LEADS = ", ".join(f"lead(line, {k - 1}) over d as l{k}, lead(w, {k - 1}) over d as w{k}" for k in range(2, MIN_LINES + 1))
#: Windows of 1 to MIN_LINES lines that count; each but the first of its kind is a later copy.
ORACLE_SQL = rf"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
s as (select *, row_number() over (partition by doc_id order by pos) as seq, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as w
  from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
n as (select *, {_LEADS} from s window d as (partition by doc_id order by pos)),
c as ({" union all ".join(map(_windows_sql, range(1, MIN_LINES + 1)))}),
r as (select doc_id, seq, n from (select *, row_number() over (partition by n, run order by doc_id, seq) as k from c) where k > 1),
g as (select distinct doc_id, unnest(range(seq, seq + n)) as seq from r),
t as (select l.doc_id, l.pos, l.line, s.seq, g.seq is not null as gone from l left join s using (doc_id, pos) left join g on g.doc_id = s.doc_id and g.seq = s.seq),
i as (select doc_id, count(*) as n_runs from (select doc_id, seq - row_number() over (partition by doc_id order by seq) as island from g group by doc_id, seq) group by doc_id, island),
k as (select doc_id, count(*) as n_runs from i group by doc_id)
select doc_id, count(seq) as n_lines, count(*) filter (gone) as n_removed, coalesce(max(k.n_runs), 0) as n_runs,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from t left join k using (doc_id) group by doc_id
"""
