"""Secret scans: fixed patterns, and Shannon entropy over sliding windows of candidate strings.

DataFrame functions only. Base kinds come from patterns; their spans always stay. The entropy kinds
look at candidate strings (runs of a character class). A window of WINDOW characters slides over
each; the counts of its characters, and the sum of count * log2(count) that entropy follows from,
are changed by the character that enters and the one that leaves. The sum is kept in fixed point,
so that results don't depend on rounding. Where windows of a candidate reach the class's threshold,
the span from the first to the last such window is reported, unless it lies inside a base span. What
the allow list matches is no part of any candidate. The thresholds let 95 of 100 windows of random hex digits, or random
base64, pass; candidates have a digit and a letter.

Nulls: a null text is empty. Spans are in code points, ends exclusive. Repeated rows are each
answered, empty tables give no rows, further columns are not read. Only texts with a match are
taken apart, so the cost of a text without one is that of four pattern searches.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.common import table

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Matches of these two are maximal runs, so asking for the least length in the pattern gives the
#: same as dropping short matches.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
BLOCK = 256
#: kind, pattern, group that is measured, least length; a search that is true if any match can pass
BASE = (("assign", ASSIGN, 1, 12, ASSIGN), ("access", ACCESS, 0, 18, ACCESS), ("hex", HEX, 0, 16, HEX))

WINDOW = 16
SCALE = 1 << 20
#: kind, characters, bits of entropy from which a window counts
CLASSES = (("entropy_hex", "0123456789abcdefABCDEF", 2.85), ("entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 3.5))
#: What is known not to be secret, in either case: sequences of the alphabet or of digits, and samples.
ALLOW = ("abcdefghij", "klmnopqrst", "0123456789", "1234567890", "example", "xxxxxxxx", "lorem")


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint,value:string>>)")


def _located(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Every match whose group has at least `least` characters, leftmost first and not overlapping.
    What lies between matches gives the places; they are added up in blocks of BLOCK matches, so that
    texts with very many matches take little more than linear time."""
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    zipped = F.arrays_zip(between.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), _no_spans().alias("spans"))

    def step(a: Column, m: Column) -> Column:
        begin = a["at"] + m["gap"]
        end = begin + F.coalesce(F.length(m["all"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(m["value"]) >= least, F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    def moved(p: Column, by: Column) -> Column:
        return F.transform(p["spans"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    def joined(parts: Column) -> Column:
        none = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("starts"))
        starts = F.aggregate(parts, none, lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
        return F.flatten(F.zip_with(parts, starts, moved))

    def in_blocks(found: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
        return _let(F.transform(blocks, lambda k: F.aggregate(F.slice(found, k * BLOCK + 1, BLOCK), start, step)), joined)

    return _let(zipped, in_blocks)


def _matches(text: Column, kind: str, pattern: str, group: int, least: int, search: str) -> Column:
    return F.when(text.rlike(search), _located(text, pattern, kind, group, least)).otherwise(_no_spans())


def _entropy_span(candidate: Column, alphabet: str, bits: float) -> Column:
    """(first, last) start of the windows that reach the threshold, -1 where none does."""
    weight = F.array(*[F.lit(round(c * math.log2(c) * SCALE) if c else 0) for c in range(WINDOW + 2)])
    most = math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE)
    code = lambda i: F.instr(F.lit(alphabet), F.substr(candidate, i + 1, F.lit(1))) - 1
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def moved(n: Column, c: Column, by: int) -> Column:
        return F.transform(n, lambda x, j: F.when(j == c, x + by).otherwise(x))

    def change(n: Column, c: Column, by: int) -> Column:
        return F.get(weight, F.get(n, c) + by) - F.get(weight, F.get(n, c))

    def step(a: Column, i: Column) -> Column:
        leaving = code(i - WINDOW)
        left = F.when(i >= WINDOW, F.struct(moved(a["n"], leaving, -1).alias("n"), (a["sum"] + change(a["n"], leaving, -1)).alias("sum"))).otherwise(F.struct(a["n"].alias("n"), a["sum"].alias("sum")))

        def enter(b: Column) -> Column:
            total = b["sum"] + change(b["n"], code(i), 1)
            hit = (i >= WINDOW - 1) & (total <= most)
            at = i - (WINDOW - 1)
            return F.struct(
                moved(b["n"], code(i), 1).alias("n"), total.cast("long").alias("sum"),
                F.when(hit & (a["first"] < 0), at).otherwise(a["first"]).alias("first"), F.when(hit, at).otherwise(a["last"]).alias("last"),
            )

        return _let(left, enter)

    return F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), zero, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _entropy(text: Column, kind: str, alphabet: str, bits: float) -> Column:
    run = "[" + alphabet.replace("-", "\\-") + "]{%d,}" % WINDOW
    candidates = F.filter(_located(text, run, kind), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))

    def judged(s: Column) -> Column:
        value = lambda e: F.substr(s["value"], e["first"] + 1, e["last"] - e["first"] + WINDOW)
        return _let(
            _entropy_span(s["value"], alphabet, bits),
            lambda e: F.when(e["first"] >= 0, F.struct(s["kind"].alias("kind"), (s["start"] + e["first"]).alias("start"), (s["start"] + e["last"] + WINDOW).alias("end"), value(e).alias("value"))),
        )

    return F.when(text.rlike(run), F.filter(F.transform(candidates, judged), lambda s: s.isNotNull())).otherwise(_no_spans())


def _more(text: Column) -> Column:
    """Spans of the entropy kinds, with what the allow list matches taken out of the text once."""
    run = "[" + "".join(sorted({c for _, letters, _ in CLASSES for c in letters} - {"-"})) + "-]{%d,}" % WINDOW
    open_text = reduce(lambda t, a: F.regexp_replace(t, "(?i)" + a, " " * len(a)), ALLOW, text)
    return F.when(text.rlike(run), _let(open_text, lambda t: F.concat(*[_entropy(t, *c) for c in CLASSES]))).otherwise(_no_spans())


def _listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then by the order of kinds."""
    order = F.array(*map(F.lit, kinds))
    keyed = F.transform(spans, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("k"), s["end"], s["kind"]))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base and extra: arrays of (kind, start, end, value)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = F.concat(*[_matches(text, *b) for b in BASE])
    more = _more(text)
    once = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _let(base, lambda b: F.struct(b.alias("base"), more.alias("more"))).alias("s"))
    outside = F.filter("s.more", lambda m: ~F.exists("s.base", lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    return once.select("doc_id", F.col("s.base").alias("base"), outside.alias("extra"))


def report(docs: DataFrame) -> DataFrame:
    """Digest columns for each document."""
    kinds = [b[0] for b in BASE]
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = _listed(F.concat("base", "extra"), kinds + [c[0] for c in CLASSES])
    return found(docs).select("doc_id", *map(n, kinds), F.sha2(_listed(F.col("base"), kinds), 256).alias("base_sha256"), every.alias("spans"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7_secret_scan that its patterns decide, for comparison with SQL."""
    return report(table(spark, sf_dir, "documents")).drop("spans")


_ASSIGN_SQL = ASSIGN.replace("'", "''")
BASE_SQL = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
m as (select k, 0 as ord, 'assign' as kind, 12 as least, string_split_regex(text, '{_ASSIGN_SQL}') as gaps, regexp_extract_all(text, '{_ASSIGN_SQL}') as found, regexp_extract_all(text, '{_ASSIGN_SQL}', 1) as value from d
  union all select k, 1, 'access', 18, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') from d
  union all select k, 2, 'hex', 16, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') from d),
s as (select k, ord, kind, least, unnest(found) as v, unnest(value) as value, unnest(range(len(found))) as i, gaps, found from m),
b as (select k, ord, kind, v, cast(list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i], lambda x: length(x))), 0) as bigint) as start from s where length(value) >= least),
g as (select k, {", ".join(f"count(*) filter (kind = '{x[0]}') as n_{x[0]}" for x in BASE)}, string_agg(kind || ':' || start || ':' || (start + length(v)), ',' order by start, ord) as listed from b group by k)
select doc_id, {", ".join(f"coalesce(n_{x[0]}, 0) as n_{x[0]}" for x in BASE)}, sha256(coalesce(listed, '')) as base_sha256 from d left join g using (k)
"""
