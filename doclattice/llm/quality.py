"""Quality rules with adaptive thresholds; DataFrame functions only.

Each document gets counts from its whole text. Four ratios of them are integers (per 1000), and a
mergeable quantile sketch of each ratio is kept for each language and source: a histogram with
log-linear buckets (the seven highest bits of a value stay, so quantiles are exact within 1/64).
Sketches merge by adding counts, need no order and come out the same in any run.

The sketch that judges a group is its own blended with that of its language, which weighs as much as
PRIOR documents: a small group follows its language, a large one itself, with no switch between. Its
quartiles alone make the fences: a document is rejected where a ratio's bucket lies over
q50 + WIDTH * (q75 - q50) or, for ratios that are bad on both sides, under q50 - WIDTH * (q50 - q25).
Where q75 (or q25) is q50, the group is too uniform for a threshold on that side and has none.

Nulls: a null text has no words and fails; null languages and sources count as empty strings. Only
documents that pass the fixed base rule are in the sketches. Repeated rows count each; empty tables
give no rows; further columns are kept by `filtered` and ignored by `verdicts`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclattice.llm.common import stored, table

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Characters of a short word, what the language's sketch weighs in documents, and the fences' width.
SHORT = 3
PRIOR = 100
WIDTH = 8
#: ratio, its counts (per 1000), whether low values are also bad
RATIOS = (
    ("chars_per_word", "word_chars", "n_words", True),
    ("short_words", "n_short", "n_words", True),
    ("symbols_per_word", "n_symbols", "n_words", False),
    ("dup_lines", "n_dup_lines", "n_lines", False),
)
#: Groups of language and source whose thresholds are broadcast at most (some 200 bytes each), and
#: the parts into which larger tables of thresholds are dealt for each group.
BROADCAST_GROUPS = 100_000
SALTS = 32


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column, width: int) -> Column:
    """Number of words in windows that occur twice or more."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda k, j: F.coalesce(F.get(s, j)["h"] == F.get(s, k)["h"], F.lit(False))
        at = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get(s, k)["i"]))
        return F.array_sort(F.filter(at, lambda i: i.isNotNull()))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, i: F.struct((i + width).alias("end"), (a["n"] + i + width - F.greatest(i, a["end"])).alias("n"))
    return F.aggregate(_let(ordered, repeated), start, step, lambda a: a["n"])


def _repeat_words(words: Column, width: int = 5) -> Column:
    def count(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        distinct = lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), _covered(x, width)).otherwise(F.lit(0).cast("long"))
        return F.when(F.size(h) > width, _let(windows, distinct)).otherwise(F.lit(0).cast("long"))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), count)


def counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_short, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    measures = _let(
        words,
        lambda w: _let(
            lines,
            lambda ls: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.size(F.filter(w, lambda x: F.length(x) <= SHORT)).cast("long").alias("n_short"),
                F.size(ls).cast("long").alias("n_lines"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
            ),
        ),
    )
    n = F.col("m.n_words")
    return docs.withColumn("m", measures).select(
        *[c for c in docs.columns],
        n.alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col("m.n_short").alias("n_short"),
        F.col("m.n_lines").alias("n_lines"),
        F.col("m.n_dup_lines").alias("n_dup_lines"),
        F.col("m.n_repeat_words").alias("n_repeat_words"),
        ((n < 10) | (100 * F.col("m.n_repeat_words") > 20 * n)).alias("base_failed"),
    )


def _ratios() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(F.lit(0)).cast("long")
    return {k: per(a, b) for k, a, b, _ in RATIOS}


def _bucket(v: Column) -> Column:
    """The value with all but its seven highest bits cleared."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return v - F.pmod(v, F.pow(F.lit(2), shift).cast("long"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, bucket, n): additive, so that sketches of parts are merged by summing n."""
    ratios = _ratios()
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), _bucket(v).alias("bucket")) for k, v in ratios.items()])).alias("r")
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", named).select("lang", "source", "r.ratio", "r.bucket")
    return rows.groupBy("lang", "source", "ratio", "bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """A row for each language and source: low_<ratio> and high_<ratio>, null where there is none."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    lang = sketch.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n_lang"))
    total = lang.groupBy("lang", "ratio").agg(F.sum("n_lang").alias("all_lang"))
    groups = sketch.select("lang", "source", "ratio").distinct()
    every = groups.join(lang, ["lang", "ratio"]).join(total, ["lang", "ratio"]).join(sketch, ["lang", "source", "ratio", "bucket"], "left")
    n = F.coalesce(big("n"), F.lit(0)) * big("all_lang") + PRIOR * big("n_lang")
    group = Window.partitionBy("lang", "source", "ratio")
    up = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = every.withColumn("n", n.cast("decimal(38,0)")).withColumn("cum", F.sum("n").over(up)).withColumn("total", F.sum("n").over(group))
    q = [F.min(F.when(F.col("cum") * 4 >= F.col("total") * k, F.col("bucket"))).alias(f"q{25 * k}") for k in (1, 2, 3)]
    quartiles = ranked.groupBy("lang", "source", "ratio").agg(*q)
    sides = []
    for k, _, _, low in RATIOS:
        mine = F.col("ratio") == k
        sides.append(F.max(F.when(mine & F.lit(low) & (F.col("q25") < F.col("q50")), F.col("q50") - WIDTH * (F.col("q50") - F.col("q25")))).alias(f"low_{k}"))
        sides.append(F.max(F.when(mine & (F.col("q75") > F.col("q50")), F.col("q50") + WIDTH * (F.col("q75") - F.col("q50")))).alias(f"high_{k}"))
    return quartiles.groupBy("lang", "source").agg(*sides)


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """measured (with lang and source that aren't null) and kept. The thresholds are broadcast if they
    are few; else the rows of a group are dealt to SALTS parts, so that none gets a hot source whole."""
    limits = stored(limits).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source"))
    if limits.count() <= BROADCAST_GROUPS:
        joined = measured.join(F.broadcast(limits), same, "left")
    else:
        salted = limits.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = measured.withColumn("_salt", F.pmod(F.xxhash64(*MEASURES), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, same & (F.col("_salt") == F.col("_part")), "left")
    within = []
    for k, v in _ratios().items():
        within += [F.coalesce(_bucket(v) >= F.col(f"low_{k}"), F.lit(True)), F.coalesce(_bucket(v) <= F.col(f"high_{k}"), F.lit(True))]
    return joined.withColumn("kept", ~F.col("base_failed") & reduce(lambda a, b: a & b, within))


def _plain(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select("doc_id", "text", empty("lang"), empty("source"))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def verdicts(docs: DataFrame) -> DataFrame:
    """For each document: its counts, base_failed and kept."""
    measured = stored(counts(_plain(docs)).drop("text"))
    return _judged(measured, thresholds(sketches(measured))).select(F.col("doc_id").cast("long").alias("doc_id"), *MEASURES, "base_failed", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    names = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    empty = lambda c: F.coalesce(F.col(names[c]).cast("string"), F.lit("")) if c in names else F.lit("")
    measured = counts(renamed.withColumn("text", F.col(names["text"])).withColumn("lang", empty("lang")).withColumn("source", empty("source"))).drop("text")
    measured = stored(measured)
    kept = _judged(measured, thresholds(sketches(measured))).filter("kept")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


_RATIO_SQL = ", ".join(f"case when {b} > 0 then {a} * 1000 // {b} else 0 end as {k}" for k, a, b, _ in RATIOS)
_BUCKET_SQL = "{0} - {0} % (1::bigint << greatest(length(bin({0})) - 7, 0))"
_FENCE_SQL = ", ".join(
    f"max(case when ratio = '{k}' and {str(low).lower()} and q25 < q50 then q50 - {WIDTH} * (q50 - q25) end) as low_{k}, max(case when ratio = '{k}' and q75 > q50 then q50 + {WIDTH} * (q75 - q50) end) as high_{k}"
    for k, _, _, low in RATIOS
)
ORACLE_SQL = rf"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
win as (select k, i, array_to_string(words[i:i + 4], ' ') as win from (select k, words, unnest(range(1, len(words) - 3)) as i from w)),
rep as (select k, count(distinct j) as n from (select k, unnest(range(i, i + 5)) as j from (select k, i, count(*) over (partition by k, win) as c from win) where c > 1) group by k),
m as (select w.k, doc_id, lang, source, cast(len(words) as bigint) as n_words,
  cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(len(list_filter(words, lambda x: length(x) <= {SHORT})) as bigint) as n_short,
  cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from w left join rep using (k)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {_RATIO_SQL} from m),
v as (select lang, source, unnest([{", ".join(f"'{k}'" for k, *_ in RATIOS)}]) as ratio, unnest([{", ".join(k for k, *_ in RATIOS)}]) as v from b where not base_failed),
sketch as (select lang, source, ratio, {_BUCKET_SQL.format("v")} as bucket, count(*)::hugeint as n from v group by all),
whole as (select lang, ratio, bucket, n_lang, sum(n_lang) over (partition by lang, ratio)::hugeint as all_lang from (select lang, ratio, bucket, sum(n)::hugeint as n_lang from sketch group by all)),
blend as (select g.lang, g.source, g.ratio, whole.bucket, coalesce(s.n, 0) * all_lang + {PRIOR} * n_lang as n from (select distinct lang, source, ratio from sketch) g
  join whole using (lang, ratio) left join sketch s on s.lang = g.lang and s.source = g.source and s.ratio = g.ratio and s.bucket = whole.bucket),
ranked as (select *, sum(n) over (partition by lang, source, ratio order by bucket rows unbounded preceding) as cum, sum(n) over (partition by lang, source, ratio) as total from blend),
q as (select lang, source, ratio, min(case when cum * 4 >= total then bucket end) as q25, min(case when cum * 4 >= total * 2 then bucket end) as q50,
  min(case when cum * 4 >= total * 3 then bucket end) as q75 from ranked group by all),
t as (select lang, source, {_FENCE_SQL} from q group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {" and ".join(f"coalesce({_BUCKET_SQL.format(k)} >= low_{k}, true) and coalesce({_BUCKET_SQL.format(k)} <= high_{k}, true)" for k, *_ in RATIOS)} as kept
from b left join t using (lang, source)
"""
