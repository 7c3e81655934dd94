"""The engine on small collections."""

import random

import pytest
from pyspark.sql import functions as F

from doclattice import BadRequest, DocIdError, Engine, EngineError, SchemaConflict, ValidationError
from doclattice.functions.kinds import kind_of
from doclattice.functions.text import byte_prefix
from doclattice.operators.predicates import condition
from doclattice.plans.nodes import Always, Among, Compare, Every, Not
from doclattice.sources.shapes import fold, shape

# -- two-valued logic against a plain interpreter ------------------------------------------------

FIELDS = {"i": ("bigint", [None, -1, 0, 3, 7, 2**53, 2**53 + 1, 2**63 - 1, -(2**63)]), "f": ("double", [None, -1.5, 0.0, 3.0, 3.5, 2.0**53]), "s": ("string", [None, "", "a", "é", "z"]), "b": ("boolean", [None, True, False])}
CONSTANTS = [-1, 0, 3, 3.5, 2.5, 2**53, 2**53 + 1, 2**63, -(2**63) - 1, 2**70, "a", "é", "", True, False, 1e300]
COMPARE = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}


def atom(op, left, right):
    number = {"integer", "float"}
    if left is None or kind_of(left) != kind_of(right) and not {kind_of(left), kind_of(right)} <= number:
        return False
    return (op == "eq" or kind_of(left) != "boolean") and COMPARE[op](left, right)


def holds(p, row):
    if isinstance(p, Always):
        return True
    if isinstance(p, Not):
        return not holds(p.of, row)
    if isinstance(p, Compare):
        return atom(p.op, row.get(p.path[1:]), p.value)
    if isinstance(p, Among):
        return any(atom("eq", row.get(p.path[1:]), v) for v in p.values)
    return (all if isinstance(p, Every) else any)(holds(x, row) for x in p.of)


def any_predicate(r, depth=3):
    kind = r.choice(["not", "every", "some", "in", "cmp", "cmp", "cmp", "always"] if depth else ["cmp", "in"])
    path = "." + r.choice([*FIELDS, "nope"])
    if kind == "cmp":
        return Compare(r.choice(list(COMPARE)), path, r.choice(CONSTANTS))
    if kind == "in":
        return Among(path, tuple(r.choices(CONSTANTS, k=r.randint(1, 4))))
    if kind == "not":
        return Not(any_predicate(r, depth - 1))
    if kind == "always":
        return Always()
    from doclattice.plans.nodes import Some

    return (Every if kind == "every" else Some)(tuple(any_predicate(r, depth - 1) for _ in range(r.randint(2, 3))))


def test_predicates_against_interpreter(spark):
    r = random.Random(11)
    rows = [{"n": i} | {k: r.choice(v) for k, (_, v) in FIELDS.items()} for i in range(120)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "n int, " + ", ".join(f"{k} {t}" for k, (t, _) in FIELDS.items()))
    kinds = {"i": "integer", "f": "float", "s": "string", "b": "boolean"}
    resolve = lambda p: (F.col(p[1:]), kinds[p[1:]]) if p[1:] in kinds else None
    ps = [any_predicate(r) for _ in range(150)]
    got = df.select("n", *[F.coalesce(condition(p, resolve), F.lit(False)).alias(f"p{i}") for i, p in enumerate(ps)]).orderBy("n").collect()
    for i, p in enumerate(ps):
        assert [g[f"p{i}"] for g in got] == [holds(p, x) for x in rows], p


# -- schema --------------------------------------------------------------------------------------


def test_validation_sequence(spark):
    e = Engine(spark)
    e.create_collection("shop", "things")
    e.create_index("shop", "things", "ix_one", [".foo"])
    e.create_index("shop", "things", "ix_pair", [(".foo", None), (".bar.baz", 0)])
    docs = ["137", '{"foo": 137}', '{"foo": "bar"}', '{"bar": {"baz": "plum"}}', '{"foo": 137, "bar": {"baz": 12.3}}', '{"foo": 138, "bar": {"baq": 12.3}}', '{"foo": 139, "bar": {"baz": "PLUM", "baq": 12.3}}', '{"bar": {"baw": {"foo": true}}}']
    out = e.insert("shop", "things", docs)
    assert [r.place for r in out.rejected.orderBy("place").collect()] == [0, 2, 4]
    assert {r.path: r.kind for r in e.fields("shop", "things").collect()} == {".foo": "integer", ".bar.baz": "string", ".bar.baq": "float", ".bar.baw.foo": "boolean"}
    coll = e.catalog.collection("shop", "things")
    affected = [coll.affected(shape(s).leaves) for s in ("OBJECT<foo: BIGINT>", "OBJECT<bar: OBJECT<baz: STRING>>", "OBJECT<bar: OBJECT<baw: OBJECT<foo: BOOLEAN>>>")]
    assert affected == [{"ix_one", "ix_pair"}, {"ix_pair"}, set()]
    with pytest.raises(ValidationError, match="holds integer values"):
        e.insert("shop", "things", ['{"foo": "x"}'], strict=True)


def test_rejected_documents_add_no_fields(spark):
    e = Engine(spark)
    e.create_collection("d", "c")
    e.insert("d", "c", ['{"a": 1}', '{"a": "x", "b": 1}', '{"b": "s"}', '{"a": {"b": 2}}', '{"A": 1.5, "x-y": {}}', '{"a": 1, "a": 2}'])
    assert {r.path: r.kind for r in e.fields("d", "c").collect()} == {".a": "integer", ".b": "string", ".a.b": "integer", ".A": "float"}
    assert e.query("d", "c", "(scan (eq .a.b 2))").count() == 1
    assert e.query("d", "c", "(scan (not (eq .a 1)))").count() == 3
    e.insert("d", "c", ['{"late": true}'])
    assert e.query("d", "c", "(scan (eq .late true))").count() == 1
    assert e.query("d", "c", "(scan (not (eq .late true)))").count() == 4


def test_fold_is_row_by_row():
    shapes = [shape(s) for s in ("OBJECT<a: DECIMAL(1,0)>", "OBJECT<a: BIGINT>", "BIGINT", "OBJECT<a: DOUBLE, `b``c`: STRING>", "OBJECT<a: OBJECT<>>", "OBJECT<a: DECIMAL(19,0)>", None, "OBJECT<v: ARRAY<OBJECT<x: VOID>>, w: VOID>")]
    verdicts, fields = fold(shapes, {})
    assert fields == {".a": "float"}
    assert [v.error is None for v in verdicts] == [True, False, False, False, True, False, False, False]


# -- reading -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark):
    e = Engine(spark)
    e.create_collection("d", "c")
    r = random.Random(3)
    docs = [{k: v for k, v in (("n", r.randint(0, 6)), ("s", r.choice(["apple", "apricot", "äpfel", "bean", "be"])), ("o", {"t": r.random() < 0.5})) if r.random() < 0.85} for _ in range(200)]
    e.insert("d", "c", docs[:120])
    e.create_index("d", "c", "ix", [".n", ".s"])
    e.create_index("d", "c", "ip", [(".s", 2), ".n"])
    e.create_index("d", "c", "ib", [".o.t"])
    e.insert("d", "c", docs[120:])
    return e, docs


@pytest.mark.parametrize("index", ["ix", "ip"])
@pytest.mark.parametrize("op", ["eq", "gt", "ge", "lt", "le", "interval", "right-interval", "left-interval", "open-interval"])
def test_index_ranges(stored, op, index):
    e, docs = stored
    low, high = ((2, "apple"), (4, "be")) if index == "ix" else (("apple", 2), ("be", 4))
    keys = [(d["n"], d["s"]) if index == "ix" else (d["s"], d["n"]) for d in docs if "n" in d and "s" in d]
    enc = lambda k: tuple(x.encode() if isinstance(x, str) else x for x in k)
    tests = {"eq": lambda k, a, b: k == a, "gt": lambda k, a, b: k > a, "ge": lambda k, a, b: k >= a, "lt": lambda k, a, b: k < a, "le": lambda k, a, b: k <= a, "interval": lambda k, a, b: a <= k <= b, "right-interval": lambda k, a, b: a <= k < b, "left-interval": lambda k, a, b: a < k <= b, "open-interval": lambda k, a, b: a < k < b}
    expected = sum(tests[op](enc(k), enc(low), enc(high)) for k in keys)
    text = lambda k: "(" + " ".join(f'"{x}"' if isinstance(x, str) else str(x) for x in k) + ")"
    plan = f"(ixscan ({op} {index} {text(low)}{' ' + text(high) if 'interval' in op else ''}))"
    assert e.query("d", "c", plan).count() == e.query("d", "c", plan, tables=True).count() == expected > 0


def test_ids_limit_get(stored):
    e, docs = stored
    first = e.query("d", "c", "(scan ())", limit=5).collect()
    assert [r.document for r in first] == [r.document for r in e.query("d", "c", "(scan ())", limit=3).collect()] + [r.document for r in first[3:]]
    assert e.query("d", "c", "(scan ())", limit=0).count() == 0
    assert e.query("d", "c", "(scan ())").select("__id").distinct().count() == len(docs)
    assert e.get("d", "c", first[2]["__id"]).first().document == first[2].document
    assert e.get("d", "c", "0" * 32).count() == 0 == e.get("d", "unknown", "0" * 32).count()
    with pytest.raises(DocIdError):
        e.get("d", "c", "x")
    assert e.query("d", "c", "(ixscan (ge ib (false)))").count() == sum("o" in d for d in docs)
    assert e.query("d", "c", "(scan (ge .o.t false))").count() == 0


def test_union_keeps_duplicates(stored):
    e, docs = stored
    n = sum(d.get("n") == 3 for d in docs)
    assert e.query("d", "c", "(union (scan (eq .n 3)) (union (scan (eq .n 3)) (scan (lt .n 0))))").count() == 2 * n
    assert e.query("d", "c", "(filter (union (scan (le .n 3)) (scan (eq .n 3))) (eq .n 3))", limit=10**6).count() == 2 * n


def test_refused(stored, spark):
    e, _ = stored
    for bad in ("(ixscan (eq none (1)))", "(ixscan (eq ix (1)))"):
        with pytest.raises(BadRequest):
            e.query("d", "c", bad)
    for call in (lambda: e.create_collection("d", "c"), lambda: e.create_index("d", "c", "ix", [".n"]), lambda: e.create_index("d", "c", "iz", []), lambda: e.query("d", "none", "(scan ())"), lambda: e.query("d", "c")):
        with pytest.raises(BadRequest):
            call()
    with pytest.raises(NotImplementedError):
        e.query("d", "c", query="(eq .n 1)")
    with pytest.raises(NotImplementedError):
        e.update("d", "c")
    e.create_index("d", "c", "unbuilt", [".n"], build=False)
    with pytest.raises(BadRequest, match="not ready"):
        e.query("d", "c", "(ixscan (eq unbuilt (1)))")
    with pytest.raises(SchemaConflict):
        e.store.save(e.catalog, -1)


def test_empty_collection(spark):
    e = Engine(spark)
    e.create_collection("d", "c")
    e.create_index("d", "c", "ix", [".n"])
    assert e.query("d", "c", "(scan ())").count() == 0
    assert e.query("d", "c", "(ixscan (gt ix (1)))", tables=True).count() == 0


def test_filters_are_pushed_down(spark):
    e = Engine(spark)
    e.attach("d", "part", spark.range(100).select(F.col("id").alias("size"), F.col("id").cast("string").alias("name")))
    path = f"{e.root}/part"
    spark.range(100).select(F.col("id").alias("size"), F.col("id").cast("string").alias("name")).write.parquet(path)
    e.attach("d", "part", spark.read.parquet(path))
    e.create_index("d", "part", "ix", [".size", ".name"])
    for plan, pushed in (("(scan (gt .size 2.5))", "GreaterThan(size,2)"), ("(scan (not (gt .size 10)))", "LessThanOrEqual(size,10)"), ("(scan (in .size 1 2 3))", "In(size, [1,2,3])"), ('(ixscan (ge ix (5 "b")))', "GreaterThanOrEqual(size,5)")):
        text = e.query("d", "part", plan)._jdf.queryExecution().toString()
        assert "PushedFilters" in text and pushed in text, text


def test_byte_prefix(spark):
    df = spark.createDataFrame([("héllo",), ("日本",), ("",), (None,)], "s string")
    for n in range(6):
        got = [r[0] for r in df.select(byte_prefix(F.col("s"), n)).collect()]
        assert got == [None if s is None else s.encode()[:n].decode(errors="ignore") for s in ("héllo", "日本", "", None)]


def test_two_writers(spark):
    """The second of two writers from one version gets a conflict; the first one's documents stay."""
    e = Engine(spark)
    e.create_collection("d", "c")
    other, loaded = Engine(spark, e.root), e.catalog
    e.insert("d", "c", ['{"a": 1}', '{"a": 2}'])
    other.store.load, once = (lambda: loaded), other.store.load
    save = other.store.save

    def late(catalog, expected):
        other.store.load = once
        save(catalog, expected)

    other.store.save = late
    with pytest.raises(SchemaConflict):
        other.insert("d", "c", ['{"a": "text"}'])
    assert sorted(r.document for r in e.query("d", "c", "(scan ())").collect()) == ['{"a": 1}', '{"a": 2}']
    folders = {f.getPath().getName() for f in e.store.fs.listStatus(e.store.jvm.org.apache.hadoop.fs.Path(f"{e.root}/collections/d/c"))}
    assert folders == {f.split("/")[-1] for f in e.catalog.collection("d", "c").folders}
    assert not e.store.fs.listStatus(e.store.jvm.org.apache.hadoop.fs.Path(f"{e.root}/staged"))
    other.store.save = save
    other.insert("d", "c", ['{"a": 3}'])
    assert e.query("d", "c", "(scan (gt .a 0))").count() == 3


def test_catalog_versions(spark):
    """A version that another writer has put there is never replaced; a draft isn't read."""
    e = Engine(spark)
    for k in range(e.store.KEPT + 5):
        e.create_collection("d", f"c{k}")
    assert len(e.store.versions()) <= e.store.KEPT + 1 and e.catalog.version == e.store.KEPT + 5
    stale = e.catalog
    e.create_collection("d", "more")
    with pytest.raises(SchemaConflict):
        e._save(stale, 1)
    assert "d.more" in e.catalog.collections


def test_failures_are_the_engines(spark):
    with pytest.raises(EngineError):
        Engine(spark, "nosuchsystem://place/x").create_collection("d", "c")


def test_compact(spark):
    e = Engine(spark)
    e.create_collection("d", "c")
    for k in range(4):
        e.insert("d", "c", [f'{{"n": {k}}}', f'{{"k{k}": true}}'])
    before = [tuple(r) for r in e.query("d", "c", "(scan ())", limit=100).collect()]
    e.compact("d", "c")
    assert [tuple(r) for r in e.query("d", "c", "(scan ())", limit=100).collect()] == before
    e.insert("d", "c", ['{"n": 9}'])
    assert [tuple(r) for r in e.query("d", "c", "(scan ())", limit=100).collect()][:-1] == before
    assert e.query("d", "c", "(scan (ge .n 3))").count() == 2 and e.query("d", "c", "(scan (eq .k2 true))").count() == 1


def test_ordered_limits(stored):
    """Filters keep the order of what is below them, a union gives its branches in turn."""
    e, docs = stored
    key = lambda i: (docs[i]["n"], docs[i]["s"].encode(), i)
    both = sorted((i for i, d in enumerate(docs) if "n" in d and "s" in d), key=key)
    ids = [r.document for r in e.query("d", "c", "(scan ())", limit=1000).collect()]
    got = lambda plan, n: [ids.index(r.document) for r in e.query("d", "c", plan, limit=n).collect()]
    doc = lambda xs: [ids.index(ids[i]) for i in xs]  # noqa: E731  equal documents count as one
    assert got("(filter (scan (ge .n 2)) (le .n 4))", 7) == doc([i for i, d in enumerate(docs) if 2 <= d.get("n", 0) <= 4][:7])
    assert got("(ixscan (ge ix (1 \"apple\")))", 9) == doc([i for i in both if key(i)[:2] >= (1, b"apple")][:9])
    assert got("(filter (ixscan (ge ix (1 \"apple\"))) (not (eq .s \"bean\")))", 9) == doc([i for i in both if key(i)[:2] >= (1, b"apple") and docs[i]["s"] != "bean"][:9])
    first, second = [i for i, d in enumerate(docs) if d.get("n") == 6], [i for i in both if key(i)[:2] >= (5, b"")]
    plan = "(union (scan (eq .n 6)) (ixscan (ge ix (5 \"\"))))"
    for n in (0, 3, len(first), len(first) + 5, 10_000):
        assert got(plan, n) == doc((first + second)[:n])
    assert got(f"(filter {plan} (eq .o.t true))", 10_000) == doc([i for i in first + second if docs[i].get("o") == {"t": True}])


def test_documents_as_json(spark):
    e = Engine(spark)
    e.attach("d", "part", spark.range(3).select(F.col("id").alias("size"), F.struct(F.col("id").alias("k")).alias("in")), "size")
    got = e.query("d", "part", "(scan (gt .in.k 1))", as_json=True).collect()
    assert [tuple(r) for r in got] == [("0" * 31 + "2", '{"size":2,"in":{"k":2}}')]


def test_stream(spark, tmp_path):
    from doclattice.streaming.ingest import insert_stream

    e = Engine(spark)
    e.create_collection("d", "c")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"a": 1}\n{"a": "x"}\n{"a": 2}\n')
    docs = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "json")
    insert_stream(e, "d", "c", docs, str(tmp_path / "check"), str(tmp_path / "rejected")).awaitTermination()
    assert e.query("d", "c", "(scan (ge .a 1))").count() == 2
    assert spark.read.parquet(str(tmp_path / "rejected")).count() == 1
    # A failure after the insertion and before the stream's own checkpoint repeats the micro-batch.
    for p in (tmp_path / "check" / "commits").iterdir():
        p.unlink()
    docs = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "json")
    insert_stream(e, "d", "c", docs, str(tmp_path / "check"), str(tmp_path / "rejected")).awaitTermination()
    assert e.query("d", "c", "(scan (ge .a 1))").count() == 2
    assert spark.read.parquet(str(tmp_path / "rejected")).count() == 1
    (tmp_path / "in" / "b.txt").write_text('{"a": 3}\n')
    insert_stream(e, "d", "c", docs, str(tmp_path / "check"), str(tmp_path / "rejected")).awaitTermination()
    assert e.query("d", "c", "(scan (ge .a 1))").count() == 3


def test_json_lines(spark, tmp_path):
    from doclattice.sources.ingest import json_lines

    (tmp_path / "docs.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert json_lines(spark, str(tmp_path / "docs.jsonl")).count() == 2


def test_json_values(spark, tmp_path):
    from doclattice.sources.ingest import json_values

    (tmp_path / "docs.json").write_text('{"a": 1}{"a":\n 2}\n\n [1] "x"\t{"a": 3} {"b": ')
    got = [r.json for r in json_values(spark, str(tmp_path / "docs.json")).collect()]
    assert got == ['{"a": 1}', '{"a":\n 2}', "[1]", '"x"', '{"a": 3}', '{"b": ']
    e = Engine(spark)
    e.create_collection("d", "c")
    assert e.insert("d", "c", json_values(spark, str(tmp_path / "docs.json"))).rejected.count() == 3


def test_older_dialect(spark):
    """Cases of both dialects' differences, each with the documents for which it holds."""
    from doclattice.operators.legacy import referred_fields

    docs = [{"n": 3, "f": 3.0, "s": "plum", "b": True}, {"n": 4, "f": 3.5, "s": "apple", "b": False, "o": {"s": "apple"}}, {"s": "x"}]
    e = Engine(spark)
    e.create_collection("d", "c")
    e.insert("d", "c", docs)
    ids = [r["__id"] for r in e.query("d", "c", "(scan ())", limit=9).collect()]
    cases = {
        "(eq .n .f)": [0], "(ne .n .f)": [1, 2], "(eq .s .o.s)": [1], "(gt .n .f)": [1], "(ne .n 3)": [1, 2], "(in .n (1 3 \"x\"))": [0], "(in .s (\"x\" \"plum\"))": [0, 2],
        "(in .n 3)": [], "(ge .b false)": [0, 1], "(gt .b false)": [0], f'(eq .__id "{ids[2]}")': [2], f'(ne .__id "{ids[2]}")': [0, 1], "(eq 1 1.0)": [0, 1, 2], "(lt 2 1)": [],
        "true": [0, 1, 2], "false": [], "nil": [], "#f": [], "7": [0, 1, 2], '"text"': [0, 1, 2], "word": [0, 1, 2], "()": [0, 1, 2], "(not (eq .n 3) whatever)": [1, 2],
        "(and (le .n 4) true)": [0, 1], "(or false (eq .s 5) (eq .s \"x\"))": [2], "(gt .s 5)": [], "(lt .nope 5)": [], "(not (lt .nope 5))": [0, 1, 2],
    }
    for text, expected in cases.items():
        got = e.query("d", "c", query=text, legacy=True, limit=9).collect()
        assert [ids.index(r["__id"]) for r in got] == expected, text
    for bad in ("(and true)", "(in .n (1) (2))", "(nope .n 1)", "(eq .n)", "((eq) 1)", "(eq .n (1))"):
        with pytest.raises(BadRequest):
            e.query("d", "c", query=bad, legacy=True)
    assert referred_fields('(and (eq .s "a") (in .o.s (1 2)) (not .n))') == {".s", ".o.s", ".n"}


def test_worker_builds_indexes(spark, monkeypatch):
    """In steps, from where another one stopped; an index that a worker has just taken is left to it."""
    import threading
    import time

    from doclattice import engine as module
    from doclattice.streaming.worker import run_worker

    monkeypatch.setattr(module, "BACKFILL", 2)
    e = Engine(spark)
    e.create_collection("d", "c")
    for k in range(5):
        e.insert("d", "c", [f'{{"n": {k}}}', f'{{"n": {k + 10}}}'])
    e.create_index("d", "c", "ix", [".n"], build=False)
    catalog = e.catalog
    catalog.collection("d", "c").indexes["ix"].locked = time.time()
    e._save(catalog, 1)
    assert e.build_pending(timeout=1000) == []
    failing, n = Engine(spark, e.root), []
    entries = failing._entries
    failing._entries = lambda *a: n.append(1) or (entries(*a) if len(n) < 2 else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failing.build_pending(timeout=0)
    assert e.catalog.collection("d", "c").indexes["ix"].batches == 2
    stop = threading.Event()
    t = threading.Thread(target=run_worker, args=(e, stop, 0.1, 0))
    t.start()
    for _ in range(300):
        if e.catalog.collection("d", "c").indexes["ix"].ready:
            break
        time.sleep(0.1)
    stop.set()
    t.join()
    assert len(e.catalog.collection("d", "c").indexes["ix"].folders) == 3
    assert e.query("d", "c", "(ixscan (ge ix (3)))", tables=True).count() == 7


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_many_shapes(spark, monkeypatch, most):
    """Shapes that are judged in several rounds get the verdicts of one round."""
    from doclattice.sources import ingest

    monkeypatch.setattr(ingest, "MAX_SHAPES", most)
    docs = ['{"a": 1}', '{"a": "x"}', '{"b": 1}', '{"a": 2, "b": "x"}', '{"c": true, "a": 5}', "7", '{"b": 2.5}', '{"a": 3}', '{"d": {"e": 1}}']
    e = Engine(spark)
    e.create_collection("d", "c")
    assert sorted(r.place for r in e.insert("d", "c", docs).rejected.collect()) == [1, 3, 5, 6]
    assert {r.path: r.kind for r in e.fields("d", "c").collect()} == {".a": "integer", ".b": "integer", ".c": "boolean", ".d.e": "integer"}
    assert e.insert("d", "c", []).ids.count() == 0
