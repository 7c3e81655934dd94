"""The engine's queries over the star-schema tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.engine import Engine
from doclattice.functions.kinds import FLOAT, INTEGER, STRING

Query = Callable[[SparkSession, str], DataFrame]

#: name: (collection, plan, SQL condition)
FILTERS = {
    "scan_all": ("nation", "(scan ())", "true"),
    "scan_eq_int": ("orders", "(scan (eq .o_orderkey 137))", "o_orderkey = 137"),
    "scan_eq_str": ("customer", '(scan (eq .c_mktsegment "BUILDING"))', "c_mktsegment = 'BUILDING'"),
    "scan_gt": ("lineitem", "(scan (gt .l_quantity 45))", "l_quantity > 45"),
    "scan_ge": ("lineitem", "(scan (ge .l_quantity 45))", "l_quantity >= 45"),
    "scan_lt": ("lineitem", "(scan (lt .l_discount 0.02))", "l_discount < cast(0.02 as double)"),
    "scan_le": ("lineitem", "(scan (le .l_discount 0.02))", "l_discount <= cast(0.02 as double)"),
    "scan_int_frac": ("lineitem", "(scan (gt .l_linenumber 2.5))", "l_linenumber > 2.5"),
    "scan_in_str": ("orders", '(scan (in .o_orderpriority "1-URGENT" "2-HIGH"))', "o_orderpriority in ('1-URGENT', '2-HIGH')"),
    "scan_in_int": ("part", "(scan (in .p_size 3 7 11))", "p_size in (3, 7, 11)"),
    "scan_in_mixed": ("part", '(scan (in .p_size 3 "x" 7))', "p_size in (3, 7)"),
    "scan_and": ("lineitem", '(scan (and (eq .l_returnflag "R") (lt .l_quantity 5)))', "l_returnflag = 'R' and l_quantity < 5"),
    "scan_or": ("customer", '(scan (or (lt .c_acctbal 0) (eq .c_mktsegment "MACHINERY")))', "c_acctbal < 0 or c_mktsegment = 'MACHINERY'"),
    "scan_not": ("orders", '(scan (not (eq .o_orderstatus "O")))', "not o_orderstatus = 'O'"),
    "scan_bool_mix": ("lineitem", '(scan (and (in .l_linenumber 1 2) (eq .l_returnflag "A") (not (gt .l_discount 0.05))))', "l_linenumber in (1, 2) and l_returnflag = 'A' and not l_discount > cast(0.05 as double)"),
    "scan_str_range": ("customer", '(scan (and (ge .c_name "Customer#000000100") (lt .c_name "Customer#000000200")))', "c_name >= 'Customer#000000100' and c_name < 'Customer#000000200'"),
    "scan_missing_not": ("nation", "(scan (not (eq .nope 1)))", "true"),
    "scan_kind_mismatch": ("customer", "(scan (gt .c_name 5))", "false"),
    "scan_kind_mismatch_not": ("customer", "(scan (not (gt .c_name 5)))", "true"),
    "scan_sparse": ("sparse_orders", '(scan (eq .prio "1-URGENT"))', "prio = '1-URGENT'"),
    "scan_sparse_not": ("sparse_orders", '(scan (not (eq .prio "1-URGENT")))', "not coalesce(prio = '1-URGENT', false)"),
    "scan_bool": ("bool_orders", "(scan (eq .open true))", "open"),
    "scan_bool_order": ("bool_orders", "(scan (ge .open false))", "false"),
    "scan_nested": ("nested_events", "(scan (gt .props.k 50))", "k > 50"),
    "ix_eq": ("customer", '(ixscan (eq idx_seg ("HOUSEHOLD")))', "c_mktsegment = 'HOUSEHOLD'"),
    "ix_eq_compound": ("lineitem", '(ixscan (eq idx_lr (3 "N")))', "l_linenumber = 3 and l_returnflag = 'N'"),
    "ix_ge": ("part", "(ixscan (ge idx_size (25)))", "p_size >= 25"),
    "ix_gt": ("part", "(ixscan (gt idx_size (25i64)))", "p_size > 25"),
    "ix_le": ("part", "(ixscan (le idx_size (5)))", "p_size <= 5"),
    "ix_lt": ("part", "(ixscan (lt idx_size (5)))", "p_size < 5"),
    "ix_interval": ("part", "(ixscan (interval idx_size (10) (20)))", "p_size between 10 and 20"),
    "ix_right_interval": ("part", "(ixscan (right-interval idx_size (10) (20)))", "p_size >= 10 and p_size < 20"),
    "ix_left_interval": ("part", "(ixscan (left-interval idx_size (10) (20)))", "p_size > 10 and p_size <= 20"),
    "ix_open_interval": ("part", "(ixscan (open-interval idx_size (10) (20)))", "p_size > 10 and p_size < 20"),
    "ix_gt_compound": ("lineitem", '(ixscan (gt idx_lr (5 "N")))', "l_linenumber > 5 or l_linenumber = 5 and l_returnflag > 'N'"),
    "ix_interval_compound": ("lineitem", '(ixscan (interval idx_lr (2 "N") (4 "A")))', "(l_linenumber > 2 or l_linenumber = 2 and l_returnflag >= 'N') and (l_linenumber < 4 or l_linenumber = 4 and l_returnflag <= 'A')"),
    "ix_sparse": ("sparse_orders", '(ixscan (ge idx_prio ("1")))', "prio is not null and prio >= '1'"),
    "ix_prefix": ("part", '(ixscan (eq idx_name ("small ring")))', "p_name = 'small ring'"),
    "filter_union": ("customer", '(filter (union (scan (eq .c_mktsegment "BUILDING")) (scan (gt .c_acctbal 9000))) (eq .c_nationkey 3))', "c_nationkey = 3"),
    "filter_chain": ("lineitem", '(filter (filter (scan (ge .l_quantity 10)) (lt .l_tax 0.03)) (eq .l_linestatus "O"))', "l_quantity >= 10 and l_tax < cast(0.03 as double) and l_linestatus = 'O'"),
}

SOURCES = {
    "sparse_orders": "select *, nullif(o_orderpriority, '5-LOW') as prio from orders",
    "bool_orders": "select *, o_orderstatus = 'O' as open from orders",
    "twice_customer": "select * from customer where c_mktsegment = 'BUILDING' union all select * from customer where c_acctbal > 9000",
    "nested_events": "select event_id, user_id, event_type, value, cast(json_extract(props, '$.k') as bigint) as k from events",
}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The tables as collections, with indexes."""
    out = Engine(spark)
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ids = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}
    for name in ("nation", "customer", "orders", "lineitem", "part"):
        out.attach("db", name, read(name), ids.get(name))
    out.attach("db", "sparse_orders", read("orders").withColumn("prio", F.expr("nullif(o_orderpriority, '5-LOW')")))
    out.attach("db", "bool_orders", read("orders").withColumn("open", F.col("o_orderstatus") == "O"))
    out.attach("db", "nested_events", read("events").select("event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint").alias("props")))
    out.attach("db", "accented", read("part").select("p_partkey", F.concat(F.lit("é日"), F.col("p_name")).alias("name")), "p_partkey")
    out.create_index("db", "accented", "idx_name", [(".name", 7)])
    out.create_index("db", "orders", "idx_order", [".o_orderstatus", ".o_orderkey"])
    out.create_index("db", "customer", "idx_seg", [".c_mktsegment"])
    out.create_index("db", "lineitem", "idx_lr", [".l_linenumber", ".l_returnflag"])
    out.create_index("db", "part", "idx_size", [".p_size"])
    out.create_index("db", "part", "idx_name", [(".p_name", 4)])
    out.create_index("db", "sparse_orders", "idx_prio", [".prio"])
    return out


def _flat(df: DataFrame) -> DataFrame:
    """Without __id, and nested fields in columns of their own, for comparison with SQL."""
    if "props" in df.columns:
        df = df.withColumn("k", F.col("props.k")).drop("props")
    return df.drop("__id")


def _filter(name: str) -> Query:
    coll, plan, _ = FILTERS[name]
    return lambda spark, sf_dir: _flat(engine(spark, sf_dir).query("db", coll, plan))


def union_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(engine(spark, sf_dir).query("db", "part", "(union (ixscan (le idx_size (5))) (scan (eq .p_size 5)))"))


def union_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(engine(spark, sf_dir).query("db", "part", "(union (union (scan (eq .p_size 1)) (scan (le .p_size 2))) (scan (eq .p_size 30)) (ixscan (ge idx_size (30))))"))


def limit_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(engine(spark, sf_dir).query("db", "orders", "(scan ())", limit=10))


def limit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(engine(spark, sf_dir).query("db", "orders", '(ixscan (ge idx_order ("O" 1000)))', limit=25))


def limit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(engine(spark, sf_dir).query("db", "orders", '(filter (union (ixscan (ge idx_order ("P" 0))) (scan (le .o_orderkey 50))) (in .o_orderpriority "1-URGENT" "2-HIGH"))', limit=500))


def documents_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir).query("db", "part", "(scan (eq .p_size 7))", as_json=True)
    return found.select("__id", F.get_json_object("document", "$.p_partkey").cast("long").alias("p_partkey"), F.get_json_object("document", "$.p_name").alias("p_name"))


def multibyte_prefix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).index_entries("db", "accented", "idx_name")


LEGACY = {
    "legacy_ne": ("sparse_orders", '(ne .prio "1-URGENT")', "prio is distinct from '1-URGENT'"),
    "legacy_fields": ("lineitem", "(gt .l_quantity .l_suppkey)", "l_quantity > l_suppkey"),
    "legacy_in_list": ("part", '(and (in .p_size (3 "x" 7)) (not (eq .p_brand "Brand#3")))', "p_size in (3, 7) and p_brand <> 'Brand#3'"),
    "legacy_bool_order": ("bool_orders", "(gt .open false)", "open"),
    "legacy_id": ("part", '(eq .__id "000000000000000000000000000000ff")', "p_partkey = 255"),
}


def _legacy(name: str) -> Query:
    coll, query, _ = LEGACY[name]
    return lambda spark, sf_dir: _flat(engine(spark, sf_dir).query("db", coll, query=query, legacy=True))


def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).get("db", "orders", "00000000" + f"{137:024x}")


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).index_entries("db", "customer", "idx_seg")


def index_prefix_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).index_entries("db", "part", "idx_name")


def _inserted(spark: SparkSession, sf_dir: str) -> Engine:
    out = Engine(spark)
    out.create_collection("db", "events")
    docs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("place"), F.to_json(F.struct("event_id", "user_id", "event_type", F.from_json("props", "k bigint").alias("props"))).alias("json"))
    out.insert("db", "events", docs, order="place")
    out.create_index("db", "events", "idx_k", [".props.k", ".event_type"])
    return out


def inserted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of inserted documents: the schema's version, the batch, and the place in it."""
    found = _inserted(spark, sf_dir).query("db", "events", "(scan (lt .props.k 20))")
    return found.select("__id", F.get_json_object("document", "$.event_id").cast("long").alias("event_id"))


def inline_index_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that comes after the index was made is in the index's table."""
    out = _inserted(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id <= 300").select((F.col("event_id") + 10**9).alias("place"), F.to_json(F.struct((F.col("event_id") + 10**9).alias("event_id"), "event_type", F.from_json("props", "k bigint").alias("props"))).alias("json"))
    out.insert("db", "events", docs, order="place")
    found = out.query("db", "events", '(ixscan (interval idx_k (10 "click") (30 "view")))', tables=True)
    return found.select(F.get_json_object("document", "$.event_id").cast("long").alias("event_id"))


def emergent_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inserted(spark, sf_dir).fields("db", "events")


def ingested_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _inserted(spark, sf_dir).query("db", "events", '(scan (and (gt .props.k 50) (eq .event_type "click")))')
    return found.select(F.get_json_object("document", "$.event_id").cast("long").alias("event_id"), F.get_json_object("document", "$.props.k").cast("long").alias("k"))


def ingested_index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _inserted(spark, sf_dir).query("db", "events", '(ixscan (interval idx_k (10 "click") (12 "view")))', tables=True)
    return found.select(F.get_json_object("document", "$.event_id").cast("long").alias("event_id"))


REJECTED = ["137", '{"foo": 137}', '{"foo": "bar"}', '{"foo": 1.0}', '{"bar": {"baz": "chlos"}}', '{"foo": null}', '{"foo": [1]}', '{"_x": 1}', '{"bar": {}}', '{"Foo": "x", "foo-bar": true}', "{", '{"new": 1, "foo": "x"}', '{"new": "s"}']


def validate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Engine(spark)
    out.create_collection("db", "ragged")
    return out.insert("db", "ragged", REJECTED).rejected.select("place", "reason")


OTHERS: dict[str, Query] = {f.__name__: f for f in (union_dup, union_nested, limit_ordered, limit_index, limit_union, documents_as_json, get_by_id, index_entries, index_prefix_entries, multibyte_prefix_entries, inserted_ids, inline_index_writes, emergent_schema, ingested_scan, ingested_index_table, validate_rejects)}
_ID = "'00000000' || lpad(lower(hex({0})), 24, '0')"
OTHER_SQL = {
    "union_dup": "select * from part where p_size <= 5 union all select * from part where p_size = 5",
    "union_nested": "select * from part where p_size = 1 union all select * from part where p_size <= 2 union all select * from part where p_size = 30 union all select * from part where p_size >= 30",
    "limit_ordered": "select * from orders order by o_orderkey limit 10",
    "limit_index": "select * from orders where o_orderstatus > 'O' or o_orderstatus = 'O' and o_orderkey >= 1000 order by o_orderstatus, o_orderkey limit 25",
    "limit_union": """select * exclude (turn, k) from (select *, 1 as turn, row_number() over (order by o_orderstatus, o_orderkey) as k from orders where o_orderstatus >= 'P' and o_orderpriority in ('1-URGENT', '2-HIGH')
  union all select *, 2 as turn, o_orderkey as k from orders where o_orderkey <= 50 and o_orderpriority in ('1-URGENT', '2-HIGH')) order by turn, k limit 500""",
    "documents_as_json": f"select {_ID.format('p_partkey')} as __id, p_partkey, p_name from part where p_size = 7",
    "multibyte_prefix_entries": f"select 'é日' || substr(p_name, 1, 2) as k0, {_ID.format('p_partkey')} as __id from part",
    "inserted_ids": """select '02000000' || '00000000' || lpad(lower(hex(event_id)), 16, '0') as __id, event_id from events where cast(json_extract(props, '$.k') as bigint) < 20""",
    "inline_index_writes": """select case when late then event_id + 1000000000 else event_id end as event_id from (select *, cast(json_extract(props, '$.k') as bigint) as k, false as late from events
  union all select *, cast(json_extract(props, '$.k') as bigint) as k, true as late from events where event_id <= 300) where (k > 10 or k = 10 and event_type >= 'click') and (k < 30 or k = 30 and event_type <= 'view')""",
    "get_by_id": f"select *, {_ID.format('o_orderkey')} as __id from orders where o_orderkey = 137",
    "index_entries": f"select c_mktsegment as k0, {_ID.format('c_custkey')} as __id from customer",
    "index_prefix_entries": f"select substr(p_name, 1, 4) as k0, {_ID.format('p_partkey')} as __id from part",
    "emergent_schema": f"select * from (values ('.event_id', '{INTEGER}'), ('.event_type', '{STRING}'), ('.props.k', '{INTEGER}'), ('.user_id', '{INTEGER}')) t(path, kind)",
    "ingested_scan": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) > 50 and event_type = 'click'",
    "ingested_index_table": "select event_id from (select *, cast(json_extract(props, '$.k') as bigint) as k from events) where (k > 10 or k = 10 and event_type >= 'click') and (k < 12 or k = 12 and event_type <= 'view')",
    "validate_rejects": f"""select cast(place as bigint) as place, reason from (values (0, 'a document is an object'), (2, 'field .foo holds {INTEGER} values, not {STRING}'),
  (3, 'field .foo holds {INTEGER} values, not {FLOAT}'), (5, 'field .foo is null'), (6, 'field .foo is an array'), (7, 'field name ''_x'' is not allowed'),
  (10, 'not a JSON value with distinct names'), (11, 'field .foo holds {INTEGER} values, not {STRING}')) t(place, reason)""",
}


def _sql(name: str) -> str:
    coll, _, where = FILTERS[name]
    coll = "twice_customer" if name == "filter_union" else coll  # the union keeps what both branches have
    return f"select * from ({SOURCES.get(coll, f'select * from {coll}')}) where {where}"


def _legacy_sql(name: str) -> str:
    coll, _, where = LEGACY[name]
    return f"select * from ({SOURCES.get(coll, f'select * from {coll}')}) where {where}"


QUERIES: dict[str, Query] = {name: _filter(name) for name in FILTERS} | {name: _legacy(name) for name in LEGACY} | OTHERS
ORACLE_SQL: dict[str, str] = {name: _sql(name) for name in FILTERS} | {name: _legacy_sql(name) for name in LEGACY} | OTHER_SQL
