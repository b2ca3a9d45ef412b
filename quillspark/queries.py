"""One query for each command and each feature of the language, with SQL that gives the same rows.

Doubles that sums and roots make are rounded to six places on both sides, as the last digits depend on the order.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import Engine
from .lang.parser import parse, parse_key
from .operators.frame import from_scan
from .operators.pixel import PixelFrame
from .operators.tree_ops import Desk, Tree
from .plans.planner import validate
from .plans.registry import Param
from .sources.store import FileStore, MemoryStore, Router

FLAGSHIP = "-R/lineitem.parquet/-/ns-pl/eq-l_returnflag-A/gt-l_quantity-45/select_columns-l_orderkey~_l_linenumber~_l_extendedprice/sort-l_extendedprice-f/head-10"
PEOPLE = "name,age,city,score\nAlice,30,NYC,1.5\nBob,25,LA,\n\"Smith, C\",35,Chicago,2.25\n"

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{f.name}`"), 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema))


def values(spark: SparkSession, **named) -> DataFrame:
    """One row of texts and numbers."""
    kinds = {int: "long", str: "string", bool: "boolean", float: "double"}
    return spark.createDataFrame([tuple(named.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in named.items()))


def query(name: str, text: str, sql: str | None, finish=None) -> None:
    Q[name] = lambda spark, d: (finish or (lambda df: df))(Engine(spark, d).frame(text))
    if sql:
        SQL[name] = sql


def custom(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# Frames

query("flagship", FLAGSHIP, "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45 ORDER BY l_extendedprice DESC NULLS FIRST LIMIT 10")
query("scan_parquet", "-R/customer.parquet", "SELECT * FROM customer")
query("select_columns", "-R/part.parquet/-/ns-pl/select_columns-p_brand~_p_partkey", "SELECT p_brand, p_partkey FROM part")
query("select_columns_variadic", "-R/part.parquet/-/ns-pl/select_columns-p_size-p_partkey", "SELECT p_size, p_partkey FROM part")
query("drop_columns", "-R/part.parquet/-/ns-pl/drop_columns-p_name~_p_type", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
for _name, _sign in {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}.items():
    query(_name, f"-R/lineitem.parquet/-/ns-pl/{_name}-l_quantity-24/select_columns-l_orderkey-l_quantity-l_partkey", f"SELECT l_orderkey, l_quantity, l_partkey FROM lineitem WHERE l_quantity {_sign} 24")
query("eq_string", "-R/orders.parquet/-/ns-pl/eq-o_orderpriority-3~_MEDIUM/select_columns-o_orderkey-o_orderpriority", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '3-MEDIUM'")
query("eq_string_space", "-R/orders.parquet/-/ns-pl/eq-o_orderpriority-4~_NOT~.SPECIFIED/nrows", "SELECT count(*) AS nrows FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'")
query("gt_negative", "-R/customer.parquet/-/ns-pl/lt-c_acctbal-~50/select_columns-c_custkey-c_acctbal", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -50")
query("eq_date", "-R/orders.parquet/-/ns-pl/cast-o_orderdate-date/gte-o_orderdate-1996~_06~_01/lt-o_orderdate-19960701/select_columns-o_orderkey", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-06-01' AND CAST(o_orderdate AS DATE) < DATE '1996-07-01'")
query("gt_timestamp", "-R/events.parquet/-/ns-pl/gte-ts-2024~_01~_15/select_columns-event_id-event_type", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
query("chain_filter_sort_head", "-R/orders.parquet/-/ns-pl/eq-o_orderstatus-F/gt-o_totalprice-1000/sort-o_orderkey/head-25/select_columns-o_orderkey-o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 25")
query("sort_asc", "-R/customer.parquet/-/ns-pl/sort-c_custkey/head-7", "SELECT * FROM customer ORDER BY c_custkey LIMIT 7")
query("sort_desc", "-R/customer.parquet/-/ns-pl/sort-c_custkey-f/head-7", "SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 7")
query("sort_stable", "-R/customer.parquet/-/ns-pl/sort-c_custkey-f/sort-c_mktsegment/head-40/select_columns-c_custkey", "SELECT c_custkey FROM customer ORDER BY c_mktsegment, c_custkey DESC LIMIT 40")
query("head", "-R/orders.parquet/-/ns-pl/sort-o_orderkey/head-12/select_columns-o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 12")
query("tail", "-R/orders.parquet/-/ns-pl/sort-o_orderkey/tail-12/select_columns-o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 12")
query("slice", "-R/orders.parquet/-/ns-pl/sort-o_orderkey/slice-100-20/select_columns-o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
query("head_of_tail", "-R/orders.parquet/-/ns-pl/sort-o_orderkey/tail-12/head-3/select_columns-o_orderkey", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 12) ORDER BY o_orderkey LIMIT 3")
query("topk", "-R/part.parquet/-/ns-pl/sort-p_partkey-f/head-10/select_columns-p_partkey-p_name", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC LIMIT 10")
query("sum", "-R/lineitem.parquet/-/ns-pl/select_columns-l_orderkey-l_linenumber-l_quantity-l_tax/sum", "SELECT coalesce(sum(l_orderkey), 0)::BIGINT AS l_orderkey, coalesce(sum(l_linenumber), 0)::BIGINT AS l_linenumber, round(coalesce(sum(l_quantity), 0), 6) AS l_quantity, round(coalesce(sum(l_tax), 0), 6) AS l_tax FROM lineitem", rounded)
query("sum_empty", "-R/lineitem.parquet/-/ns-pl/lt-l_quantity-~5/select_columns-l_quantity-l_linenumber/sum", "SELECT 0::DOUBLE AS l_quantity, 0::BIGINT AS l_linenumber")
query("mean", "-R/lineitem.parquet/-/ns-pl/select_columns-l_quantity-l_extendedprice/mean", "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 6) AS l_extendedprice FROM lineitem", rounded)
query("median", "-R/lineitem.parquet/-/ns-pl/select_columns-l_quantity-l_extendedprice/median", "SELECT median(l_quantity) AS l_quantity, round(median(l_extendedprice), 6) AS l_extendedprice FROM lineitem", rounded)
query("min", "-R/lineitem.parquet/-/ns-pl/select_columns-l_quantity-l_shipdate-l_returnflag-l_orderkey/min", "SELECT min(l_quantity) AS l_quantity, min(l_shipdate) AS l_shipdate, min(l_returnflag) AS l_returnflag, min(l_orderkey) AS l_orderkey FROM lineitem")
query("max", "-R/lineitem.parquet/-/ns-pl/select_columns-l_quantity-l_shipdate-l_returnflag-l_orderkey/max", "SELECT max(l_quantity) AS l_quantity, max(l_shipdate) AS l_shipdate, max(l_returnflag) AS l_returnflag, max(l_orderkey) AS l_orderkey FROM lineitem")
query("std", "-R/lineitem.parquet/-/ns-pl/select_columns-l_quantity-l_extendedprice/std", "SELECT round(stddev_samp(l_quantity), 6) AS l_quantity, round(stddev_samp(l_extendedprice), 6) AS l_extendedprice FROM lineitem", rounded)
query("count", "-R/events.parquet/-/ns-pl/count", "SELECT count(event_id) AS event_id, count(ts) AS ts, count(user_id) AS user_id, count(event_type) AS event_type, count(\"value\") AS \"value\", count(props) AS props FROM events")
query("describe", "-R/part.parquet/-/ns-pl/select_columns-p_name-p_size-p_retailprice/describe", "SELECT " + ", ".join(f"round({f}({c}), 6) AS {c}_{n}" if n in ("mean", "std") or c == "p_retailprice" else f"{f}({c}) AS {c}_{n}" for c in ("p_size", "p_retailprice") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))) + " FROM part", rounded)
query("shape", "-R/orders.parquet/-/ns-pl/shape", "SELECT 6::BIGINT AS ncols, count(*) AS nrows FROM orders")
query("nrows", "-R/orders.parquet/-/ns-pl/nrows", "SELECT count(*) AS nrows FROM orders")
query("schema", "-R/supplier.parquet/-/ns-pl/schema", "SELECT * FROM (VALUES ('s_acctbal', 'Float64'), ('s_name', 'String'), ('s_nationkey', 'Int32'), ('s_suppkey', 'Int64')) AS t(name, dtype)")
query("to_csv", "-R/nation.parquet/-/ns-pl/sort-n_nationkey-f/to_csv", "SELECT 'n_nationkey,n_name,n_regionkey' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey || chr(10), '' ORDER BY n_nationkey DESC) AS text FROM nation")


@custom("ncols", "SELECT 6::BIGINT AS ncols")
def _(spark, d):
    return values(spark, ncols=Engine(spark, d).evaluate("-R/orders.parquet/-/ns-pl/ncols").get())


_PEOPLE_SQL = "SELECT * FROM (VALUES ('Alice', 30::BIGINT, 'NYC', 1.5::DOUBLE), ('Bob', 25, 'LA', NULL), ('Smith, C', 35, 'Chicago', 2.25)) AS t(name, age, city, score)"


@custom("from_csv", _PEOPLE_SQL)
def _(spark, d):
    return Engine(spark, d).apply("ns-pl/from_csv", PEOPLE).frame()


@custom("from_csv_quoted_newline", "SELECT * FROM (VALUES ('x' || chr(10) || 'y', 1::BIGINT), ('u\u2028v', 2), ('say \"hi\"', 3)) AS t(a, b)")
def _(spark, d):
    return Engine(spark, d).apply("ns-pl/from_csv", 'a,b\n"x\ny",1\r\nu\u2028v,2\n"say ""hi""",3\n').frame()


@custom("from_csv_separator", _PEOPLE_SQL + " WHERE age > 26")
def _(spark, d):
    return Engine(spark, d).apply("ns-pl/from_csv-semicolon/gt-age-26", PEOPLE.replace('"Smith, C"', "Smith# C").replace(",", ";").replace("#", ",")).frame()


@custom("csv_round_trip", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _(spark, d):
    e = Engine(spark, d)
    return e.apply("ns-pl/from_csv", e.evaluate("-R/region.parquet/-/ns-pl/to_csv/ns-pl/to_text").get()).frame()


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors reach; only a local master without a checkpoint folder gets a temporary one."""
    from pathlib import Path

    shared = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared}/store-{uuid.uuid4().hex}" if shared else Path(tempfile.mkdtemp(prefix="store-")).as_uri()


def _folder(spark: SparkSession, d: str, **options) -> Engine:
    """The tables, and a folder of its own to write into."""
    return Engine(spark, Router([FileStore(spark, _shared_folder(spark), parse_key("out")), MemoryStore(parse_key("mem")), FileStore(spark, d)]), **options)


@custom("store_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    e = _folder(spark, d)
    e.evaluate_and_store("-R/orders.parquet/-/ns-pl/eq-o_orderstatus-P/select_columns-o_orderkey-o_totalprice", "out/p.parquet")
    return e.frame("-R/out/p.parquet")


@custom("store_csv", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    e = _folder(spark, d)
    e.evaluate_and_store("-R/nation.parquet/-/ns-pl/eq-n_regionkey-1/select_columns-n_nationkey-n_name", "out/n.csv")
    return e.frame("-R/out/n.csv")


@custom("store_json", "SELECT r_name FROM region")
def _(spark, d):
    e = _folder(spark, d)
    e.evaluate_and_store("-R/region.parquet/-/ns-pl/select_columns-r_name", "out/r.jsonl")
    return e.frame("-R/out/r.jsonl")


# The language

query("link_param", "-R/lineitem.parquet/-/ns-pl/gt-l_quantity-~X~-R/lineitem.parquet/-/ns-pl/select_columns-l_quantity/mean~E/nrows", "SELECT count(*) AS nrows FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem)")
query("join_link", "-R/orders.parquet/-/ns-pl/join-~X~-R/customer.parquet/-/ns-pl/eq-c_mktsegment-BUILDING~E-o_custkey-c_custkey/select_columns-o_orderkey-c_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
query("join_semi", "-R/customer.parquet/-/ns-pl/join-~X~-R/orders.parquet/-/ns-pl/gt-o_totalprice-5000~E-c_custkey-o_custkey-semi/select_columns-c_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 5000)")
query("shorthand", "nation.parquet/-/ns-pl/lt-n_nationkey-3", "SELECT * FROM nation WHERE n_nationkey < 3")
query("filename", "-R/nation.parquet/-/ns-pl/gt-n_nationkey-20/out.csv", "SELECT * FROM nation WHERE n_nationkey > 20")


@custom("alias", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 2")
def _(spark, d):
    e = Engine(spark, d)
    e.registry.alias("two", "head", ("2",), ns="pl")
    return e.frame("-R/region.parquet/-/ns-pl/sort-r_regionkey/two")


@custom("user_command", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    e = Engine(spark, d)

    @e.registry.command("by_nation", Param("nations", "any"), ns="my")
    def by_nation(context, state, nations):
        return from_scan(state.value.visible().join(nations.visible(), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers")))

    return e.frame("-R/customer.parquet/-/ns-my/by_nation-~X~-R/nation.parquet~E")


@custom("template", "SELECT 'There are ' || (SELECT count(*) FROM orders) || ' orders for $' AS text")
def _(spark, d):
    return values(spark, text=Engine(spark, d).evaluate_template("There are $-R/orders.parquet/-/ns-pl/nrows$ orders for $$"))


@custom("quote_q", "SELECT '-R/orders.parquet/-/ns-pl/head-3' AS query")
def _(spark, d):
    return values(spark, query=Engine(spark, d).evaluate("-R/orders.parquet/-/ns-pl/head-3/q").get().encode())


@custom("key_value", "SELECT 'a/b/c.txt' AS key")
def _(spark, d):
    return values(spark, key=Engine(spark, d).evaluate("-R-key/a/b/c.txt").get().encode())


@custom("canonical", "SELECT '-R/data/a.csv/-/ns-pl/eq-b-~12-x~.y' AS text, true AS same")
def _(spark, d):
    q = parse("data/a.csv/-/ns-pl/eq-b-~12-x~.y")
    return values(spark, text=q.canonical().encode(), same=parse(q.encode()).canonical() == q.canonical())


@custom("validate", "SELECT * FROM (VALUES ('-R/a.csv/-/ns-pl/head-x', false, 'plan'), ('a b', false, 'parse'), ('-R/a.csv/-/ns-pl/head-2-3', true, 'done')) AS t(query, valid, stage)")
def _(spark, d):
    e = Engine(spark, d)
    return spark.createDataFrame([(r["query"], r["valid"], r["stage"]) for r in (validate(q, e.registry) for q in ("-R/a.csv/-/ns-pl/head-x", "a b", "-R/a.csv/-/ns-pl/head-2-3"))], "query string, valid boolean, stage string")


_RECIPES = """recipes:
- query: -R/orders.parquet/-/ns-pl/gt-o_totalprice-9000/big.parquet
  title: Large orders
  arguments: {value: 100000}
- query: -R/mem/big.parquet/-/ns-pl/count/n.csv
"""


def _with_recipes(spark, d) -> Engine:
    e = _folder(spark, d)
    e.store.set(parse_key("mem/recipes.yaml"), _RECIPES.encode())
    return e


@custom("recipe", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def _(spark, d):
    return _with_recipes(spark, d).frame("-R/mem/big.parquet").select("o_orderkey", "o_totalprice")


@custom("recipe_of_recipe", "SELECT count(*) AS o_orderkey FROM orders WHERE o_totalprice > 100000")
def _(spark, d):
    return _with_recipes(spark, d).frame("-R/mem/n.csv").select("o_orderkey")


@custom("recipe_value", "SELECT 'Large orders' AS title, '-R/orders.parquet/-/ns-pl/gt-o_totalprice-9000/big.parquet' AS query")
def _(spark, d):
    r = _with_recipes(spark, d).evaluate("-R-recipe/mem/big.parquet").get()
    return values(spark, title=r["title"], query=r["query"])


@custom("listdir", "SELECT * FROM (VALUES ('mem/big.parquet', 'big.parquet', 'recipe'), ('mem/n.csv', 'n.csv', 'recipe'), ('mem/recipes.yaml', 'recipes.yaml', 'source')) AS t(key, name, status)")
def _(spark, d):
    return _with_recipes(spark, d).frame("-R-dir/mem").select("key", "name", "status")


@custom("listdir_store", "SELECT 'recipes.yaml' AS name, false AS is_dir")
def _(spark, d):
    return _with_recipes(spark, d).frame("-R-sdir/mem").select("name", "is_dir")


@custom("binary", "SELECT 'PAR1' AS head")
def _(spark, d):
    return values(spark, head=Engine(spark, d).evaluate("-R-bin/region.parquet").get()[:4].decode())


@custom("metadata", "SELECT 'region.parquet' AS key, 'source' AS status, 'parquet' AS data_format, 'application/vnd.apache.parquet' AS media_type")
def _(spark, d):
    m = Engine(spark, d).evaluate("-R-meta/region.parquet").get()
    return values(spark, **{k: m[k] for k in ("key", "status", "data_format", "media_type")})


@custom("cwd", "SELECT * FROM region")
def _(spark, d):
    e = Engine(spark, d)
    return e._run(e.plan("-R/./region.parquet", parse_key("")), None, None).frame()


@custom("caching", "SELECT true AS kept, true AS volatile_new, 1::BIGINT AS expired")
def _(spark, d):
    e = _folder(spark, d)
    e.set_value("mem/t.txt", "x")
    first = e.asset("-R/mem/t.txt/-/to_text")
    kept = e.asset("-R/mem/t.txt/-/to_text") is first
    again = e.asset("-R/mem/t.txt/-/to_text/v") is not e.asset("-R/mem/t.txt/-/to_text/v")
    e.set_value("mem/t.txt", "y")
    return values(spark, kept=kept, volatile_new=again, expired=int(first.status == "expired" and e.evaluate("-R/mem/t.txt/-/to_text").get() == "y"))


@custom("to_text", "SELECT (SELECT count(*) FROM part)::VARCHAR AS text")
def _(spark, d):
    return values(spark, text=Engine(spark, d).evaluate("-R/part.parquet/-/ns-pl/nrows/to_text").get())


@custom("to_metadata", "SELECT 'frame' AS type_identifier")
def _(spark, d):
    return values(spark, type_identifier=Engine(spark, d).evaluate("-R/part.parquet/-/to_metadata").get()["type_identifier"])


@custom("to_assetinfo", "SELECT 'part.parquet' AS key")
def _(spark, d):
    return values(spark, key=Engine(spark, d).evaluate("-R/part.parquet/-/to_assetinfo").get()[0]["key"])


@custom("show_asset_info", "SELECT true AS shown")
def _(spark, d):
    return values(spark, shown="key: part.parquet" in Engine(spark, d).evaluate("-R/part.parquet/-/show_asset_info").get())


@custom("from_yaml", "SELECT 2::BIGINT AS b")
def _(spark, d):
    return values(spark, b=Engine(spark, d).apply("from_yaml", "a: [1]\nb: 2\n").get()["b"])


@custom("commands_doc", "SELECT true AS has_head")
def _(spark, d):
    return values(spark, has_head="### head" in Engine(spark, d).evaluate("commands_doc-pl").get())


@custom("dep_command_metadata", "SELECT 'head' AS name, 'pl' AS namespace")
def _(spark, d):
    r = json.loads(Engine(spark, d).evaluate("ns-dep/command_metadata--pl-head").get())
    return values(spark, name=r["name"], namespace=r["namespace"])


@custom("dep_command_implementation", "SELECT 'sort' AS name")
def _(spark, d):
    return values(spark, name=json.loads(Engine(spark, d).evaluate("ns-dep/command_implementation--pl-sort").get())["name"])


@custom("label", "SELECT 'hello' AS text")
def _(spark, d):
    return values(spark, text=Engine(spark, d).evaluate("label-hello").get()["text"])


@custom("text_editor", "SELECT 'a/b.txt' AS key")
def _(spark, d):
    return values(spark, key=Engine(spark, d).evaluate("-R-key/a/b.txt/-/text_editor").get()["key"])


@custom("registry", "SELECT * FROM (VALUES ('dep', 2::BIGINT), ('img', 47), ('lui', 14)) AS t(namespace, n)")
def _(spark, d):
    rows = [(c.ns, c.name) for c in Engine(spark, d).registry.commands.values()]
    return spark.createDataFrame(rows, "namespace string, name string").filter("namespace in ('dep', 'img', 'lui')").groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


# What is stored, and results that are kept

query("stored", "-R-stored/nation.parquet/-/ns-pl/gt-n_nationkey-20", "SELECT * FROM nation WHERE n_nationkey > 20")
query("cwd_header", "-R-cwd/x/y/-R/../../nation.parquet/-/ns-pl/gt-n_nationkey-~X~-R/../../region.parquet/-/ns-pl/nrows~E/select_columns-n_name", "SELECT n_name FROM nation WHERE n_nationkey > (SELECT count(*) FROM region)")


@custom("stored_metadata", "SELECT 'region.parquet' AS key, 'source' AS status, 'region.parquet' AS filename")
def _(spark, d):
    m = Engine(spark, d).evaluate("-R-stored_meta/region.parquet").get()
    return values(spark, **{k: m[k] for k in ("key", "status", "filename")})


@custom("realm", "SELECT 'here' AS text, (SELECT count(*) FROM orders) AS n")
def _(spark, d):
    e = Engine(spark, d)
    e.registry.command("where", realm="there")(lambda c, s: "here")
    e.registry.command("where")(lambda c, s: "elsewhere")
    return values(spark, text=e.evaluate("-there/where").get(), n=e.frame("-R/orders.parquet/-/ns-pl/nrows").first()[0])


@custom("injected", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def _(spark, d):
    e = Engine(spark, d)
    e.registry.command("mine", Param("nation", injected="payload"), payload=True)(lambda c, s, nation: from_scan(s.value.visible().filter(F.col("c_nationkey") == nation).select("c_custkey")))
    return e.evaluate_immediately("-R/customer.parquet/-/mine", 3).frame()


@custom("expiration", "SELECT * FROM (VALUES ('in 0 s', 2::BIGINT), ('in 1 h', 1), ('never', 1)) AS t(expires, runs)")
def _(spark, d):
    e, rows = Engine(spark, d), []
    for i, expires in enumerate(("in 0 s", "in 1 h", "never")):
        runs = []
        e.registry.command(f"made{i}", expires=expires)(lambda c, s, runs=runs: runs.append(1) or "x")
        e.evaluate(f"made{i}"), e.evaluate(f"made{i}")
        rows.append((expires, len(runs)))
    return spark.createDataFrame(rows, "expires string, runs long")


@custom("cascade", "SELECT * FROM (VALUES ('-R/mem/a.txt/-/to_text', 'expired'), ('-R/mem/b.txt/-/to_text', 'ready')) AS t(query, status)")
def _(spark, d):
    e = _folder(spark, d)
    for name in "ab":
        e.set_value(f"mem/{name}.txt", name)
    made = [e.asset(f"-R/mem/{name}.txt/-/to_text") for name in "ab"]
    e.set_value("mem/a.txt", "new")
    return spark.createDataFrame([(a.query.encode(), a.status) for a in made], "query string, status string")


@custom("override", "SELECT 'override' AS status, 5::BIGINT AS n, 5::BIGINT AS dependent")
def _(spark, d):
    e = _with_recipes(spark, d)
    status = e.set_value("mem/big.parquet", from_scan(spark.range(5).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_totalprice")))).status
    return values(spark, status=status, n=e.frame("-R/mem/big.parquet/-/ns-pl/nrows").first()[0], dependent=e.frame("-R/mem/n.csv").select("o_orderkey").first()[0])


@custom("kept_frames", "SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    e = _folder(spark, d, keep="out/kept")
    text = "-R/orders.parquet/-/ns-pl/eq-o_orderstatus-F/select_columns-o_custkey-o_totalprice"
    e.evaluate(text)
    again = Engine(spark, e.store, keep="out/kept").evaluate(text)  # reads what the first engine wrote
    assert again.metadata.path is not None
    return again.frame()


@custom("notifications", "SELECT * FROM (VALUES ('status'), ('log'), ('progress')) AS t(kind)")
def _(spark, d):
    e, seen = Engine(spark, d), []
    e.hub.subscribe(seen.append)
    e.registry.command("talk")(lambda c, s: (c.say("so far"), c.progress(1, 2)) and "done")
    e.evaluate("talk")
    return spark.createDataFrame([(k,) for k in sorted({x.kind for x in seen})], "kind string")


_WRONG = {
    "a b": "parse", "-R-what/region.parquet": "not-supported", "-R/none.parquet": "not-found", "-R/region.parquet/-/none": "unknown-command", "-R/region.parquet/-/ns-pl/select_columns-none": "argument",
    "-R/region.parquet/-/ns-pl/head-99999999999999999999": "argument", "-R/region.parquet/-/ns-pl/head-~X~-R/region.parquet~E": "conversion", "-R/region.parquet/-/ns-img/dims": "conversion",
}


@custom("errors", "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{kind}')" for q, kind in _WRONG.items()) + ") AS t(query, type)")
def _(spark, d):
    from .errors import EngineError

    e, rows = Engine(spark, d), []
    for text in _WRONG:
        try:
            e.evaluate(text)
            rows.append((text, "none"))
        except EngineError as error:
            rows.append((text, error.type))
    return spark.createDataFrame(rows, "query string, type string")


# Extensions on frames

query("contains", "-R/part.parquet/-/ns-pl/contains-p_type-R/select_columns-p_partkey-p_type", "SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'R')")
query("startswith", "-R/part.parquet/-/ns-pl/startswith-p_type-S/select_columns-p_partkey", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S')")
query("endswith", "-R/part.parquet/-/ns-pl/endswith-p_type-M/select_columns-p_partkey", "SELECT p_partkey FROM part WHERE suffix(p_type, 'M')")
query("isnull", "-R/customer.parquet/-/ns-pl/cast-c_name-int/isnull-c_name/nrows", "SELECT count(*) AS nrows FROM customer WHERE TRY_CAST(c_name AS INT) IS NULL")
query("notnull", "-R/customer.parquet/-/ns-pl/notnull-c_name/nrows", "SELECT count(c_name) AS nrows FROM customer")
query("min_rows", "-R/lineitem.parquet/-/ns-pl/min_rows-l_quantity/select_columns-l_orderkey-l_quantity", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity = (SELECT min(l_quantity) FROM lineitem)")
query("max_rows", "-R/lineitem.parquet/-/ns-pl/max_rows-l_quantity/select_columns-l_orderkey-l_quantity", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)")
query("sample", "-R/orders.parquet/-/ns-pl/sample-100/nrows", "SELECT count(*) AS nrows FROM orders")
query("shuffle", "-R/region.parquet/-/ns-pl/shuffle/head-5", "SELECT * FROM region")
query("unique", "-R/orders.parquet/-/ns-pl/sort-o_orderkey/unique-o_orderstatus/select_columns-o_orderstatus-o_orderkey", "SELECT o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderstatus")
query("rename", "-R/region.parquet/-/ns-pl/rename-r_name-label", "SELECT r_regionkey, r_name AS label FROM region")
query("cast", "-R/region.parquet/-/ns-pl/cast-r_regionkey-string", "SELECT r_regionkey::VARCHAR AS r_regionkey, r_name FROM region")
query("fill_null", "-R/customer.parquet/-/ns-pl/cast-c_mktsegment-int/fill_null-c_mktsegment-7/select_columns-c_custkey-c_mktsegment", "SELECT c_custkey, 7 AS c_mktsegment FROM customer")
query("drop_nulls", "-R/customer.parquet/-/ns-pl/cast-c_mktsegment-int/drop_nulls/nrows", "SELECT 0::BIGINT AS nrows")
query("explode", "-R/embeddings.parquet/-/ns-pl/select_columns-vec_id-embedding/explode-embedding/nrows", "SELECT sum(len(embedding))::BIGINT AS nrows FROM embeddings")
query("group_by", "-R/lineitem.parquet/-/ns-pl/group_by-l_returnflag~_l_linestatus-sum-l_quantity", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum FROM lineitem GROUP BY ALL")


@custom("stream_filter", "SELECT event_id FROM events WHERE event_type = 'click'")
def _(spark, d):
    from .streaming.frames import apply_to_stream

    source = spark.read.parquet(f"{d}/events.parquet").schema
    stream = spark.readStream.schema(source).option("pathGlobFilter", "events.parquet").parquet(d)
    out = apply_to_stream(Engine(spark, d), stream, "ns-pl/eq-event_type-click/select_columns-event_id")
    # The executors write the rows; none come to the driver.
    folder = _shared_folder(spark)
    running = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    running.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


# The tree of elements


def _desk(spark, d, current: int | None = 2) -> tuple[Engine, Desk]:
    e = Engine(spark, d)
    region, nation = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("region", "nation"))
    rows = region.select((F.col("r_regionkey") + 1).cast("long").alias("handle"), F.lit(None).cast("long").alias("parent"), F.col("r_regionkey").cast("int").alias("pos"), F.col("r_name").alias("label"))
    rows = rows.unionByName(nation.select((F.col("n_nationkey") + 100).cast("long").alias("handle"), (F.col("n_regionkey") + 1).cast("long").alias("parent"), F.col("n_nationkey").cast("int").alias("pos"), F.col("n_name").alias("label")))
    return e, Desk(Tree(rows, current))


def tree(name: str, text: str, sql: str) -> None:
    def run(spark, d):
        e, desk = _desk(spark, d)
        value = e.evaluate_immediately(text, desk)
        return value.frame() if not isinstance(value.value, str | None) else values(spark, handle=value.value)

    custom(f"lui_{name}", sql)(run)


tree("children", "ns-lui/children-2", "SELECT n_nationkey + 100::BIGINT AS handle, n_name AS label FROM nation WHERE n_regionkey = 1")
tree("roots", "ns-lui/roots", "SELECT r_regionkey + 1::BIGINT AS handle, r_name AS label FROM region")
tree("first", "ns-lui/first-current", "SELECT (min(n_nationkey) + 100)::VARCHAR AS handle FROM nation WHERE n_regionkey = 1")
tree("last", "ns-lui/last-current", "SELECT (max(n_nationkey) + 100)::VARCHAR AS handle FROM nation WHERE n_regionkey = 1")
tree("parent", "ns-lui/parent-103", "SELECT (n_regionkey + 1)::VARCHAR AS handle FROM nation WHERE n_nationkey = 3")
tree("next", "ns-lui/next-current", "SELECT '3' AS handle")
tree("prev", "ns-lui/prev-current", "SELECT '1' AS handle")
tree("activate", "ns-lui/activate-4", "SELECT '4' AS handle")


def _changed(name: str, text: str, sql: str) -> None:
    def run(spark, d):
        e, desk = _desk(spark, d)
        e.evaluate_immediately(text, desk)
        return desk.tree.df.select("handle", "parent", "pos", "label")

    custom(f"lui_{name}", sql)(run)


_TREE = "SELECT r_regionkey + 1::BIGINT AS handle, NULL::BIGINT AS parent, r_regionkey AS pos, r_name AS label FROM region UNION ALL SELECT n_nationkey + 100::BIGINT, n_regionkey + 1::BIGINT, n_nationkey, n_name FROM nation"
_changed("remove", "ns-lui/remove-current", f"SELECT * FROM ({_TREE}) WHERE handle <> 2 AND (parent IS NULL OR parent <> 2)")
_changed("add", "label-hello/ns-lui/add-after", f"SELECT handle, parent, (CASE WHEN parent IS NULL AND pos >= 2 THEN pos + 1 ELSE pos END)::INTEGER AS pos, label FROM ({_TREE}) UNION ALL SELECT 125, NULL, 2, 'hello'")


@custom("lui_submit", "SELECT count(*) AS nrows FROM region")
def _(spark, d):
    e, desk = _desk(spark, d)
    return e.evaluate_immediately("-R/region.parquet/-/ns-pl/nrows/q/-/ns-lui/submit", desk).frame()


@custom("lui_ui_spec", "SELECT 'spec' AS element, 'x' AS title")
def _(spark, d):
    r = Engine(spark, d).apply("ns-lui/ui_spec", "title: x\n").get()
    return values(spark, element=r["element"], title=r["title"])


@custom("lui_markdown", "SELECT '# x' AS text")
def _(spark, d):
    return values(spark, text=Engine(spark, d).apply("ns-lui/markdown", "# x").get()["text"])


@custom("lui_query_console", "SELECT 'query_console' AS element")
def _(spark, d):
    return values(spark, element=Engine(spark, d).evaluate("ns-lui/query_console").get()["element"])


# Images

WIDTH = 50


def picture(spark: SparkSession, d: str) -> PixelFrame:
    """An image of 50 pixels' width from the table of customers, four channels."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    key = F.col("c_custkey")
    n = c.agg(F.max("c_custkey")).first()[0] + 1
    df = c.filter(key < n // WIDTH * WIDTH).select(F.lit(0).cast("long").alias("img"), (key % WIDTH).cast("int").alias("x"), F.floor(key / WIDTH).cast("int").alias("y"), F.pmod(F.col("c_acctbal").cast("int"), F.lit(256)).cast("int").alias("c0"), (key * 7 % 256).cast("int").alias("c1"), (F.col("c_nationkey") * 10 % 256).cast("int").alias("c2"), (F.lit(255) - key % 3).cast("int").alias("c3"))
    return PixelFrame(df, WIDTH, n // WIDTH, "Rgba8")


_P = f"""m AS (SELECT (max(c_custkey) + 1) // {WIDTH} AS h FROM customer),
p AS (SELECT 0::BIGINT AS img, (c_custkey % {WIDTH})::INTEGER AS x, (c_custkey // {WIDTH})::INTEGER AS y, (((CAST(trunc(c_acctbal) AS INTEGER) % 256) + 256) % 256)::INTEGER AS c0,
    (c_custkey * 7 % 256)::INTEGER AS c1, (c_nationkey * 10 % 256)::INTEGER AS c2, (255 - c_custkey % 3)::INTEGER AS c3 FROM customer, m WHERE c_custkey < h * {WIDTH}),
l AS (SELECT img, x, y, ((2126 * c0 + 7152 * c1 + 722 * c2) // 10000)::INTEGER AS c0 FROM p)"""
_RGB = ("c0", "c1", "c2")


def image(name: str, text: str, sql: str | None, with_: str = "") -> None:
    def run(spark, d):
        return Engine(spark, d).apply(f"ns-img/{text}", picture(spark, d)).frame()

    custom(f"img_{name}", f"WITH {_P}{', ' + with_ if with_ else ''} {sql}" if sql else None)(run)


def _each(f: str, rest: str = "c3") -> str:
    return ", ".join(f"({f.replace('@', c)})::INTEGER AS {c}" for c in _RGB) + f", {rest}"


def _moved(x: str, y: str) -> str:
    return f"SELECT img, ({x})::INTEGER AS x, ({y})::INTEGER AS y, c0, c1, c2, c3 FROM p, m"


image("gray", "gray", "SELECT l.img, l.x, l.y, l.c0, p.c3 AS c1 FROM l JOIN p USING (x, y)")
image("invert", "invert", f"SELECT img, x, y, {_each('255 - @')} FROM p")
image("brighten", "brighten-~30", f"SELECT img, x, y, {_each('greatest(0, least(255, @ - 30))')} FROM p")
image("contrast", "contrast-25.0", f"SELECT img, x, y, {_each('floor(greatest(0.0, least(255.0, ((@ / 255.0::DOUBLE - 0.5::DOUBLE) * 1.5625::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE + 1e-6::DOUBLE)))')} FROM p")
image("gamma", "gamma-2.2", f"SELECT img, x, y, {_each('floor(pow(@ / 255.0::DOUBLE, 1 / 2.2::DOUBLE) * 255 + 1e-9::DOUBLE)')} FROM p")
image("huerot", "huerot-90", "SELECT img, x, y, " + ", ".join(f"floor(greatest(0.0, least(255.0, {' + '.join(f'c{j} * ({w})::DOUBLE' for j, w in enumerate(row))} + 1e-9::DOUBLE)))::INTEGER AS c{i}" for i, row in enumerate([[0.213 - 0.213, 0.715 - 0.715, 0.072 + 0.928], [0.213 + 0.143, 0.715 + 0.140, 0.072 - 0.283], [0.213 - 0.787, 0.715 + 0.715, 0.072 + 0.072]])) + ", c3 FROM p")
image(
    "saturate", "saturate-0.5",
    "SELECT img, x, y, " + ", ".join(f"greatest(0, floor((CASE WHEN h < 1 THEN {a} WHEN h < 2 THEN {b} WHEN h < 3 THEN {c} WHEN h < 4 THEN {d} WHEN h < 5 THEN {e} ELSE {f} END + hi - c) * 255 + 1e-9::DOUBLE))::INTEGER AS c{i}" for i, (a, b, c, d, e, f) in enumerate((("c", "t", "0", "0", "t", "c"), ("t", "c", "c", "t", "0", "0"), ("0", "0", "t", "c", "c", "t")))) + ", c3 FROM s3",
    """s1 AS (SELECT *, c0 / 255.0::DOUBLE AS r, c1 / 255.0::DOUBLE AS g, c2 / 255.0::DOUBLE AS b, greatest(c0, c1, c2) / 255.0::DOUBLE AS hi, least(c0, c1, c2) / 255.0::DOUBLE AS lo FROM p),
s2 AS (SELECT *, CASE WHEN hi = lo THEN 0 WHEN hi = r THEN (g - b) / (hi - lo) WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END AS h, CASE WHEN hi = 0 THEN 0 ELSE hi * least((hi - lo) / hi * 0.5::DOUBLE, 1) END AS c FROM s1),
s3 AS (SELECT *, c * (1 - abs((h - 2 * trunc(h / 2)) - 1)) AS t FROM s2)""",
)
image("color_format", "color_format-luma_alpha8", "SELECT l.img, l.x, l.y, l.c0, p.c3 AS c1 FROM l JOIN p USING (x, y)")
image("color_format16", "color_format-rgb16", "SELECT img, x, y, c0 * 257 AS c0, c1 * 257 AS c1, c2 * 257 AS c2 FROM p")
image("rot90", "rot90", _moved("h - 1 - y", "x"))
image("rot180", "rot180", _moved(f"{WIDTH - 1} - x", "h - 1 - y"))
image("rot270", "rot270", _moved("y", f"{WIDTH - 1} - x"))
image("fliph", "fliph", _moved(f"{WIDTH - 1} - x", "y"))
image("flipv", "flipv", _moved("x", "h - 1 - y"))
image("crop", "crop-10-1-20-2", "SELECT img, x - 10 AS x, y - 1 AS y, c0, c1, c2, c3 FROM p WHERE x BETWEEN 10 AND 29 AND y BETWEEN 1 AND 2")
image("resize_nearest", "resize-20-7-nearest", "SELECT img, i::INTEGER AS x, j::INTEGER AS y, c0, c1, c2, c3 FROM range(20) a(i), range(7) b(j), m JOIN p ON p.x = floor((i + 0.5::DOUBLE) * 50 / 20) AND p.y = floor((j + 0.5::DOUBLE) * h / 7)")
for _m in ("triangle", "catmullrom", "gaussian", "lanczos3"):
    image(f"resize_{_m}", f"resize-20-7-{_m}", None)
image("resize_by", "resize_by-50.0-nearest", "SELECT img, i::INTEGER AS x, j::INTEGER AS y, c0, c1, c2, c3 FROM range(25) a(i), m, range((SELECT floor(h * 0.5::DOUBLE + 0.5::DOUBLE)::BIGINT FROM m)) b(j) JOIN p ON p.x = floor((i + 0.5::DOUBLE) * 2) AND p.y = floor((j + 0.5::DOUBLE) * h / floor(h * 0.5::DOUBLE + 0.5::DOUBLE))")
image("thumb", "thumb-25-1000000", f"SELECT img, (x // 2)::INTEGER AS x, b AS y, {', '.join(f'floor(avg(c{i}) + 0.5::DOUBLE + 1e-9::DOUBLE)::INTEGER AS c{i}' for i in range(4))} FROM q GROUP BY ALL", "k AS (SELECT floor(h * 0.5::DOUBLE + 0.5::DOUBLE)::BIGINT AS n, h FROM m), q AS (SELECT p.*, j::INTEGER AS b FROM k, range((SELECT n FROM k)) r(j) JOIN p ON p.y >= j * h // n AND p.y < greatest(j * h // n + 1, (j + 1) * h // n))")
image(
    "rotate", "rotate-30.0",
    "SELECT s.img, s.x, s.y, " + ", ".join(f"(CASE WHEN count(p.c0) = 4 THEN floor(sum(p.c{i} * w) + 1e-6::DOUBLE) ELSE 0 END)::INTEGER AS c{i}" for i in range(4)) + " FROM s LEFT JOIN p ON p.x = qx AND p.y = qy GROUP BY s.img, s.x, s.y",
    f"""t AS (SELECT img, x, y, (x - 25.0::DOUBLE) * cos(radians(-30)) + (y - h / 2) * sin(radians(-30)) + 25.0::DOUBLE AS sx, (y - h / 2) * cos(radians(-30)) - (x - 25.0::DOUBLE) * sin(radians(-30)) + h / 2 AS sy FROM p, m),
s AS (SELECT img, x, y, floor(sx) + i AS qx, floor(sy) + j AS qy, (CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w FROM t, range(2) a(i), range(2) b(j))""",
)


def _near(radius: int, table: str = "l") -> str:
    """Each pixel with those within a square around it; edges repeat."""
    return f"n AS (SELECT a.img, a.x, a.y, dx, dy, q.* EXCLUDE (img, x, y) FROM {table} a, m, range({-radius}, {radius + 1}) u(dx), range({-radius}, {radius + 1}) v(dy) JOIN {table} q ON q.x = greatest(0, least({WIDTH - 1}, a.x + dx)) AND q.y = greatest(0, least(h - 1, a.y + dy)))"


image("erode", "erode-1", "SELECT img, x, y, min(c0) AS c0 FROM n GROUP BY ALL", _near(1))
image("dilate", "dilate-2", "SELECT img, x, y, max(c0) AS c0 FROM n GROUP BY ALL", _near(2))
image("opening", "opening-1", "SELECT img, x, y, max(c0) AS c0 FROM n GROUP BY ALL", "e AS (WITH " + _near(1) + " SELECT img, x, y, min(c0) AS c0 FROM n GROUP BY ALL), " + _near(1, "e"))
image("closing", "closing-1", "SELECT img, x, y, min(c0) AS c0 FROM n GROUP BY ALL", "e AS (WITH " + _near(1) + " SELECT img, x, y, max(c0) AS c0 FROM n GROUP BY ALL), " + _near(1, "e"))
image("boxfilt", "boxfilt-2", "SELECT img, x, y, (sum(c0) // 25)::INTEGER AS c0 FROM n GROUP BY ALL", _near(2))
image("median", "median-1", f"SELECT img, x, y, {', '.join(f'quantile_disc(c{i}, 0.5) AS c{i}' for i in range(4))} FROM n GROUP BY ALL", _near(1, "p"))
image("sharpen", "sharpen", f"SELECT img, x, y, {', '.join(f'greatest(0, least(255, sum(c{i} * (CASE WHEN dx = 0 AND dy = 0 THEN 5 WHEN dx = 0 OR dy = 0 THEN -1 ELSE 0 END))))::INTEGER AS c{i}' for i in range(4))} FROM n GROUP BY ALL", _near(1, "p"))
image("sobel", "sobel", "SELECT img, x, y, least(255, floor(sqrt(g * g + k * k)))::INTEGER AS c0 FROM (SELECT img, x, y, sum(c0 * dx * (2 - abs(dy)))::DOUBLE AS g, sum(c0 * dy * (2 - abs(dx)))::DOUBLE AS k FROM n GROUP BY ALL)", _near(1))
image(
    "blur", "blur-1.0", f"SELECT img, b AS x, y, {', '.join(f'floor(greatest(0.0, least(255.0, sum(c{i} * w))) + 0.5::DOUBLE + 1e-9::DOUBLE)::INTEGER AS c{i}' for i in range(4))} FROM v JOIN wx ON wx.a = v.x GROUP BY ALL",
    ", ".join(f"{t} AS (SELECT i::INTEGER AS b, j::INTEGER AS a, exp(-((j - i) * (j - i)) / 2.0::DOUBLE) / sum(exp(-((j - i) * (j - i)) / 2.0::DOUBLE)) OVER (PARTITION BY i) AS w FROM range({n}) q(i), range({n}) r(j) WHERE j >= floor(i + 0.5 - 2.0) AND j < ceil(i + 0.5 + 2.0))" for t, n in (("wx", str(WIDTH)), ("wy", "(SELECT h FROM m)")))
    + f", v AS (SELECT img, x, b AS y, {', '.join(f'sum(c{i} * w) AS c{i}' for i in range(4))} FROM p JOIN wy ON wy.a = p.y GROUP BY ALL)",
)
image("canny", "canny-20.0-60.0", None)


def _drawn(test: str, color: tuple[int, int, int, int]) -> str:
    return "SELECT img, x, y, " + ", ".join(f"(CASE WHEN {test} THEN {v} ELSE c{i} END)::INTEGER AS c{i}" for i, v in enumerate(color)) + " FROM p"


image("draw_line", "draw_line-2-0-40-0-red", _drawn("y = 0 AND x BETWEEN 2 AND 40", (255, 0, 0, 255)))
image("draw_line_diagonal", "draw_line-0-0-2-2-0x01020304", _drawn("x = y AND x <= 2", (1, 2, 3, 4)))
image("draw_rect", "draw_rect-5-0-10-3-blue", _drawn("x BETWEEN 5 AND 14 AND y BETWEEN 0 AND 2 AND (x IN (5, 14) OR y IN (0, 2))", (0, 0, 255, 255)))
image("draw_filled_rect", "draw_filled_rect-~5-0-10-3-teal", _drawn("x BETWEEN -5 AND 4 AND y BETWEEN 0 AND 2", (0, 128, 128, 255)))
image("draw_circle", "draw_circle-20-1-2-white", _drawn("(x - 20) * (x - 20) + (y - 1) * (y - 1) IN (4, 5)", (255, 255, 255, 255)))
image("draw_filled_circle", "draw_filled_circle-20-1-2-0xff8000", _drawn("(x - 20) * (x - 20) + (y - 1) * (y - 1) <= 5", (255, 128, 0, 255)))
for _name, _form in (("to_png", "to_png/from_bytes"), ("from_format", "to_png/from_format-png"), ("to_bmp", "to_bmp/from_bytes")):
    image(_name, _form, "SELECT * FROM p")


def _facts(name: str, text: str, sql: str, finish=lambda v: v) -> None:
    custom(f"img_{name}", f"WITH {_P} {sql}")(lambda spark, d: values(spark, value=finish(Engine(spark, d).apply(f"ns-img/{text}", picture(spark, d)).get())))


_facts("dims", "dims", "SELECT '50x' || h AS value FROM m")
_facts("width", "width", "SELECT 50::BIGINT AS value")
_facts("height", "height", "SELECT h::BIGINT AS value FROM m")
_facts("colortype", "color_format-luma_alpha8/colortype", "SELECT 'La8' AS value")
_facts("to_dataurl", "to_dataurl", "SELECT 'data:image/png;base64,iVBORw0KGgo' AS value", lambda v: v[:33])
_facts("to_jpeg", "to_jpeg-90/from_bytes/dims", "SELECT '50x' || h AS value FROM m")
_facts("to_gif", "to_gif/from_bytes/dims", "SELECT '50x' || h AS value FROM m")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
