import math
import random
from datetime import UTC, date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillspark.engine import Engine
from quillspark.errors import EngineError
from quillspark.functions.literals import parse_ascending, parse_boolean, parse_date, parse_datetime, separator
from quillspark.sources.store import MemoryStore


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, MemoryStore())


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, 1.5, "b", True, date(2024, 1, 15), datetime(2024, 1, 15, tzinfo=UTC), Decimal("1.20"), 1, 1), (2, None, "a", None, None, None, None, 2, None), (3, float("nan"), None, False, date(2023, 5, 1), datetime(2023, 5, 1, tzinfo=UTC), Decimal("3.00"), 3, 127), (4, math.inf, "c-d /~é", True, date(2025, 1, 1), datetime(2025, 1, 1, tzinfo=UTC), Decimal("-1.00"), 4, -128)]
    return spark.createDataFrame(rows, "i long, x double, s string, b boolean, d date, t timestamp, m decimal(10,2), I int, y tinyint").coalesce(1)


def rows(engine, df, q):
    return [tuple(r) for r in engine.apply("ns-pl/" + q, df).frame().collect()]


def test_filters(engine, edge):
    f = lambda q: [r[0] for r in rows(engine, edge, q + "/select_columns-i")]
    assert f("eq-i-2") == [2] and f("ne-i-2") == [1, 3, 4] and f("gt-i-2") == [3, 4] and f("gte-i-2") == [2, 3, 4] and f("lt-i-2") == [1] and f("lte-i-2") == [1, 2]
    assert f("ne-s-b") == [2, 4], "nulls are dropped"
    assert f("eq-s-c~_d~.~/~~é".replace("é", "")) == []
    assert f("gt-x-1") == [1, 3, 4], "NaN is greater than all"
    assert f("eq-x-NaN") == [3] and f("eq-x-inf") == [4]
    assert f("eq-b-t") == [1, 4] and f("eq-b-0") == [3]
    assert f("eq-d-20240115") == [1] and f("gte-d-2024_01_15") == [1, 4] and f("lt-d-2024~01~15") == [3]
    assert f("gt-t-2024~01~14") == [1, 4] and f("lt-m-2") == [1, 4] and f("eq-y-~128") == [4]
    assert f("gt-i-1/lt-i-4") == [2, 3]
    assert f("eq-I-4") == [4] and f("isnull-s") == [3] and f("notnull-s") == [1, 2, 4] and f("contains-s-d") == [4]
    for wrong in ("eq-i-1.5", "eq-y-128", "eq-b-yes", "eq-d-x", "eq-z-1", "eq-x-abc", "eq-i-"):
        with pytest.raises(EngineError):
            f(wrong)


def test_order(engine, edge):
    f = lambda q: [r[0] for r in rows(engine, edge, q + "/select_columns-i")]
    assert f("sort-s") == [3, 2, 1, 4] and f("sort-s-f") == [3, 4, 1, 2], "nulls come first"
    assert f("sort-x") == [2, 1, 4, 3] and f("sort-b") == [2, 3, 1, 4]
    assert f("sort-i-f/sort-b") == [2, 3, 4, 1], "stable"
    assert f("head-2") == [1, 2] and f("tail-2") == [3, 4] and f("slice-1-2") == [2, 3] and f("head") == [1, 2, 3, 4]
    assert f("head-~1") == [] and f("tail-0") == [] and f("slice-~3-2") == [1, 2] and f("slice-9-2") == []
    assert f("sort-i-f/tail-3/head-1") == [3] and f("sort-i-f/select_columns-s-i/head-1") == [4]
    assert f("tail-3/sort-i-f/slice-1-1") == [3]
    for wrong in ("sort-z", "sort-i-maybe", "head-x", "slice-1"):
        with pytest.raises(EngineError):
            f(wrong)


def test_columns(engine, edge):
    cols = lambda q: engine.apply("ns-pl/" + q, edge).frame().columns
    assert cols("select_columns-x-i") == ["x", "i"] and cols("select_columns-x~_i") == ["x", "i"] and cols("drop_columns-x~_i-I") == ["s", "b", "d", "t", "m", "y"]
    assert cols("select_columns-I-i") == ["I", "i"], "names are exact"
    for wrong in ("select_columns-q", "select_columns-i-i", "drop_columns-q", "select_columns-X"):
        with pytest.raises(EngineError):
            cols(wrong)


def test_aggregates(engine, edge, spark):
    one = lambda q: engine.apply("ns-pl/" + q, edge).frame().first().asDict()
    s = one("select_columns-i-b-I-y/sum")
    assert s == {"i": 10, "b": 2, "I": 10, "y": 0}
    assert one("select_columns-i-s-x-b/count") == {"i": 4, "s": 3, "x": 3, "b": 3}
    assert one("select_columns-x-s-i/min") == {"x": 1.5, "s": "a", "i": 1} and one("select_columns-x-s/max") == {"x": math.inf, "s": "c-d /~é"}
    assert one("select_columns-i/median") == {"i": 2.5} and one("select_columns-i-s/mean") == {"i": 2.5} and round(one("select_columns-i/std")["i"], 6) == 1.290994
    assert list(one("select_columns-s-i/describe")) == ["i_mean", "i_min", "i_max", "i_std"]
    assert one("shape") == {"ncols": 9, "nrows": 4} and one("nrows") == {"nrows": 4} and engine.apply("ns-pl/ncols", edge).get() == 9
    schema = [tuple(r) for r in engine.apply("ns-pl/schema", edge).frame().collect()]
    assert ("y", "Int8") in schema and ("m", "Decimal(10, 2)") in schema and schema == sorted(schema)
    with pytest.raises(EngineError):
        one("select_columns-s/describe")
    empty = spark.createDataFrame([], "i int, x double, s string")
    got = engine.apply("ns-pl/sum", empty).frame().first().asDict()
    assert got == {"i": 0, "x": 0.0}
    assert engine.apply("ns-pl/min", empty).frame().first().asDict() == {"i": None, "x": None, "s": None}
    assert engine.apply("ns-pl/std", spark.createDataFrame([(1,)], "i int")).frame().first()[0] is None
    nan = spark.createDataFrame([(float("nan"),), (None,)], "x double")
    assert math.isnan(engine.apply("ns-pl/max", nan).frame().first()[0])


def test_csv(engine):
    text = 'name,when,n,x\nA,2024-01-01,1,1.5\n"B, ""b""",x y,2,\n'
    df = engine.apply("ns-pl/from_csv", text).frame()
    assert dict(df.dtypes) == {"name": "string", "when": "string", "n": "bigint", "x": "double"}
    assert [tuple(r) for r in df.collect()] == [("A", "2024-01-01", 1, 1.5), ('B, "b"', "x y", 2, None)]
    assert engine.apply("ns-pl/from_csv/to_csv/to_text", text).get().splitlines()[2] == '"B, ""b""",x y,2,'
    for sep, word in (("\t", "tab"), (";", "semicolon"), ("|", "pipe")):
        assert engine.apply(f"ns-pl/from_csv-{word}", f"a{sep}b\n1{sep}2\n").frame().first().asDict() == {"a": 1, "b": 2}
    assert engine.apply("ns-pl/from_csv/sort-a-f/to_csv/to_text", "a\n1\n2\n").get() == "a\n2\n1\n"
    assert engine.apply("ns-pl/from_csv/gt-a-9/to_csv/to_text", "a\n1\n2\n").get() == "a\n"
    with pytest.raises(EngineError):
        engine.apply("ns-pl/from_csv", "").frame()
    assert engine.apply("ns-pl/head-1", b"a\n1\n2\n").frame().count() == 1


def test_literals():
    assert parse_date("2024_01_05") == parse_date("20240105") == parse_date(" 2024-01-05 ") == date(2024, 1, 5)
    assert parse_datetime("20240105123456") == parse_datetime("2024-01-05T12:34:56") == parse_datetime("2024-01-05 12:34:56") == datetime(2024, 1, 5, 12, 34, 56, tzinfo=UTC)
    assert parse_datetime("2024-01-05 12:34").minute == 34 and parse_boolean("T") and not parse_boolean("0") and parse_ascending("") and separator("tab") == "\t" and separator(";") == ";"
    for f, x in ((parse_date, "2024-13-01"), (parse_boolean, "yes"), (separator, "ab"), (parse_datetime, "noon")):
        with pytest.raises(EngineError):
            f(x)


def test_extensions(engine, edge, spark):
    f = lambda q: rows(engine, edge, q)
    assert f("unique-b/select_columns-i/sort-i") == [(1,), (2,), (3,)]
    assert f("fill_null-s-zz/eq-s-zz/select_columns-i") == [(3,)] and f("drop_nulls-x-s/select_columns-i") == [(1,), (4,)]
    assert f("min_rows-i/select_columns-i") == [(1,)] and f("max_rows-i/select_columns-i") == [(4,)]
    assert sorted(f("shuffle/select_columns-i")) == [(1,), (2,), (3,), (4,)] and f("cast-s-int/select_columns-s/count") == [(0,)]
    assert sorted(f("group_by-b-count"), key=str) == [(False, 1), (None, 1), (True, 2)]
    arrays = spark.createDataFrame([(1, [1, 2]), (2, [])], "k int, a array<int>").coalesce(1)
    assert rows(engine, arrays, "explode-a") == [(1, 1), (1, 2), (2, None)]


def test_plan_is_one_scan(spark):
    e = Engine(spark, "/root/testdata/sf0.001")
    from quillspark.queries import FLAGSHIP

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = e.frame(FLAGSHIP)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(l_returnflag,A)" in plan and "GreaterThan(l_quantity,45.0)" in plan and "TakeOrderedAndProject" in plan
    assert "l_comment" not in plan and "l_shipdate" not in plan.split("ReadSchema")[1]
    summed = e.frame("-R/lineitem.parquet/-/ns-pl/sort-l_quantity/select_columns-l_quantity/sum")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in summed and "row_index" not in summed


def test_median_of_any_values(spark, engine):
    """Exact whatever the values: ties, infinities, NaN, few or no rows, and quantiles that miss the middle."""
    from quillspark.operators import frame_ops
    from quillspark.operators.frame import from_scan

    rng = random.Random(2)
    for values in ([], [None], [3.0], [1.0, 2.0], [1.0, None, 5.0], [0.0] * 50 + [1.0] * 50, [float("inf"), float("-inf")], [float("inf")] * 3, [1.0, float("nan"), float("nan")], [rng.random() for _ in range(2001)], [float(rng.randrange(5)) for _ in range(2000)]):
        df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "a double, b int").repartition(3)
        want = df.agg(F.median("a").alias("a"), F.median("b").alias("b")).first()
        for bracket in (frame_ops.BRACKET, -0.4):  # the second one is beside the middle
            kept, frame_ops.BRACKET = frame_ops.BRACKET, bracket
            try:
                got = engine.apply("ns-pl/median", from_scan(df)).frame().first()
            finally:
                frame_ops.BRACKET = kept
            assert str(got) == str(want), values[:5]
    plan = engine.apply("ns-pl/median", from_scan(df)).frame()._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan, "no aggregate keeps all values"
