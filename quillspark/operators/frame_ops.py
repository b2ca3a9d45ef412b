"""The commands on frames, in namespace pl."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.literals import literal, parse_ascending, separator, type_name
from ..plans.registry import BUILTIN, Param
from ..sources.formats import as_frame, csv_frame, csv_value
from .frame import OrderedFrame, column, from_scan

NS = "pl"
#: A median is looked for in this share of the values on each side of the middle, by quantiles of this accuracy.
BRACKET, ACCURACY = 0.0005, 10_000


def pl(name: str, *params: Param, **more):
    """Registers a command that gets the input as a frame."""

    def register(f):
        def run(context, state, *arguments):
            return f(as_frame(context, state), *arguments)

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        run.__wrapped__ = f
        BUILTIN.command(name, *params, ns=NS, **more)(run)
        return f

    return register


def _names(parts: list[str]) -> list[str]:
    return [n.strip() for p in parts for n in p.split("-")]


@BUILTIN.command("from_csv", Param("separator", default=""), ns=NS)
def from_csv(context, state, sep: str):
    """Text, bytes or a file of comma-separated values as a frame."""
    return csv_frame(context, state, separator(sep) if sep else None)


@pl("to_csv")
def to_csv(frame: OrderedFrame):
    """The frame as text: one row, made by the executors, in order."""
    return csv_value(frame)


@pl("select_columns", Param("columns", multiple=True))
def select_columns(frame: OrderedFrame, parts: list[str]):
    """The named columns, in this order. Both a-b and a~_b name two."""
    return frame.select(*_names(parts))


@pl("drop_columns", Param("columns", multiple=True))
def drop_columns(frame: OrderedFrame, parts: list[str]):
    """All columns but the named ones, which must exist."""
    names = _names(parts)
    frame.check(*names)
    return frame.select(*(c for c in frame.columns if c not in names))


def _comparison(name: str, compare, doc: str) -> None:
    def run(frame: OrderedFrame, name_: str, value: str):
        test = compare(frame.col(name_), literal(value, frame.type_of(name_)))
        return frame.apply(lambda df: df.filter(test))

    run.__doc__ = f"Rows whose column is {doc} the value; rows with a null in it go."
    pl(name, Param("column"), Param("value"))(run)


for _name, _compare, _doc in (("eq", operator.eq, "equal to"), ("ne", operator.ne, "unequal to"), ("gt", operator.gt, "greater than"), ("gte", operator.ge, "at least"), ("lt", operator.lt, "less than"), ("lte", operator.le, "at most")):
    _comparison(_name, _compare, _doc)


@pl("sort", Param("column"), Param("ascending", default="t"))
def sort(frame: OrderedFrame, name: str, ascending: str):
    """Rows by a column, nulls first in either direction; equal ones keep their order."""
    return frame.sort(frame.col(name), parse_ascending(ascending))


@pl("head", Param("n", "int", 5))
def head(frame: OrderedFrame, n: int):
    """The first rows; none if n is negative."""
    return frame.head(n)


@pl("tail", Param("n", "int", 5))
def tail(frame: OrderedFrame, n: int):
    """The last rows, in order; none if n is negative."""
    return frame.tail(n)


@pl("slice", Param("offset", "int"), Param("length", "int"))
def slice_(frame: OrderedFrame, offset: int, length: int):
    """Rows from an offset on; negative numbers count as 0."""
    return frame.slice(offset, length)


def _numeric(frame: OrderedFrame) -> list[str]:
    return [f.name for f in frame.df.schema if f.name in frame.columns and isinstance(f.dataType, T.NumericType)]


def _orderable(frame: OrderedFrame) -> list[str]:
    return [f.name for f in frame.df.schema if f.name in frame.columns and not isinstance(f.dataType, T.MapType | T.VariantType | T.NullType)]


def _one_row(frame: OrderedFrame, columns: list[Column]) -> OrderedFrame:
    if not columns:
        raise EngineError("argument", "there is no column to aggregate")
    return from_scan(frame.visible().agg(*columns))


def _sum(c: Column, kind: T.DataType) -> Column:
    """The sum of nothing is 0; integers are summed as 64-bit ones, and overflow is an error."""
    total = F.sum(c.cast("int") if isinstance(kind, T.BooleanType) else c)
    return F.coalesce(total, F.lit(0).cast("double" if isinstance(kind, T.FloatType | T.DoubleType) else "bigint" if not isinstance(kind, T.DecimalType) else kind))


def _extreme(f, c: Column, kind: T.DataType) -> Column:
    """NaN counts only if there is nothing else."""
    return F.coalesce(f(F.when(~F.isnan(c), c)), f(c)) if isinstance(kind, T.FloatType | T.DoubleType) else f(c)


def _aggregate(name: str, columns, make, doc: str) -> None:
    def run(frame: OrderedFrame):
        return _one_row(frame, [make(column(c), frame.type_of(c)).alias(c) for c in columns(frame)])

    run.__doc__ = doc
    pl(name)(run)


_aggregate("sum", lambda f: [c for c in f.columns if isinstance(f.type_of(c), T.NumericType | T.BooleanType)], _sum, "Sums of the numeric columns; of none, 0.")
_aggregate("mean", _numeric, lambda c, _: F.avg(c).cast("double"), "Means of the numeric columns.")
_aggregate("min", _orderable, lambda c, k: _extreme(F.min, c, k), "Least values of all columns.")
_aggregate("max", _orderable, lambda c, k: _extreme(F.max, c, k), "Greatest values of all columns.")
_aggregate("std", _numeric, lambda c, _: F.stddev_samp(c), "Sample standard deviations of the numeric columns; null for a single row.")
_aggregate("count", lambda f: f.columns, lambda c, _: F.count(c), "How many values of each column aren't null.")


@pl("median")
def median(frame: OrderedFrame):
    """Exact medians of the numeric columns, between the middle two if they are two.

    No task holds all values of a column: approximate quantiles give a narrow bracket of values around the middle, rows
    below and in it are counted, and only the values of the part that has the middle ranks are put in order. How good the
    quantiles are decides how narrow that part is; the counts make it the right one. The rows are read three times.
    """
    names = _numeric(frame)
    if not names:
        raise EngineError("argument", "there is no column to aggregate")
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), column(c).cast("double").alias("v")) for i, c in enumerate(names))))
    values = frame.visible().select(pairs.alias("p")).select("p.i", "p.v").filter(F.col("v").isNotNull())
    around = [0.5 - BRACKET, 0.5 + BRACKET]
    v, low, high = F.col("v"), F.col("b")[0], F.col("b")[1]
    # One row a column.
    bracket = F.broadcast(values.groupBy("i").agg(F.percentile_approx("v", around, ACCURACY).alias("b")))
    counted = values.join(bracket, "i").groupBy("i").agg(F.first("b").alias("b"), F.count_if(v < low).alias("below"), F.count_if(v <= high).alias("upto"), F.count(F.lit(1)).alias("n"))
    middle = {"k1": F.floor((F.col("n") - 1) / 2), "k2": F.floor(F.col("n") / 2)}
    counted = counted.withColumns(middle)

    def part(k: str) -> Column:
        return F.when(F.col(k) < F.col("below"), 0).when(F.col(k) < F.col("upto"), 1).otherwise(2)

    counted = counted.select("*", part("k1").alias("p1"), part("k2").alias("p2"))
    before = F.when(F.col("p1") == 0, F.lit(0)).when(F.col("p1") == 1, F.col("below")).otherwise(F.col("upto"))
    mine = F.when(v < low, 0).when(v <= high, 1).otherwise(2)
    near = values.join(F.broadcast(counted.select("*", before.alias("before"))), "i").filter((mine >= F.col("p1")) & (mine <= F.col("p2")))
    kept = near.groupBy("i", "v").agg(F.count(F.lit(1)).alias("times"), *(F.first(c).alias(c) for c in ("k1", "k2", "before")))
    upto = F.col("before") + F.sum("times").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ends = kept.select("i", "v", "k1", "k2", upto.alias("upto")).groupBy("i").agg(*(F.min(F.when(F.col("upto") > F.col(k), v)).alias(k) for k in ("k1", "k2")))
    found = ends.select("i", F.when(F.col("k1") == F.col("k2"), F.col("k1")).otherwise(F.col("k1") * 0.5 + F.col("k2") * 0.5).alias("m"))
    return from_scan(found.agg(*(F.max(F.when(F.col("i") == i, F.col("m"))).alias(c) for i, c in enumerate(names))))


@pl("describe")
def describe(frame: OrderedFrame):
    """Mean, min, max and std of each numeric column, in one row."""
    columns = _numeric(frame)
    if not columns:
        raise EngineError("argument", "there is no numeric column")
    out = []
    for c in columns:
        kind, x = frame.type_of(c), column(c)
        out += [F.avg(x).cast("double").alias(f"{c}_mean"), _extreme(F.min, x, kind).alias(f"{c}_min"), _extreme(F.max, x, kind).alias(f"{c}_max"), F.stddev_samp(x).alias(f"{c}_std")]
    return _one_row(frame, out)


@pl("shape")
def shape(frame: OrderedFrame):
    """Numbers of columns and rows."""
    return from_scan(frame.visible().agg(F.count(F.lit(1)).alias("nrows")).select(F.lit(len(frame.columns)).cast("bigint").alias("ncols"), "nrows"))


@pl("nrows")
def nrows(frame: OrderedFrame):
    """The number of rows."""
    return from_scan(frame.visible().agg(F.count(F.lit(1)).alias("nrows")))


@pl("ncols")
def ncols(frame: OrderedFrame):
    """The number of columns; no job runs."""
    return len(frame.columns)


@pl("schema")
def schema(frame: OrderedFrame):
    """Names and types of the columns, by name; no job runs."""
    rows = sorted((f.name, type_name(f.dataType)) for f in frame.df.schema if f.name in frame.columns)
    return from_scan(frame.df.sparkSession.createDataFrame(rows, "name string, dtype string"))


# Extensions: what the language's documents plan for later.


def _words(name: str, test: str, doc: str) -> None:
    def run(frame: OrderedFrame, name_: str, value: str):
        return frame.apply(lambda df: df.filter(getattr(frame.col(name_).cast("string"), test)(F.lit(value))))

    run.__doc__ = doc
    pl(name, Param("column"), Param("value"))(run)


_words("contains", "contains", "Rows whose column has the text in it.")
_words("startswith", "startswith", "Rows whose column begins with the text.")
_words("endswith", "endswith", "Rows whose column ends with the text.")


@pl("isnull", Param("column"))
def isnull(frame: OrderedFrame, name: str):
    """Rows with a null in the column."""
    return frame.apply(lambda df: df.filter(frame.col(name).isNull()))


@pl("notnull", Param("column"))
def notnull(frame: OrderedFrame, name: str):
    """Rows without a null in the column."""
    return frame.apply(lambda df: df.filter(frame.col(name).isNotNull()))


def _extreme_rows(frame: OrderedFrame, name: str, f) -> OrderedFrame:
    best = frame.visible().agg(f(frame.col(name)).alias("__qbest"))
    return frame.apply(lambda df: df.join(F.broadcast(best), frame.col(name) == F.col("__qbest"), "left_semi"))  # one row is broadcast


@pl("min_rows", Param("column"))
def min_rows(frame: OrderedFrame, name: str):
    """All rows with the column's least value."""
    return _extreme_rows(frame, name, F.min)


@pl("max_rows", Param("column"))
def max_rows(frame: OrderedFrame, name: str):
    """All rows with the column's greatest value."""
    return _extreme_rows(frame, name, F.max)


@pl("sample", Param("percent", "float"), Param("seed", "int", 42))
def sample(frame: OrderedFrame, percent: float, seed: int):
    """About so many percent of the rows."""
    return frame.apply(lambda df: df.sample(fraction=min(1.0, max(0.0, percent / 100)), seed=seed))


@pl("shuffle", Param("seed", "int", 42))
def shuffle(frame: OrderedFrame, seed: int):
    """Rows in another order, the same for a seed and an input."""
    return frame.sort(F.xxhash64(*map(column, (*frame.columns, *frame.hidden)), F.lit(seed)), True)


@pl("unique", Param("columns", multiple=True))
def unique(frame: OrderedFrame, parts: list[str]):
    """The first row of each value of the named columns, or of all."""
    names = _names(parts) if parts else frame.columns
    frame.check(*names)
    others = [c for c in frame.df.columns if c not in names]
    if not others:
        return frame.with_df(frame.df.distinct())
    first = F.min_by(F.struct(*map(column, others)), F.struct(*map(column, frame.hidden))) if frame.hidden else F.first(F.struct(*map(column, others)))
    df = frame.df.groupBy(*map(column, names)).agg(first.alias("__qfirst"))
    return frame.with_df(df.select(*map(column, names), "__qfirst.*").select(*map(column, frame.df.columns)))


@pl("explode", Param("column"))
def explode(frame: OrderedFrame, name: str):
    """A row for each item of an array column."""
    return frame.apply(lambda df: df.withColumn(name, F.explode_outer(frame.col(name))))


@pl("rename", Param("column"), Param("to"))
def rename(frame: OrderedFrame, name: str, to: str):
    """A column by another name."""
    frame.check(name)
    return frame.apply(lambda df: df.withColumnRenamed(name, to))


@pl("cast", Param("column"), Param("type"))
def cast(frame: OrderedFrame, name: str, kind: str):
    """A column as another type; values that don't fit become null."""
    return frame.apply(lambda df: df.withColumn(name, frame.col(name).try_cast(kind)))


@pl("fill_null", Param("column"), Param("value"))
def fill_null(frame: OrderedFrame, name: str, value: str):
    """A value in place of a column's nulls."""
    return frame.apply(lambda df: df.withColumn(name, F.coalesce(frame.col(name), literal(value, frame.type_of(name)))))


@pl("drop_nulls", Param("columns", multiple=True))
def drop_nulls(frame: OrderedFrame, parts: list[str]):
    """Rows without a null in the named columns, or in any."""
    names = _names(parts) if parts else frame.columns
    frame.check(*names)
    return frame.apply(lambda df: df.dropna(subset=names))


@pl("join", Param("other", "any"), Param("left_on"), Param("right_on", default=""), Param("how", "enum", "inner", {h: h for h in ("inner", "left", "semi", "anti")}))
def join(frame: OrderedFrame, other, left_on: str, right_on: str, how: str):
    """Rows together with those of a linked frame whose key is equal; of equal names the other's get `_right`."""
    if not isinstance(other, OrderedFrame):
        raise EngineError("argument", "the other side must be a link to a frame")
    right_on = right_on or left_on
    right: DataFrame = other.visible().select(other.col(right_on).alias("__qkey"), *(other.col(c).alias(f"{c}_right" if c in frame.columns else c) for c in other.columns if c != right_on))
    how = {"semi": "left_semi", "anti": "left_anti"}.get(how, how)
    return frame.apply(lambda df: df.join(right, frame.col(left_on) == F.col("__qkey"), how).drop("__qkey"))


@pl("group_by", Param("columns"), Param("aggregate", "enum", "count", {a: a for a in ("count", "sum", "mean", "min", "max")}), Param("column", default=""))
def group_by(frame: OrderedFrame, columns: str, aggregate: str, name: str):
    """One row for each value of the columns, with a count or an aggregate of another column."""
    keys = _names([columns])
    frame.check(*keys, *([name] if name else []))
    made = F.count(F.lit(1)).alias("count") if aggregate == "count" else {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[aggregate](column(name)).alias(f"{name}_{aggregate}")
    return from_scan(frame.visible().groupBy(*map(column, keys)).agg(made))
