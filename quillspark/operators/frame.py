"""Frames with an order: a lazy DataFrame, and a list of columns that says how its rows follow one another.

The order is part of the plan and costs nothing until something needs it: a positional operation or ordered output.
Its columns are hidden; Catalyst prunes them from scans where nothing asks for them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError

HIDDEN = "__q"


@dataclass(frozen=True)
class OrderedFrame:
    """keys: hidden columns in order, each with its direction; nulls come first in either. sorted: by a sort command.

    plain has the same rows without hidden columns, until an operation depends on positions. What needs no order is
    made from it, as a scan that was once asked for row numbers reads them even if nothing uses them.
    """

    df: DataFrame
    keys: tuple[tuple[str, bool], ...] = ()
    sorted: bool = False
    plain: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def type_of(self, name: str):
        self.check(name)
        return next(f.dataType for f in self.df.schema if f.name == name)

    def check(self, *names: str) -> None:
        """Column names are exact."""
        if missing := [n for n in names if n not in self.columns]:
            raise EngineError("argument", f"no column {', '.join(missing)}; there are {', '.join(self.columns)}")

    def col(self, name: str) -> Column:
        self.check(name)
        return column(name)

    def select(self, *names: str) -> OrderedFrame:
        self.check(*names)
        if len(set(names)) < len(names):
            raise EngineError("argument", f"a column is named twice: {', '.join(names)}")
        plain = None if self.plain is None else self.plain.select(*map(column, names))
        return replace(self, df=self.df.select(*map(column, (*names, *self.hidden))), plain=plain)

    def apply(self, f: Callable[[DataFrame], DataFrame]) -> OrderedFrame:
        """f of the rows, one that needs no order and keeps hidden columns."""
        return replace(self, df=f(self.df), plain=None if self.plain is None else f(self.plain))

    def with_df(self, df: DataFrame) -> OrderedFrame:
        return replace(self, df=df, plain=None)

    def order(self, reverse: bool = False) -> list[Column]:
        return [(F.asc_nulls_first(c) if up else F.desc_nulls_first(c)) if not reverse else (F.desc_nulls_last(c) if up else F.asc_nulls_last(c)) for c, up in self.keys]

    def sort(self, by: Column, ascending: bool) -> OrderedFrame:
        """Rows with equal keys stay in the order that they had."""
        key = f"{HIDDEN}s{len(self.hidden)}"
        return OrderedFrame(self.df.withColumn(key, by), ((key, ascending), *self.keys), True, self.plain)

    def head(self, n: int) -> OrderedFrame:
        return self.slice(0, n)

    def slice(self, offset: int, length: int) -> OrderedFrame:
        df = self.df.orderBy(*self.order()) if self.keys else self.df
        return self.with_df((df.offset(max(0, offset)) if offset > 0 else df).limit(max(0, length)))

    def tail(self, n: int) -> OrderedFrame:
        """A top-k from the other end: no full sort, nothing on the driver."""
        return replace(self, df=(self.df.orderBy(*self.order(reverse=True)) if self.keys else self.df).limit(max(0, n)), sorted=True, plain=None)

    def visible(self) -> DataFrame:
        """The rows in no order, without the hidden columns."""
        return (self.df if self.plain is None else self.plain).select(*map(column, self.columns))

    def result(self) -> DataFrame:
        """The rows; in order, if a sort or a position asked for one."""
        return self.df.orderBy(*self.order()).select(*map(column, self.columns)) if self.sorted and self.keys else self.visible()


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def from_files(df: DataFrame) -> OrderedFrame:
    """A scan of Parquet files in the order of their rows: by file, then by row."""
    ord_ = df.select("*", F.col("_metadata.file_path").alias(f"{HIDDEN}f"), F.col("_metadata.row_index").alias(f"{HIDDEN}r"))
    return OrderedFrame(ord_, ((f"{HIDDEN}f", True), (f"{HIDDEN}r", True)), plain=df)


def from_scan(df: DataFrame) -> OrderedFrame:
    """Any other scan, whose rows are numbered in the order of its partitions."""
    return OrderedFrame(df.select("*", F.monotonically_increasing_id().alias(f"{HIDDEN}r")), ((f"{HIDDEN}r", True),), plain=df)


def from_rows(spark: SparkSession, rows: list, schema) -> OrderedFrame:
    return from_scan(spark.createDataFrame(rows, schema))
