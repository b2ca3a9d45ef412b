"""Readers and writers of frames, and conversions of values to frames."""

from __future__ import annotations

import io
import re

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.literals import SEPARATORS
from ..operators.frame import OrderedFrame, column, from_files, from_scan
from .media import frame_format


def _widened(schema: T.StructType) -> T.StructType:
    """Inferred types: integers have 64 bits, dates and times stay texts."""
    wider = {T.IntegerType: T.LongType(), T.DateType: T.StringType(), T.TimestampType: T.StringType(), T.TimestampNTZType: T.StringType()}
    return T.StructType([T.StructField(f.name, wider.get(type(f.dataType), f.dataType)) for f in schema])


def read_csv(spark: SparkSession, source, sep: str = ",") -> OrderedFrame:
    """source: a path, or an RDD of lines. One pass infers types, a second one reads with them."""
    options = {"header": True, "sep": sep, "multiLine": isinstance(source, str), "escape": '"', "nullValue": "", "enforceSchema": False}
    inferred = spark.read.options(**options, inferSchema=True).csv(source).schema
    return from_scan(spark.read.options(**options).schema(_widened(inferred)).csv(source))


def read_frame(spark: SparkSession, path: str, name: str) -> OrderedFrame:
    """A frame from a path that Spark can read."""
    kind, sep = frame_format(name)
    if kind == "csv":
        return read_csv(spark, path, sep)
    if kind == "parquet":
        return from_files(spark.read.parquet(path))
    if kind in ("json", "ndjson"):
        return from_scan(spark.read.option("multiLine", kind == "json").json(path))
    if kind == "orc":
        return from_scan(spark.read.orc(path))
    raise EngineError("not-supported", f"frames can't be read from {name}")


def write_frame(frame: OrderedFrame, path: str, name: str) -> None:
    """A folder of part files, in order if the frame has been sorted."""
    kind, sep = frame_format(name)
    writer = frame.result().write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    elif kind in ("json", "ndjson"):
        writer.json(path)
    elif kind == "orc":
        writer.orc(path)
    else:
        raise EngineError("not-supported", f"frames can't be written as {name}")


def csv_records(text: str, sep: str) -> list[str]:
    """A CSV text cut at line ends outside of quotes. A quote counts at a field's begin only, or where one has ended."""
    out, begin, quoted, field, closed = [], 0, False, 0, -1
    for m in re.finditer(f'"|\r\n|\n|\r|{re.escape(sep)}', text):
        if m[0] == '"':
            if quoted:
                quoted, closed = False, m.end()
            else:
                quoted = m.start() in (field, closed)
        elif not quoted:
            field = m.end()
            if m[0] != sep:
                out.append(text[begin : m.start()])
                begin = m.end()
    return [*out, text[begin:]]


def csv_text(context, text: str, sep: str) -> OrderedFrame:
    if not text.strip("\r\n"):
        raise EngineError("conversion", "there is no CSV in an empty text")
    return read_csv(context.spark, context.spark.sparkContext.parallelize(csv_records(text, sep), 1), sep)


def frame_bytes(frame: OrderedFrame, name: str) -> bytes:
    """A whole frame as one file's content in the named format (CSV without a name): for results that fit in a value."""
    kind, sep = frame_format(name or "csv")
    if kind == "csv":
        return csv_value(frame, sep).result().first()[0].encode()
    if kind == "parquet":
        out = io.BytesIO()
        pq.write_table(frame.result().toArrow(), out)
        return out.getvalue()
    if kind in ("json", "ndjson"):
        rows = [r[0] for r in frame.result().select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
        return (("[" + ",\n".join(rows) + "]") if kind == "json" else "".join(f"{r}\n" for r in rows)).encode()
    raise EngineError("not-supported", f"frames can't be written as {name} in one value")


def _quoted(c: str, kind: T.DataType, sep: str):
    value = column(c).cast("string")
    if isinstance(kind, T.StringType):
        value = F.when(value.rlike(f'["{re.escape(sep)}\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)
    return F.coalesce(value, F.lit(""))


def csv_value(frame: OrderedFrame, sep: str = ",") -> OrderedFrame:
    """One row with the whole frame as CSV text: for results that fit in a value."""
    types = {f.name: f.dataType for f in frame.df.schema}
    line = F.concat_ws(sep, *(_quoted(c, types[c], sep) for c in frame.columns))
    lines = frame.df.select(F.struct(*(column(k) for k, _ in frame.keys)).alias("k"), line.alias("line")) if frame.keys else frame.df.select(F.lit(0).alias("k"), line.alias("line"))
    head = sep.join('"' + c.replace('"', '""') + '"' if any(x in c for x in f'"{sep}\r\n') else c for c in frame.columns)
    ups = [up for _, up in frame.keys]
    if all(ups):
        rows = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    else:
        # Directions differ: number the rows by a sort first.
        ordered = frame.df.orderBy(*frame.order()).select(line.alias("line"))
        lines = ordered.select(F.monotonically_increasing_id().alias("k"), "line")
        rows = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"])
    text = lines.agg(F.concat(F.lit(head + "\n"), F.array_join(rows, "\n"), F.when(F.count(F.lit(1)) > 0, "\n").otherwise("")).alias("text"))
    return from_scan(text)


def as_frame(context, state) -> OrderedFrame:
    """A command's input as a frame; text and bytes are read in the format that their metadata names, or as CSV."""
    value = state.value
    if isinstance(value, OrderedFrame):
        return value
    if isinstance(value, DataFrame):
        return from_scan(value)
    name = (state.metadata.data_format or "").lower()
    if value is None and state.metadata.path and frame_format(name)[0] != "csv":  # a stored file, whose bytes nobody has read
        return read_frame(context.spark, state.metadata.path, name)
    if isinstance(value, str | bytes) or value is None and state.metadata.path:
        return csv_frame(context, state, None)
    raise EngineError("conversion", f"a value of type {type(value).__name__} isn't a frame")


def csv_frame(context, state, sep: str | None) -> OrderedFrame:
    """A stored file by its path, otherwise a text; a separator that is given beats the format's."""
    value, path = state.value, state.metadata.path
    if sep is None:
        name = state.metadata.data_format or "csv"
        sep = frame_format(name)[1] if name in ("tsv",) or name.startswith("csv") else ","
    if path and (value is None or isinstance(value, bytes | OrderedFrame)):
        return read_csv(context.spark, path, SEPARATORS.get(sep, sep))
    if isinstance(value, OrderedFrame):
        return value
    if isinstance(value, bytes):
        value = value.decode(errors="replace")
    if not isinstance(value, str):
        raise EngineError("conversion", f"a value of type {type(value).__name__} isn't CSV")
    return csv_text(context, value, SEPARATORS.get(sep, sep))
