"""Line deduplication by site-relative frequency, with DataFrame functions only.

A line that stands on more than a given share of a site's pages is boilerplate there and is dropped from them. Lines
are counted by hashes, once for each page; only hashes are shuffled while the boilerplate lines are few enough to be
broadcast. Beyond that, they are joined to the pages' line hashes, and the hits to the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize

#: A line on more than this share of its site's pages, and on so many pages at least, is boilerplate.
RATIO, PAGES = 0.1, 10
#: Boilerplate lines (16 bytes each) and such lines of one site up to which they are broadcast.
BROADCAST_LINES, SITE_LINES = 100_000, 1_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(site: Column, line: Column) -> Column:
    """128 bits of a site and a line, without the line's outer spaces."""
    return F.struct(F.xxhash64(site, F.trim(line)).alias("a"), F.xxhash64(F.lit("line"), F.trim(line), site).alias("b"))


def boilerplate(df: DataFrame, site: str, text: str, ratio: float, pages: int) -> DataFrame:
    """(site_hash, line) of the lines that are to be dropped."""
    s = F.col(site)
    by_page = df.select(F.xxhash64(s).alias("site_hash"), F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x) != ""), lambda x: _hash(s, x)))).alias("line"))
    often = by_page.groupBy("site_hash", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= pages)
    totals = df.groupBy(F.xxhash64(s).alias("site_hash")).agg(F.count(F.lit(1)).alias("total"))
    return often.join(totals, "site_hash").filter(F.col("n") > ratio * F.col("total")).select("site_hash", "line")


def without_boilerplate(df: DataFrame, site: str = "source", text: str = "text", ratio: float = RATIO, pages: int = PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """df with boilerplate lines taken out of its texts, and n_lines and n_dropped of each.

    Pages are rows; repeated rows count each by themselves. A null site is a site of its own. Null texts stay null and
    have no lines; blank lines stay. Lines are equal if they are so without outer spaces. Other columns stay; a clashing
    new name gets underscores in front.
    """
    drop = materialize(boilerplate(df, site, text, ratio, pages))
    by_site = drop.groupBy("site_hash").agg(F.count(F.lit(1)).alias("n"))
    n, most = by_site.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    s, held = F.col(f"`{site}`"), free_name(df.columns, "dropped_lines")
    if n <= broadcast_lines and most <= SITE_LINES:
        listed = drop.groupBy("site_hash").agg(F.collect_list("line").alias(held)).withColumnRenamed("site_hash", f"{held}_of")
        joined = df.join(F.broadcast(listed), F.xxhash64(s) == F.col(f"{held}_of"), "left")
    else:
        key = [F.xxhash64(F.col(f"`{text}`")), F.xxhash64(s)]
        hits = df.select(*(k.alias(c) for k, c in zip(key, ("t", "site_hash"), strict=True)), F.explode(F.array_distinct(F.transform(_lines(F.col(f"`{text}`")), lambda x: _hash(s, x)))).alias("line"))
        listed = hits.join(drop, ["site_hash", "line"], "left_semi").groupBy(F.col("t").alias(f"{held}_t"), F.col("site_hash").alias(f"{held}_of")).agg(F.collect_set("line").alias(held))
        joined = df.join(listed, (key[0] == F.col(f"{held}_t")) & (key[1] == F.col(f"{held}_of")), "left")
    lines = _lines(F.col(f"`{text}`"))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.coalesce(F.array_contains(F.col(held), _hash(s, x)), F.lit(False)))
    n_lines, n_dropped = free_name(df.columns, "n_lines"), free_name(df.columns, "n_dropped")
    made = joined.select(*(F.col(f"`{c}`") for c in df.columns if c != text), F.when(F.col(held).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n")).alias(text),
                         F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(n_lines), F.when(F.col(held).isNull() | F.col(f"`{text}`").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("long").alias(n_dropped))
    return made.select(*(f"`{c}`" for c in df.columns), n_lines, n_dropped)


def cleaned(documents: DataFrame) -> DataFrame:
    return without_boilerplate(documents.select("doc_id", "source", "text"))
