"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by a hash of their text, so that equal texts stand together. Splitters are quantiles of a sample
of keys, drawn in proportion to record sizes; they cut the order into ranges. Each range's bytes are then measured, and
overfull ranges are subdivided, as often as it takes: by the key as long as a range has several, then by a hash of the
record's id, then by the record's place in the table. Shards are runs of the measured ranges: the bytes of the ranges
before give each record its place among all bytes, of which each shard gets an equal share, so that a shard's end parts
at most one range. Only ids, sizes and hashes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, named

SHARDS = 40
OVERHEAD = 16
#: Sampled splitters for each shard, and sampled keys for each splitter.
SPLITTERS, SAMPLE = 4, 64
#: Bytes of records that are ordered together in one range, and the most ranges that are aimed at.
RANGE_BYTES, MOST_RANGES = 32 << 20, 1 << 16
#: A range is overfull beyond so many times an equal share of the bytes; it is cut into no fewer parts than PARTS.
OVERFULL, PARTS = 2, 16
#: Equal texts of no more than this share of a shard aren't parted.
TOGETHER = 0.01
#: What a range is subdivided by: the first of these that isn't the same in all of its records.
LEVELS = ("key", "salt", "place")


def splitters(sample: list[tuple[int, float]], ranges: int) -> list[int]:
    """From (key, weight) pairs: bounds at the weights' quantiles; a key over a range's share has a range by itself."""
    weights: dict[int, float] = {}
    for k, w in sample:
        weights[k] = weights.get(k, 0.0) + w
    total, below, bounds = sum(weights.values()), 0.0, set()
    for k in sorted(weights):
        first, below = int(below * ranges / total), below + weights[k]
        if weights[k] >= total / ranges:
            bounds |= {k, k + 1}
        elif int(below * ranges / total) > first:
            bounds.add(k + 1)
    return sorted(b for b in bounds if -(1 << 63) < b < 1 << 63)


def range_of(bounds: list[int]) -> Column:
    """The number of bounds up to a record's key."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("key"))).cast("long") if bounds else F.lit(0).cast("long")


def measured(placed: DataFrame) -> list:
    """Bytes, rows and ends of each range in order: as many rows as there are ranges."""
    ends = [f(c).alias(f"{c}_{n}") for c in LEVELS for n, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *ends).orderBy("g").collect()


def subdivision(ranges: list, limit: float) -> list[tuple]:
    """(g, first new number, parts, level, low, step) of each range; those within the limit, or of one record, stay whole."""
    out, base = [], 0
    for r in ranges:
        level = next((c for c in LEVELS if r[f"{c}_min"] != r[f"{c}_max"]), None)
        parts, low, step = 1, 0, 1
        if r.bytes > limit and level:
            low, high = r[f"{level}_min"], r[f"{level}_max"]
            parts = max(PARTS, -(-int(OVERFULL * r.bytes) // max(1, int(limit))))
            step = max(1, -(-(high - low + 1) // parts))
        out.append((r.g, base, parts, LEVELS.index(level) if level else 0, low, min(step, (1 << 63) - 1)))
        base += parts
    return out


def ranged(slim: DataFrame, bounds: list[int], limit: float) -> tuple[DataFrame, list]:
    """slim with the number g of each record's range, and the measures of the ranges, none of which is overfull.

    A round cuts an overfull range's keys (or hashes, or places) into 16 equal parts or more, so 64 bits take at most 16
    rounds a level; as splitters part frequent keys from others, few are needed. A single record is never cut.
    """
    placed = slim.withColumn("g", range_of(bounds))
    while True:
        found = measured(placed)
        cuts = subdivision(found, limit)
        if all(c[2] == 1 for c in cuts):
            return placed, found
        table = slim.sparkSession.createDataFrame(cuts, "g long, base long, parts long, level int, low long, step long")
        # In decimals, as the distance of two longs may need 65 bits.
        at = [F.floor((F.col(c).cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)")) / F.col("step")).cast("long") for c in LEVELS]
        which = F.when(F.col("level") == 0, at[0]).when(F.col("level") == 1, at[1]).otherwise(at[2])
        part = F.when(F.col("parts") == 1, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), F.least(F.col("parts") - 1, which)))
        # As many rows as there are ranges: bounded by MOST_RANGES and the parts of overfull ones, never by records.
        placed = placed.join(F.broadcast(table), "g").withColumn("g", F.col("base") + part).select(*slim.columns, "g")


def with_shards(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row: shards of near equal bytes, slots from 0 without gaps.

    A record's size is its text's UTF-8 bytes plus 16; a null text counts as an empty one. A shard's bytes differ from
    an equal share by a record or a small group of equal texts at each end. Repeated rows have slots of their own; which
    of the same row's copies gets which is open. Ties of keys go by the id, null first. However long a text, only its
    size and hashes are shuffled. Other columns, whatever their names, aren't read. An empty table gives an empty frame.
    """
    t = F.coalesce(named(text), F.lit(""))
    slim = materialize(df.select(named(doc_id).alias("doc_id"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("key")))
    total = slim.agg(F.sum("size")).first()[0] or 0
    ranges = SPLITTERS * shards
    rate = SAMPLE * ranges / max(total, 1)
    chance = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("splitters")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = slim.filter(chance < F.col("size") * rate).select("key", F.greatest(F.lit(1.0), F.col("size") * rate)).collect()
    wanted = min(MOST_RANGES, max(ranges, total // RANGE_BYTES))
    salted = slim.select("*", F.xxhash64("doc_id", F.lit("part")).alias("salt"), F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("place"))
    placed, found = ranged(salted, splitters([(r[0], r[1]) for r in sample], ranges), max(OVERFULL * total / wanted, TOGETHER * total / shards))

    ahead, sums = [0, 0], []
    for r in found:
        sums.append((r.g, *ahead))
        ahead = [ahead[0] + r.bytes, ahead[1] + r.rows]
    before = df.sparkSession.createDataFrame(sums, "g long, g_bytes long, g_rows long")
    inside = Window.partitionBy("g").orderBy("key", "text_crc32", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    equal = Window.partitionBy("g", "key", "text_crc32", "size")
    spot = placed.select("doc_id", "size", "text_crc32", "key", "g").join(F.broadcast(before), "g").select(
        "*", (F.col("g_bytes") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("byte"), (F.col("g_rows") + F.count(F.lit(1)).over(inside)).alias("row")
    )
    spot = spot.withColumn("byte", F.when(F.sum("size").over(equal) <= TOGETHER * total / shards, F.min("byte").over(equal)).otherwise(F.col("byte")))
    shard = F.least(F.lit(shards - 1), F.floor(F.col("byte") / F.lit(max(total, 1) / shards))).cast("int")
    spot = materialize(spot.select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"))
    first = spot.groupBy("shard").agg(F.min("row").alias("first"))
    return spot.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def assigned(documents: DataFrame) -> DataFrame:
    placed = with_shards(documents)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
