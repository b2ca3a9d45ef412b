"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees within a Hamming radius.

The distinct fingerprints are dealt into shards so that any two within the radius meet in a shard: with radius r, of
r+1 groups of bits at least one is equal in both, and there is a shard for each group and value of it. Groups have as
many bits as make shards of a thousand fingerprints or so; one that grows too large is dealt again by the remaining
bits in the same way. Each shard's BK-tree is built where the shard is, as broadcasting the trees would bring all
documents' fingerprints to the driver, and walked along edges within the radius only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, free_name, map_slices, materialize, raw
from .components import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A shard of more fingerprints is dealt again by further bits, up to DEPTH times in all; shards are about a quarter of it.
SHARD = 4096
DEPTH = 4
#: Fingerprints in a leaf of a BK-tree, which are all compared.
LEAF = 16


def hashes(ws: list[bytes], width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `width` words, repeats included; of the whole sequence if it has fewer words."""
    text = b" ".join(ws)
    if not ws:
        return np.zeros(0, np.uint64)
    of = xxhash.xxh64_intdigest
    if len(ws) <= width:
        return np.array([of(text, seed)], np.uint64)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(ws) - width + 1].tolist()
    return np.array([of(text[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 248):  # so many bits are counted in a byte
        part = np.ascontiguousarray(h[at : at + 248])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def shingle_words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def with_fingerprint(df: DataFrame, text: str = "text", width: int = SHINGLE, name: str = "fingerprint") -> DataFrame:
    """df with each whole text's fingerprint as a long; null and empty texts, and blank ones, have 0. No shuffle."""
    schema = T.StructType([*df.schema.fields, T.StructField(free_name(df.columns, name), T.LongType())])
    at = df.columns.index(text)

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [fingerprint(hashes(shingle_words(x), width)) for x in raw(batch.column(at))]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=schema.names)

        return one

    return map_slices(df, start, schema)


def groups_of(bits: tuple[int, ...], radius: int, used: int) -> list[tuple[int, ...]]:
    """radius+1 disjoint groups of at most `used` of the bits; of two fingerprints within the radius one group is equal."""
    n = radius + 1
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n][:used] for i in range(n)]


class BkTree:
    """Children of a node hold the fingerprints at one integer Hamming distance from it; small sets are leaves."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.root = self._grow(np.arange(len(prints)))

    def _grow(self, ids: np.ndarray):
        root: list = [None]
        todo = [(root, 0, ids)]
        while todo:
            where, key, ids = todo.pop()
            if len(ids) <= LEAF:
                where[key] = ids
                continue
            pivot, rest = ids[0], ids[1:]
            d = np.bitwise_count(self.prints[rest] ^ self.prints[pivot])
            children: dict[int, object] = {}
            where[key] = (pivot, children)
            for c in np.unique(d).tolist():
                children[c] = None
                todo.append((children, c, rest[d == c]))
        return root[0]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index in queries, index in prints) of all pairs within the radius; follows only edges that may lead there."""
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, asked = todo.pop()
            if isinstance(node, np.ndarray):
                if len(node) and len(asked):
                    i, j = np.nonzero(np.bitwise_count(queries[asked][:, None] ^ self.prints[node]) <= radius)
                    yield asked[i], node[j]
                continue
            pivot, children = node
            d = np.bitwise_count(queries[asked] ^ self.prints[pivot]).astype(np.int64)
            near = asked[d <= radius]
            yield near, np.full(len(near), pivot)
            for c, child in children.items():
                if len(on := asked[np.abs(d - c) <= radius]):
                    todo.append((child, on))


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give both ends of each pair the smaller of their labels, and so on for all that had these labels; in place."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels[:] = up


def linked(prints: np.ndarray, radius: int) -> np.ndarray:
    """For each of a shard's fingerprints the first one that is linked to it, over other ones too."""
    labels, tree = np.arange(len(prints)), BkTree(prints)
    for at in range(0, len(prints), 1024):
        for i, j in tree.within(prints[at : at + 1024], radius):
            unite(labels, i + at, j)
    return labels


def _groups(batches: Iterator[pa.RecordBatch], raw: int | None = None) -> Iterator[list]:
    """Runs of rows of one shard, as columns; the first two columns tell shards apart. Column `raw` stays in Arrow.

    The rows of a shard may come in many batches, which are put together once.
    """
    held: list[pa.RecordBatch] = []

    def whole(parts: list[pa.RecordBatch]) -> list:
        table = pa.Table.from_batches(parts)
        return [c.combine_chunks() if i == raw else c.to_numpy() for i, c in enumerate(table.columns)]

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cut = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(a)]
        if held and (held[0].column(0)[0].as_py() != a[0] or held[0].column(1)[0].as_py() != b[0]):
            if sum(h.num_rows for h in held) > 1:
                yield whole(held)
            held = []
        for x, y in zip(cut, cut[1:], strict=False):
            part = batch.slice(x, y - x)
            if y == len(a):
                held.append(part)
            elif held:
                yield whole([*held, part])
                held = []
            elif y - x > 1:
                yield whole([part])
    if held and sum(h.num_rows for h in held) > 1:
        yield whole(held)


def _bits_for(rows: int, shard: int) -> int:
    """Bits of a group that cut so many rows into shards of about a quarter of the limit."""
    return max(0, (4 * rows - 1).bit_length() - (shard.bit_length() - 1)) if rows > shard else 0


def _mask(*bits: int) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def shards(prints: DataFrame, radius: int, shard: int = SHARD, depth: int = DEPTH) -> DataFrame:
    """(kind, value, all of prints' columns): rows of each shard, in which any two within the radius meet at least once.

    A shard is a group of bits and their value. Groups have as many bits as make shards of about `shard` / 4 rows, so up
    to `shard` rows are one shard. A larger shard is dealt again by bits outside its own, again by radius+1 groups.
    """
    largest, out, free = prints.count(), None, {0: tuple(range(64))}
    todo = prints.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("value"), *prints.columns)
    for level in range(depth):
        used = _bits_for(largest, shard)
        if not used:
            break
        # What each kind of shard is dealt into: the number of the new kind and its bits; `free` has the bits left to it.
        to, left = [], {}
        for kind, bits in free.items():
            own, dealt = [b for b in range(64) if b not in bits], []
            for i, group in enumerate(groups_of(bits, radius, used)):
                left[number := kind * (radius + 1) + i + 1] = tuple(b for b in bits if b not in group)
                dealt.append(F.struct(F.lit(number).alias("kind"), F.lit(_mask(*own, *group)).cast("long").alias("bits")))
            to += [F.lit(kind), F.array(*dealt)]
        rows = todo.select(F.explode(F.element_at(F.create_map(*to), F.col("kind"))).alias("s"), *prints.columns)
        todo = rows.select(F.col("s.kind").alias("kind"), F.col("fp").bitwiseAND(F.col("s.bits")).alias("value"), *prints.columns)
        if level + 1 == depth:
            break
        large = materialize(todo.groupBy("kind", "value").count().filter(F.col("count") > shard), rows=F.count(F.lit(1)))
        if not large.seen["rows"]:
            break
        found = {r[0]: r[1] for r in large.groupBy("kind").agg(F.max("count")).collect()}
        free, largest = {k: left[k] for k in sorted(found)}, max(found.values())
        done = todo.join(large.drop("count"), ["kind", "value"], "left_anti")
        todo = todo.join(large.drop("count"), ["kind", "value"], "left_semi")
        out = done if out is None else out.unionByName(done)
    return todo if out is None else out.unionByName(todo)


def shard_pairs(dealt: DataFrame, of, name: str, kind: str) -> DataFrame:
    """(u_fp, u, v_fp, v): of(fingerprints of a shard, as unsigned) gives the places of both ends of each pair.

    dealt: what shards() gives, with a column `name` of the SQL type `kind` that goes along with the fingerprint. Each
    shard's BK-tree is built by the task that has the shard.
    """
    schema = f"u_fp long, u {kind}, v_fp long, v {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, fp, _, own in _groups(batches, 4):
            for i, j in of(fp.view(np.uint64)):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(fp[i]), own.take(pa.array(i)), pa.array(fp[j]), own.take(pa.array(j))], names=["u_fp", "u", "v_fp", "v"])

    rows = dealt.select("kind", "value", "fp", F.col(name).isNull().alias("none"), F.col(name).alias("own"))
    return rows.repartition("kind", "value").sortWithinPartitions("kind", "value", "none", "own", "fp").mapInArrow(run, schema)


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, depth: int = DEPTH) -> DataFrame:
    """Edges (u_fp, u, v_fp, v) whose components are those of all pairs of fingerprints within the radius.

    prints: distinct longs fp, and a long `first`. Of the links inside a shard it returns one from each fingerprint to
    the first of its group, so a dense group costs as many rows as it has fingerprints.
    """

    def of(bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        labels = linked(bits, radius)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        yield moved, labels[moved]

    return shard_pairs(shards(prints, radius, shard, depth), of, "first", "long")


def near_groups(documents: DataFrame, width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row.

    component_id is the smallest doc_id that can be reached over fingerprints within the radius, a row's own included.
    A null doc_id names no component unless all of it is null; then component_id is null. Null, empty and blank texts
    have no words and fingerprint zero, and are linked like any other; very long texts are read whole. Repeated rows stay; ties can't occur, as the smallest id is unique; an empty table gives an empty
    one. Only the columns doc_id and text are read, so further columns can't clash.
    """
    slim = materialize(with_fingerprint(documents.select("doc_id", "text"), width=width, name="fp").select("doc_id", "fp"))
    first = materialize(slim.groupBy("fp").agg(F.min("doc_id").alias("first")))

    def node(end: str):
        # In the order of ids, so that a component's least node has its least id; null ids come last.
        return F.struct(F.col(end).isNull().alias("none"), F.col(end).alias("id"), F.col(f"{end}_fp").alias("fp"))

    roots = components(links(first, radius).select(node("u").alias("u"), node("v").alias("v")))
    of = roots.select(F.col("node.fp").alias("fp"), F.col("root.id").alias("root_id"), F.lit(True).alias("linked"))
    labels = materialize(first.join(of, "fp", "left").select("fp", F.when(F.col("linked"), F.col("root_id")).otherwise(F.col("first")).alias("component_id")))
    return slim.join(labels, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
