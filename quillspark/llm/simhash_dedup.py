"""Removal of near-duplicate documents: SimHash and MinHash propose pairs, the Jaccard similarity of shingles decides.

Documents are near-duplicates if their sets of five-word shingles have a similarity of 0.8 or more, over further
documents too; the one with the smallest id of each group stays. A first pass, by the SimHash operator's BK-trees, links
texts to near ones cheaply, so that large groups of copies are known before pairs are counted. At a similarity of 0.8
fingerprints differ in about 10 of 64 bits, so this pass can't be whole. The second pass is: texts share a bucket if a
band of MinHashes of their shingles is equal. Of each bucket every pair of texts is looked at that isn't linked yet, and
those that an exact bound of the similarity doesn't rule out are joined to clusters. So each bucket gives at most as many
rows as it has texts, and any near-duplicates that aren't linked yet are in one cluster. Each text is in one cluster
only, with all its shingles; there all pairs are decided exactly, and again only the links that join something are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_name, given_back, map_slices, materialize, on_split_key, raw
from .components import components
from .simhash import RADIUS, SEED, BkTree, _groups, fingerprint, shard_pairs, shards, shingle_words

SHINGLE = 5
SIMILARITY = 0.8
#: Bands of ROWS MinHashes. Texts of similarity 0.8 share no band in 7 of 10^10 cases, whatever the edit between them.
BANDS, ROWS = 40, 4
#: Longs of a text's parities: bits that say of which hashes modulo 64 * PARITIES its shingles have an odd number.
PARITIES = 4
#: Buckets of more texts are dealt over several tasks.
CHUNK = 20_000
#: Shingles of a block of a cluster, a text counting as TEXT more; larger clusters are blocks, each pair of which is a
#: task's unit. Longs of the parities that are taken of a unit's texts.
BLOCK, TEXT, FINER = 1 << 20, 100, 32
#: What is known of a text wherever it goes: its number of shingles and its parities.
FACTS = ["size", *(f"p{i}" for i in range(PARITIES))]
#: Rows of a checked size up to which a list of texts or documents is broadcast (about 60 bytes each).
BROADCAST_ROWS = 100_000
#: Words that are hashed at once, and the bytes of a word beyond which its digest is hashed: memory bounds only.
WORDS, LONG_WORD = 4096, 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Hashes of runs of words: polynomials in the bytes' random values, of which prefix sums give any run's at once."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self._byte, self._base = rng.integers(0, 1 << 64, 256, np.uint64), int(rng.integers(0, 1 << 61)) * 8 + 5
        self._powers = self._inverses = np.ones(1, np.uint64)

    def _grown(self, n: int) -> None:
        if n > len(self._powers):
            size = 1 << n.bit_length()
            self._powers, self._inverses = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (self._base, pow(self._base, -1, 1 << 64)))

    def of(self, text: bytes | None, width: int = SHINGLE) -> np.ndarray:
        """Distinct hashes of each run of `width` words, in order; of the whole sequence if it has fewer words."""
        ws = shingle_words(text)
        if not ws:
            return np.zeros(0, np.uint64)
        width, out = min(width, len(ws)), []
        for at in range(0, len(ws) - width + 1, WORDS):
            part = ws[at : at + WORDS + width - 1]
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            for i in np.flatnonzero(lengths > LONG_WORD).tolist():  # such a word's digest stands for it
                part[i] = b"\0" + xxhash.xxh128_digest(part[i])
                lengths[i] = 17
            ends = np.cumsum(lengths + 1) - 1
            self._grown(int(ends[-1]) + 1)
            sums = np.zeros(ends[-1] + 1, np.uint64)
            np.cumsum(self._byte[np.frombuffer(b" ".join(part), np.uint8)] * self._powers[: ends[-1]], out=sums[1:])
            starts, ends = (ends - lengths)[: len(part) - width + 1], ends[width - 1 :]
            out.append(_mixed((sums[ends] - sums[starts]) * self._inverses[starts]))
        return np.unique(np.concatenate(out))


class Bands:
    """A key for each band of a set of hashes: of its number and of the least of the hashes under its multipliers."""

    def __init__(self):
        self._multipliers = np.random.default_rng(8).integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
        self._buffer = np.empty((BANDS * ROWS, 256), np.uint32)

    def of(self, h: np.ndarray) -> np.ndarray:
        h, least = (h >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
        for at in range(0, len(h), 256):
            part = h[at : at + 256]
            np.minimum(least, np.multiply(self._multipliers, part, out=self._buffer[:, : len(part)]).min(1), out=least)
        out = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            out = _mixed((out ^ row) + np.uint64(0x9E3779B97F4A7C15))
        return out.view(np.int64)


def parities(h: np.ndarray, longs: int = PARITIES) -> np.ndarray:
    """Two sets of distinct hashes differ in as many as their parities have different bits, or in more."""
    odd = np.bincount((h % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _identity(text: Column) -> Column:
    """The name of a text, the same for equal ones; null counts as empty."""
    return F.md5(F.coalesce(text, F.lit("")))


def _sketches(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: id, the text's hash (its identity), fingerprint, keys of bands, number of shingles, parities."""
    given = df.select(F.col(f"`{doc_id}`").alias("doc_id"), _identity(F.col(f"`{text}`")).alias("t"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*given.schema.fields[:2], T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in FACTS)])

    def start():
        shingles, key_of = Shingles().of, Bands().of

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints, keys, facts = [], [], []
            for x in raw(batch.column(2)):
                of = shingles(x)
                prints.append(fingerprint(of))
                keys.append(key_of(of))
                facts.append([len(of), *parities(of).tolist()])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *(pa.array([x[i] for x in facts], pa.int64()) for i in range(len(FACTS)))], names=schema.names)

        return one

    return map_slices(given, start, schema)


def nearest_before(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint that has any, the nearest of those before it within the radius, found by a BK-tree."""
    tree, best = BkTree(prints), np.full(len(prints), 1 << 40, np.int64)
    for at in range(0, len(prints), 1024):
        for i, j in tree.within(prints[at : at + 1024], radius):
            i = i + at
            i, j = i[j < i], j[j < i]
            np.minimum.at(best, i, np.bitwise_count(prints[i] ^ prints[j]).astype(np.int64) << 32 | j)
    on = np.flatnonzero(best < 1 << 40)
    return on, best[on] & 0xFFFFFFFF


def _proposed(texts: DataFrame, radius: int) -> DataFrame:
    """(u, v) with u < v: texts with one fingerprint, and with near ones, in as many pairs as texts in each shard."""
    prints = materialize(texts.groupBy("fp").agg(F.min("n").alias("first")))
    equal = texts.select("fp", "n").join(prints, "fp").filter(F.col("n") != F.col("first")).select(F.col("first").alias("u"), F.col("n").alias("v"))
    near = shard_pairs(shards(prints, radius), lambda bits: [nearest_before(bits, radius)], "first", "long")
    return equal.unionByName(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """The texts that pairs name, each side summed up before they are put together."""
    return pairs.select(F.col("u").alias("n")).distinct().unionByName(pairs.select(F.col("v").alias("n")).distinct()).distinct()


def _shingles(df: DataFrame, text: str, texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(n, h): the distinct shingles of the wanted texts, checkpointed; few texts are near another one."""
    named = materialize(texts.select("n", "t").join(wanted, "n", "left_semi"), rows=F.count(F.lit(1)))
    own = df.select(_identity(F.col(f"`{text}`")).alias("t"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    joined = own.join(F.broadcast(named) if named.seen["rows"] <= BROADCAST_ROWS else named, "t")
    one = joined.groupBy("n").agg(F.first("text").alias("text"))

    def start():
        shingles = Shingles().of

        def of(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingles(x).view(np.int64) for x in raw(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["n", "h"])

        return of

    return materialize(map_slices(one, start, "n long, h array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of the pairs whose sets of shingles are similar enough; no pair's texts are ever in Python's memory."""
    both = pairs.select("u", "v").join(sets.select(F.col("n").alias("u"), F.col("h").alias("a")), "u").join(sets.select(F.col("n").alias("v"), F.col("h").alias("b")), "v")
    # common / (all - common) >= similarity, so that the intersection stands here once; the slack is for rounding only.
    common = F.size(F.array_intersect("a", "b")) * F.lit(1.0 + similarity)
    return both.filter(common >= similarity * (F.size("a") + F.size("b")) - 1e-6).select("u", "v")


def _members(rooted: DataFrame) -> DataFrame:
    """The rows (key, n, root) of buckets whose texts are of more than one root, and `rows`, their bucket's size."""
    # Sums first: a bucket of any size is one row of each task.
    sums = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("rows"))
    mixed = sums.filter(F.col("lo") != F.col("hi")).select("key", "rows")
    return materialize(on_split_key(rooted, mixed, "key").select("key", "n", "root", "rows"), most=F.max("rows"))


def _dealt(members: DataFrame, most: int, chunk: int = CHUNK) -> DataFrame:
    """members with columns part, home, major: buckets of over `chunk` rows are dealt over parts.

    Rows of such a bucket's largest root (major) go to their home part, the others to all of its parts. So any two rows
    of different roots meet in the home part of one of them. most: the rows of the largest bucket.
    """
    if most <= chunk:
        return members.select("*", F.lit(0).alias("part"), F.lit(True).alias("home"), F.lit(-1).cast("long").alias("major"))
    roots = members.filter(F.col("rows") > chunk).groupBy("key", "root").agg(F.count(F.lit(1)).alias("of"))
    hot = materialize(roots.groupBy("key").agg(F.max_by("root", F.struct("of", "root")).alias("major")))
    parts = F.ceil(F.col("rows") / chunk).cast("int")
    out = members.join(hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("n"), parts.cast("long")).cast("int"))
    to = F.when(F.coalesce(F.col("root") == F.col("major"), F.lit(True)), F.array("own")).otherwise(F.sequence(F.lit(0), parts - 1))
    out = out.withColumn("part", F.explode(to)).withColumn("home", F.col("own") == F.col("part"))
    return out.select(*members.columns, "part", "home", F.coalesce("major", F.lit(-1).cast("long")).alias("major"))


def _possible(size: np.ndarray, bits: np.ndarray, c: int, like: np.ndarray, similarity: float) -> np.ndarray:
    """Those of the sets `like` that sizes and parities allow to be similar enough to set c."""
    both = size[like] + size[c]
    most = np.minimum((both - np.bitwise_count(bits[like] ^ bits[c]).sum(1, dtype=np.int64)) // 2, np.minimum(size[like], size[c]))
    return like[most * (1 + similarity) >= similarity * both - 1e-6]


def _forest(size: np.ndarray, bits: np.ndarray, root: np.ndarray, home: np.ndarray, top: int, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Texts, each with further ones that it reaches first by a possible pair of two roots; no text is reached twice."""
    unseen, others = np.ones(len(root), bool), np.flatnonzero(root != top)
    for start in others.tolist():  # a pair of two roots has an end outside of top
        todo = [start] if unseen[start] else []
        unseen[start] = False
        while todo:
            c = todo.pop()
            if root[c] == top:
                like = others = others[unseen[others]]
            else:
                like = np.flatnonzero(unseen & (root != root[c]))
            if not home[c]:
                like = like[home[like]]
            like = _possible(size, bits, c, like, similarity)
            if len(like):
                unseen[like] = False
                todo += like.tolist()
                yield c, like


def _bucketed(members: DataFrame, similarity: float, pairs: int | None = None, most: int = 0, chunk: int = CHUNK) -> DataFrame:
    """(key, u, v): with a null key, pairs of texts to compare; else texts u of buckets that have more of them.

    members: key, n, root, rows, FACTS. Pairs of one root need no look, nor do those whose sizes and parities rule the
    similarity out. Without `pairs`, only as many of the others are returned as connect all texts that they connect:
    fewer than the bucket has texts, at once. With it, all are returned, in rounds: one after another, texts outside a
    bucket's largest group are paired with all others and leave it, until it has `pairs` for each of its rows; a bucket
    ends when what is left of it is of one root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for key, _, n, root, size, *bits, home, major in _groups(batches):
            top = major[0]
            if top < 0:
                kinds, counts = np.unique(root, return_counts=True)
                top = kinds[counts.argmax()]
            bits, left, found = np.stack(bits, 1).view(np.uint64), home.copy(), 0
            if pairs is None:
                for c, like in _forest(size, bits, root, home, top, similarity):
                    out.append((np.zeros(len(like), bool), np.zeros(len(like), np.int64), np.minimum(n[like], n[c]), np.maximum(n[like], n[c])))
                    held += len(like)
                if held > 1 << 16:
                    yield made(out)
                    out, held = [], 0
                continue
            todo = np.flatnonzero(root != top).tolist()
            for k, c in enumerate(todo):
                if found >= pairs * len(n):
                    break
                left[c] = False
                like = _possible(size, bits, c, np.flatnonzero(left & (root != root[c])), similarity)
                if len(like):
                    out.append((np.zeros(len(like), bool), np.zeros(len(like), np.int64), np.minimum(n[like], n[c]), np.maximum(n[like], n[c])))
                    found += len(like)
            else:
                k = len(todo)
            left[todo[k:]] = True
            if k < len(todo) and (root[left] != root[left][0]).any():
                out.append((np.ones(int(left.sum()), bool), key[left], n[left], n[left]))
                found += len(n)
            held += found
            if held > 1 << 16:
                yield made(out)
                out, held = [], 0
        if out:
            yield made(out)

    def made(parts: list) -> pa.RecordBatch:
        on, key, u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(key, mask=~on), pa.array(u), pa.array(v)], names=["key", "u", "v"])

    dealt = _dealt(members, most, chunk).repartition("key", "part").sortWithinPartitions("key", "part", "n")
    return dealt.select("key", "part", "n", "root", *FACTS, "home", "major").mapInArrow(run, "key long, u long, v long")


def similar(sets: np.ndarray, ends: np.ndarray, root: np.ndarray, part: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that are similar enough, as few as join all that such pairs and equal roots join.

    sets: the sets' distinct hashes, one set after another; ends: where each of them ends. If there are sets of two
    parts, only pairs of both are looked at. Similar sets share one of their rarest items (as many as a similar set may
    lack, and one more); of the pairs that do, those are counted that sizes and parities allow.
    """
    size = np.diff(ends, prepend=0)
    at, across = ends - size, len(np.unique(part)) > 1
    bits = np.stack([parities(sets[a:b], FINER).view(np.uint64) for a, b in zip(at.tolist(), ends.tolist(), strict=True)])
    _, items, often = np.unique(sets, return_inverse=True, return_counts=True)
    rarity = np.empty(len(often), np.int64)
    rarity[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner, items = np.repeat(np.arange(len(size)), size), rarity[items]
    items = items[np.lexsort((items, owner))]
    rare = np.minimum(size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1, size)
    led = np.flatnonzero(np.arange(len(items)) - at[owner] < rare[owner])
    led = led[np.argsort(items[led], kind="stable")]
    first, having = np.searchsorted(items[led], np.arange(len(often) + 1)), owner[led]
    kinds, label, counts = np.unique(root, return_inverse=True, return_counts=True)
    todo = label != counts.argmax()  # a pair of two roots has an end among these
    mine, u, v = np.zeros(len(often), bool), [], []

    def join(c: int, like: np.ndarray) -> None:
        labels, of = np.unique(label[like], return_index=True)
        u.extend([c] * len(of))
        v.extend(like[of].tolist())
        label[np.isin(label, labels)] = label[c]

    none = np.flatnonzero(size == 0)
    if len(none):
        join(none[0], none[label[none] != label[none[0]]])
    for c in np.flatnonzero(todo & (size > 0)).tolist():
        own = items[at[c] : ends[c]]
        lists = [having[a:b] for a, b in zip(first[own[: rare[c]]].tolist(), first[own[: rare[c]] + 1].tolist(), strict=True) if b - a > 1]
        if not lists:
            continue
        like = np.unique(np.concatenate(lists))
        like = like[label[like] != label[c]]
        if across:
            like = like[part[like] != part[c]]
        like = _possible(size, bits, c, like, similarity)
        if not len(like):
            continue
        mine[own] = True
        to = np.cumsum(size[like])
        common = np.add.reduceat(mine[items[np.arange(to[-1]) + np.repeat(at[like] - (to - size[like]), size[like])]], to - size[like], dtype=np.int64)
        mine[own] = False
        like = like[common * (1 + similarity) >= similarity * (size[like] + size[c]) - 1e-6]
        if len(like):
            join(c, like)
    return np.array(u, np.int64), np.array(v, np.int64)


def _links(clustered: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(u, v): links of similar texts of one cluster, as few as join all that are joined; every pair is looked at.

    clustered: n, cluster, root, size. sets: n, h. Texts of one root are joined already. A cluster of more than a block
    is blocks, and each pair of them is a unit of its own, so that a task's memory is bounded.
    """
    sums = clustered.groupBy("cluster").agg(F.ceil(F.sum(F.col("size") + TEXT) / block).cast("long").alias("blocks"))
    dealt = on_split_key(clustered, sums, "cluster").withColumn("part", F.pmod(F.xxhash64("n"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("unit", F.least("part", "other") * F.col("blocks") + F.greatest("part", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for _, _, n, root, part, h in _groups(batches, 5):
                if (root == root[0]).all():
                    continue
                ends = np.cumsum(h.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                i, j = similar(h.flatten().to_numpy().view(np.uint64), ends, root, part, similarity)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(n[i]), pa.array(n[j])], names=["u", "v"])
        finally:
            n = root = part = h = ends = None
            given_back()

    rows = dealt.select("cluster", "unit", "n", "root", "part").join(sets, "n")
    rows = rows.repartition("cluster", "unit").sortWithinPartitions("cluster", "unit", "n")
    return rows.select("cluster", "unit", "n", "root", "part", "h").mapInArrow(run, "u long, v long")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, t (the text's identity), kept_id, kept_t of each row: the row of its group that stays.

    That is the one with the smallest id (nulls last, then by t). Null texts count as empty; texts without words are
    one group. Rows of equal text are one group without being compared.
    """
    slim = materialize(_sketches(df, doc_id, text))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("least")
    texts = slim.groupBy("t").agg(least, *(F.first(c).alias(c) for c in ("fp", "keys", *FACTS)))
    texts = materialize(texts.withColumn("n", F.monotonically_increasing_id()))  # numbers stand once they are written
    # First the nearest texts by fingerprints ...
    compared = materialize(_proposed(texts, radius))
    sets = _shingles(df, text, texts, _ends(compared))
    roots = components(_verified(compared, sets, similarity))
    # ... then all those of a bucket whose ends these haven't linked, in clusters of possible pairs.
    rooted = texts.select("n", "keys").join(roots.withColumnRenamed("node", "n"), "n", "left")
    members = _members(rooted.select(F.explode("keys").alias("key"), "n", F.coalesce("root", "n").alias("root")))
    facts = members.join(texts.select("n", *FACTS), "n")
    possible = materialize(_bucketed(facts, similarity, most=members.seen["most"] or 0).select("u", "v").distinct(), rows=F.count(F.lit(1)))
    discard(members)
    if possible.seen["rows"]:
        of = components(possible).select(F.col("node").alias("n"), F.col("root").alias("cluster"))
        of = of.join(texts.select("n", "size"), "n").join(roots.withColumnRenamed("node", "n"), "n", "left")
        clustered = materialize(of.select("n", "cluster", F.coalesce("root", "n").alias("root"), "size"))
        sets = sets.unionByName(_shingles(df, text, texts, clustered.select("n").join(sets.select("n"), "n", "left_anti")))
        found = _links(clustered, sets, similarity)
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))
    labels = texts.select("t", "n", "least").join(roots.withColumnRenamed("node", "n"), "n", "left")
    labels = materialize(labels.select("t", "least", F.coalesce("root", "n").alias("root")))
    kept = labels.groupBy("root").agg(F.min("least").alias("kept"))
    by_text = on_split_key(labels, kept, "root").select("t", F.col("kept.doc_id").alias("kept_id"), F.col("kept.t").alias("kept_t"))
    return on_split_key(slim.select("doc_id", "t"), by_text, "t")


def without_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """df with one document of each group of near-duplicates, unchanged, whatever its further columns are called.

    Null texts count as empty, and all texts without words are one group; very long texts are compared whole. Of rows
    with one id and text one stays; of a group's rows the one with the smallest id stays, null ids come last, and ties
    between texts of one id are settled by the texts' MD5. An empty table gives an empty one.
    """
    found = materialize(groups(df, doc_id, text, similarity, radius))
    stays = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("t") == F.col("kept_t"))
    gone = found.filter(~stays).select("doc_id", "t").distinct()
    repeated = found.filter(stays).groupBy("doc_id", "t").count().filter(F.col("count") > 1).drop("count")
    gone, repeated = (materialize(x, rows=F.count(F.lit(1))) for x in (gone, repeated))
    t = free_name(df.columns, "text_identity")
    named = df.withColumn(t, _identity(F.col(f"`{text}`")))
    own = [F.col(f"`{c}`") for c in df.columns]

    def joined(some: DataFrame, how: str, rows: DataFrame = named) -> DataFrame:
        rows_of, some = some.seen["rows"], some.select(F.col("doc_id").alias("listed_id"), F.col("t").alias("listed_t"))
        some = F.broadcast(some) if rows_of <= BROADCAST_ROWS else some
        return rows.alias("rows").join(some.alias("some"), F.col(f"rows.`{doc_id}`").eqNullSafe(F.col("some.listed_id")) & (F.col(f"rows.`{t}`") == F.col("some.listed_t")), how)

    out = joined(gone, "left_anti")
    if not repeated.seen["rows"]:
        return out.select(*own)
    return joined(repeated, "left_anti", out).select(*own).unionByName(joined(repeated, "left_semi").dropDuplicates([doc_id, t]).select(*own))
