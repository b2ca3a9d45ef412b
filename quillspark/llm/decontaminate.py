"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's normalised texts.

Texts are normalised to their lower-cased words, which are the automaton's symbols. Its patterns are each item's
aligned blocks of half a window, one after another, so that it grows with the benchmark's text and not with its windows:
every window contains a whole block. Each text is scanned once; where a block occurs, the words around it are compared
with those around it in the item, and hits are mapped back to places in the original text.
"""

from __future__ import annotations

import itertools
import re
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_slices, materialize, raw, words

WINDOW = 10
#: Bytes of benchmark text in one automaton, which takes about 20 times as many in each worker. A larger benchmark is
#: broadcast and scanned part by part.
PART_BYTES = 8 << 20

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("until", T.LongType())]))
_AUTOMATA: dict[str, "Windows"] = {}


def parts(benchmark: DataFrame, item_id: str, text: str, part_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Lists of (item id as text, text's words with spaces between), each of no more than part_bytes (or one item)."""
    sized = benchmark.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    part, size = [], 0
    for row in sized.toLocalIterator():
        found = b" ".join(words(row.t.encode() if row.t else None))
        if part and size + len(found) > part_bytes:
            yield part
            part, size = [], 0
        if found:
            part.append((row.id, found))
            size += len(found)
    if part:
        yield part


class Windows:
    """An automaton over words for items (id, words); window: the words of a window, at least 1.

    A word's symbol is written in a few digits of an alphabet for each place, as nodes are slow with many children.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.block, self.reach = -(-window // 2), window - -(-window // 2)
        self.ids, self.symbols = [i for i, _ in items], {}
        flat, starts = array("l", [0]), array("l")  # a zero, which is no word, stands between items
        for _, ws in items:
            starts.append(len(flat))
            flat.extend(self.symbols.setdefault(w, len(self.symbols) + 1) for w in ws)
            flat.append(0)
        self.flat, self.starts, self.places = flat, np.array(starts), max(1, -(-len(self.symbols).bit_length() // 6))
        self.codes = ["".join(chr((p << 6) + (k >> 6 * p & 63) + 1) for p in reversed(range(self.places))) for k in range(len(self.symbols) + 1)]
        self.codes[0] = "\0" * self.places
        spots: dict[str, list[int]] = {}
        known: set[int] = set()
        for item, ((name, ws), at) in enumerate(zip(items, starts, strict=True)):
            if len(ws) < window:
                spots.setdefault(self._code(flat[at : at + len(ws)]), []).append(~item)
                continue
            for k in range(at, at + len(ws) - self.block + 1, self.block):
                # A block with the same words around it, in the same item, finds nothing new.
                around = (name, flat[max(at, k - self.reach) : k + self.block + self.reach].tobytes(), k - at if k - at < self.reach else -1)
                digest = xxhash.xxh3_128_digest(repr(around).encode())
                if digest not in known:
                    known.add(digest)
                    spots.setdefault(self._code(flat[k : k + self.block]), []).append(k)
        self.tree = ahocorasick.Automaton() if spots else None
        for key in list(spots):
            self.tree.add_word(key, (len(key) // self.places, *spots.pop(key)))
        if self.tree is not None:
            self.tree.make_automaton()

    def _code(self, symbols) -> str:
        return "".join(map(self.codes.__getitem__, symbols))

    def scan(self, ws: list[bytes]) -> tuple[dict[int, int], set[str]]:
        """The last word of each stretch of windows with the stretch's length, and the items of the windows."""
        ends: dict[int, int] = {}
        items: set[str] = set()
        symbol, flat, reach, places = self.symbols.get, self.flat, self.reach, self.places
        text = [symbol(w, 0) for w in ws]
        for at, (n, *spots) in self.tree.iter(self._code(text)):
            last = at // places
            for k in spots:
                if k < 0:
                    items.add(self.ids[~k])
                    ends[last] = max(n, ends.get(last, 0))
                    continue
                first, left, right = last - n + 1, 0, 0
                while left < reach and left < first and flat[k - left - 1] == text[first - left - 1] != 0:
                    left += 1
                while right < reach and last + right + 1 < len(text) and flat[k + n + right] == text[last + right + 1] != 0:
                    right += 1
                if left + right >= reach:
                    items.add(self.ids[int(np.searchsorted(self.starts, k, "right")) - 1])
                    ends[last + right] = max(left + n + right, ends.get(last + right, 0))
        return ends, items


def _merged(ends: dict[int, int]) -> list[tuple[int, int]]:
    """Word ranges [first, last] from the windows' last words and lengths."""
    out: list[list[int]] = []
    for first, last in sorted((last - n + 1, last) for last, n in ends.items()):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def _places(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Character offsets in the original text of ranges of words."""
    found = [m.span() for m in _WORD.finditer(text)]
    out, chars, at = [], 0, 0
    for first, last in ranges:
        chars += len(text[at : found[first][0]].decode())
        begin, at = chars, found[first][0]
        chars += len(text[at : found[last][1]].decode())
        at = found[last][1]
        out.append({"begin": begin, "until": chars})
    return out


def with_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """df with n_words, n_hit, items and spans of each whole text.

    A window is `window` consecutive words of a benchmark item, or all words of a shorter item. n_hit counts the words
    inside occurrences of windows; items has the ids (as text, sorted, distinct) of the items whose windows occur;
    spans has the occurrences' merged places in the original text, in characters.

    Null or empty texts have no words, and very long ones are scanned whole. Items without words have no windows, a null
    id counts as an empty one, repeated items count once. Rows, repeated ones too, and other columns stay as they are; a
    clashing new name gets underscores in front. An empty table gives an empty one, an empty benchmark no hits. The
    benchmark is broadcast in parts of part_bytes; with more than one, the frame is written once with numbered rows, and
    each part adds the hits by number.
    """
    names = [free_name(df.columns, c) for c in ("n_words", "n_hit", "items", "spans")]
    found = list(itertools.islice(held_parts := parts(benchmark, item_id, item_text, part_bytes), 2))
    if len(found) < 2:
        return _with_part(df, found[0] if found else [], text, window, names)
    row = free_name([*df.columns, *names], "row")
    numbered = materialize(df.withColumn(row, F.monotonically_increasing_id()))
    slim, hits = numbered.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text}`").alias("text")), None
    for part in itertools.chain(found, held_parts):
        one = _with_part(slim, part, "text", window, ["n_words", "n_hit", "items", "spans"])
        one = materialize(one.filter("n_hit > 0").select("row", "items", "spans"))
        hits = one if hits is None else hits.unionByName(one)
    both = hits.groupBy("row").agg(F.flatten(F.collect_list("items")).alias("some_items"), F.flatten(F.collect_list("spans")).alias("some_spans"))
    out = _with_part(numbered, [], text, window, names)
    joined = out.join(both.withColumnRenamed("row", "hit_row"), F.col(f"`{row}`") == F.col("hit_row"), "left")
    fixed = _united(joined.select(*(F.col(f"`{c}`") for c in out.columns if c not in (names[1], names[2], names[3])), "some_items", "some_spans"), text, names)
    return fixed.select(*(f"`{c}`" for c in [*df.columns, *names]))


def _schema(df: DataFrame, drop: int, names: list[str]) -> T.StructType:
    kinds = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "spans": _SPANS}
    return T.StructType([*df.schema.fields[: len(df.columns) - drop], *(T.StructField(c, k) for c, k in zip(names, list(kinds.values())[-len(names) :], strict=True))])


def _found(n_hit: list, items: list, spans: list) -> list[pa.Array]:
    return [pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("until", pa.int64())])))]


def _with_part(df: DataFrame, items: list[tuple[str, bytes]], text: str, window: int, names: list[str]) -> DataFrame:
    schema, at = _schema(df, 0, names), df.columns.index(text)
    held, key = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def start():
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[key] = Windows([(i, t.split()) for i, t in held.value], window)
        windows = _AUTOMATA[key]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, n_hit, found, spans = [], [], [], []
            for x in raw(batch.column(at)):
                ws = words(x)
                ends, of = windows.scan(ws) if windows.tree is not None and ws else ({}, set())
                ranges = _merged(ends)
                n_words.append(len(ws))
                n_hit.append(sum(b - a + 1 for a, b in ranges))
                found.append(sorted(of))
                spans.append(_places(x, ranges) if ranges else [])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), *_found(n_hit, found, spans)], names=schema.names)

        return one

    return map_slices(df, start, schema)


def _united(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """n_hit, items and spans of the hits of all parts, which the last two columns hold."""
    schema, at = _schema(df, 2, names[1:]), df.columns.index(text)

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_hit, found, spans = [], [], []
            for x, items, of in zip(raw(batch.column(at)), batch.column(-2 % len(batch.columns)).to_pylist(), batch.column(-1 % len(batch.columns)).to_pylist(), strict=True):
                ranges = _ranges(x, of) if of else []
                n_hit.append(sum(b - a + 1 for a, b in ranges))
                found.append(sorted(set(items or [])))
                spans.append(_places(x, ranges) if ranges else [])
            return pa.RecordBatch.from_arrays([*batch.columns[:-2], *_found(n_hit, found, spans)], names=schema.names)

        return one

    return map_slices(df, start, schema)


def _ranges(text: bytes, spans: list[dict]) -> list[tuple[int, int]]:
    """The merged word ranges that spans (of characters) cover."""
    found, chars, at = [], 0, 0
    for m in _WORD.finditer(text):
        chars += len(text[at : m.start()].decode())
        found.append(chars)
        at = m.start()
    ends: dict[int, int] = {}
    for s in spans:
        first, last = bisect_left(found, s["begin"]), bisect_left(found, s["until"]) - 1
        ends[last] = max(last - first + 1, ends.get(last, 0))
    return _merged(ends)


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each document's hits as numbers and a digest of the items."""
    return with_contamination(documents.select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """df's rows without those in which a window of the benchmark occurs; the columns stay."""
    marked = with_contamination(df, benchmark, text)
    return marked.filter(F.col(f"`{marked.columns[len(df.columns) + 1]}`") == 0).select(*(f"`{c}`" for c in df.columns))
