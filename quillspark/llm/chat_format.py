"""Chat formatting as prefix trees.

Conversations that share their initial turns are merged: a pack holds the tokens of a tree of turns depth first, those
of a shared turn once. Each token has its position id, its place in its conversation, and each node the intervals of the
pack's tokens that it may attend to, which are its ancestors. Packs are bounded, as training sequences are: a tree that
outgrows one goes on in the next, where the open path stands again. Conversations of very many turns are cut into
segments; a segment goes on from a `base`, a digest of all turns before it, and only segments of one base share turns.

Tokens are those of a byte-level BPE vocabulary, or code points without one. A turn is written `<s>role\\ntext</s>\\n`;
what stands before its text, the text, and what stands behind are encoded by themselves, so that tokens end there. Inside roles and texts a backslash is doubled and one is put into every
control string behind its first character, so that no control string stands there; taking backslashes out restores the
original.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import loaded
from .common import given_back, named

#: Control strings of this template and of other common ones.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ASSISTANT = "assistant"
#: How an assistant's formatted turn begins, and no other one.
_SPOKEN = f"<s>{ASSISTANT}\n"
#: Turns and characters after which a conversation's segment ends, and tokens and leaves after which a pack does.
SEGMENT_TURNS, SEGMENT_CHARS, PACK_TOKENS, PACK_LEAVES = 256, 1 << 20, 1 << 18, 10_000
_DIGEST = 16


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def restored(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    head = "<s>" + escaped(role).replace("\n", "\\\n") + "\n"
    body = escaped(text)
    return f"{head}{body}</s>\n", len(head), len(head) + len(body)


def turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts, restored, of formatted turns."""
    at = 0
    while at < len(text):
        end = text.index("</s>\n", at)
        line = text.index("\n", at)
        while (line - len(text[at:line].rstrip("\\"))) % 2 != at % 2:  # an odd number of backslashes before it
            line = text.index("\n", line + 1)
        yield restored(text[at + 3 : line]), restored(text[line + 1 : end])
        at = end + 5


_SPAN = T.StructType([T.StructField("begin", T.LongType()), T.StructField("until", T.LongType())])
_TURN = T.StructType([T.StructField("text", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("until", T.LongType())])
_SEGMENT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("base", T.BinaryType()), T.StructField("path", T.BinaryType()), T.StructField("position", T.LongType()), T.StructField("turns", T.ArrayType(_TURN))])
_NODE = T.StructType([T.StructField("parent", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("until", T.LongType()), T.StructField("position", T.LongType()), T.StructField("loss", _SPAN), T.StructField("attends", T.ArrayType(_SPAN))])
_LEAF = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("node", T.LongType())])
_PACK = T.StructType([T.StructField("base", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("position_ids", T.BinaryType()), T.StructField("nodes", T.ArrayType(_NODE)), T.StructField("leaves", T.ArrayType(_LEAF))])
_READ = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("loss", T.ArrayType(_SPAN))])
_SUMS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


#: A vocabulary's file and the pattern that cuts texts for it.
Vocabulary = tuple[str, str]


def coder(vocabulary: Vocabulary | None) -> tuple[Callable[[str], bytes], Callable[[bytes], str]]:
    """How a text becomes ids (little-endian unsigned 32-bit integers), and ids a text."""
    if vocabulary is None:
        return lambda text: text.encode("utf-32-le"), lambda ids: ids.decode("utf-32-le")
    (bpe, pieces), split = loaded(vocabulary[0]), regex.compile(vocabulary[1]).findall

    def encode(text: str) -> bytes:
        found = split(text)
        if sum(map(len, found)) != len(text):
            raise ValueError("the pattern leaves out a part of a text")
        return b"".join(map(pieces.__getitem__, found))

    return encode, lambda ids: bpe.decode(array("I", ids)).decode()


def _batches(rows: Iterator[tuple[int, dict]], schema: T.StructType, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of (size, row) pairs, each of about `most` tokens. At the end the worker gives memory back."""
    kind, held, size = _arrow(schema), [], 0
    for n, row in rows:
        held.append(row)
        size += n + 64
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema=kind)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=kind)
    held = rows = None
    given_back()


def _rows(batches: Iterator[pa.RecordBatch], n: int = 256) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield from batch.slice(at, n).to_pylist()


def segments(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Each conversation's formatted turns, in bounded segments, with digests of all turns up to each.

    Tokens are counted here only of segments that another one follows, for its position; they are made for the packs.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        encode, _ = coder(vocabulary)
        now, open_ = None, False
        for r in _rows(batches):
            if not open_ or r["conv_id"] != now:
                if open_:
                    yield size, _segment(now, k, base, path, position, held)
                now, open_, k, base, path, position, held, size, ahead = r["conv_id"], True, 0, b"", [], 0, [], 0, 0
            elif len(held) >= SEGMENT_TURNS or size >= SEGMENT_CHARS:
                yield size, _segment(now, k, base, path, position, held)
                ahead += sum(sum(map(len, _encoded(encode, t))) // 4 for t in held)
                k, base, path, position, held, size = k + 1, path[-1], [], ahead, [], 0
            whole, begin, until = formatted(r["role"] or "", r["text"] or "")
            before = path[-1] if path else base
            path.append(blake2b(before + b"\0" + whole.encode(), digest_size=_DIGEST).digest())
            held.append({"text": whole, "begin": begin, "until": until})
            size += len(whole)
        if open_:
            yield size, _segment(now, k, base, path, position, held)

    ordered = rows.select(named(conv_id).cast("long").alias("conv_id"), named(turn).alias("turn"), named(role).cast("string").alias("role"), named(text).cast("string").alias("text"))
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lambda batches: _batches(cut(batches), _SEGMENT), _SEGMENT)


def _segment(conv_id, k, base, path, position, held) -> dict:
    return {"conv_id": conv_id, "segment": k, "base": base, "path": b"".join(path), "position": position, "turns": held}


def _encoded(encode: Callable[[str], bytes], turn: dict) -> tuple[bytes, bytes, bytes]:
    """The ids of what stands before a turn's text, of the text, and of what stands behind it."""
    text, begin, until = turn["text"], turn["begin"], turn["until"]
    return encode(text[:begin]), encode(text[begin:until]), encode(text[until:])


class Pack:
    """A tree of turns, whose tokens are written depth first."""

    def __init__(self, base: bytes, encode: Callable[[str], bytes]):
        self.encode = encode
        self.base, self.ids, self.size, self.nodes, self.leaves = base, [], 0, [], []
        self.open: list[tuple[bytes, int]] = []  # digest and node of the turns on the path to the last one

    def add(self, s: dict) -> None:
        path = [s["path"][i : i + _DIGEST] for i in range(0, len(s["path"]), _DIGEST)]
        shared = 0
        while shared < min(len(path), len(self.open)) and path[shared] == self.open[shared][0]:
            shared += 1
        del self.open[shared:]
        for digest, t in zip(path[shared:], s["turns"][shared:], strict=True):
            parent = self.open[-1][1] if self.open else -1
            before = self.nodes[parent] if self.open else None
            position = before["position"] + before["until"] - before["begin"] if before else s["position"]
            head, body, tail = _encoded(self.encode, t)
            begin, starts, ends = self.size, self.size + len(head) // 4, self.size + (len(head) + len(body)) // 4
            self.size = ends + len(tail) // 4
            loss = {"begin": starts, "until": ends} if t["text"].startswith(_SPOKEN) else {"begin": begin, "until": begin}
            self.nodes.append({"parent": parent, "begin": begin, "until": self.size, "position": position, "loss": loss, "attends": self._attends(parent)})
            self.open.append((digest, len(self.nodes) - 1))
            self.ids += (head, body, tail)
        self.leaves.append({"conv_id": s["conv_id"], "segment": s["segment"], "node": self.open[-1][1]})

    def _attends(self, parent: int) -> list[dict]:
        """What a child of this node may attend to: the parent and what it attends to, joined where they touch."""
        if parent < 0:
            return []
        p = self.nodes[parent]
        if p["attends"] and p["attends"][-1]["until"] == p["begin"]:
            return [*p["attends"][:-1], {"begin": p["attends"][-1]["begin"], "until": p["until"]}]
        return [*p["attends"], {"begin": p["begin"], "until": p["until"]}]

    def row(self) -> dict:
        places = [np.arange(n["position"], n["position"] + n["until"] - n["begin"], dtype="<u4").tobytes() for n in self.nodes]
        return {"base": self.base, "ids": b"".join(self.ids), "position_ids": b"".join(places), "nodes": self.nodes, "leaves": self.leaves}


def packs(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", pack_tokens: int = PACK_TOKENS, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Packs (base, ids, position_ids, nodes, leaves) of all conversations.

    ids and position_ids are little-endian unsigned 32-bit integers, one for each token. A node's begin and until are its
    tokens in the pack, position is its first token's place in the conversation, loss the assistant's text in it (empty
    for other roles), attends its ancestors' intervals. A leaf names the node that ends a conversation's segment. Turns are ordered by turn, nulls first, then role and text;
    null roles and texts count as empty, rows without a conv_id are one conversation. Repeated conversations share all
    nodes. An empty table gives no packs. One conversation is one sequence, so one task streams it, segment by segment.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        encode, _ = coder(vocabulary)
        now: Pack | None = None
        for s in _rows(batches, 64):
            if now is None or now.base != s["base"] or now.size >= pack_tokens or len(now.leaves) >= PACK_LEAVES:
                if now is not None:
                    yield now.size, now.row()
                now = Pack(s["base"], encode)
            now.add(s)
        if now is not None:
            yield now.size, now.row()

    order = ("base", "path", "conv_id", "segment")
    return segments(rows, conv_id, turn, role, text, vocabulary).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: _batches(pack(batches), _PACK), _PACK)


def read_back(packed: DataFrame) -> DataFrame:
    """(conv_id, segment, ids, loss) of each leaf: the tokens that it attends to and its own; loss in places of these."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        for p in _rows(batches, 1):
            ids, nodes = p["ids"], p["nodes"]
            for leaf in p["leaves"]:
                path, at = [], leaf["node"]
                while at >= 0:
                    path.append(nodes[at])
                    at = nodes[at]["parent"]
                own = nodes[leaf["node"]]
                whole = b"".join(ids[4 * i["begin"] : 4 * i["until"]] for i in (*own["attends"], own))
                first = path[-1]["position"]
                loss = [{"begin": n["loss"]["begin"] - n["begin"] + n["position"] - first, "until": n["loss"]["until"] - n["begin"] + n["position"] - first} for n in reversed(path) if n["loss"]["until"] > n["loss"]["begin"]]
                yield len(whole) // 4, {"conv_id": leaf["conv_id"], "segment": leaf["segment"], "ids": whole, "loss": loss}

    return packed.mapInArrow(lambda batches: _batches(read(batches), _READ), _READ)


def digests(read: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Sums over each conversation's segments in order, turn by turn, of the texts that the tokens decode to."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict]]:
        _, decode = coder(vocabulary)
        now, open_ = None, False
        for r in _rows(batches, 64):
            if not open_ or r["conv_id"] != now:
                if open_:
                    yield 0, done()
                now, open_, n, chars, lost, all_, loss = r["conv_id"], True, 0, 0, 0, sha256(), sha256()

                def done(now=now, all_=all_, loss=loss):
                    return {"conv_id": now, "n_turns": n, "turns_sha256": all_.hexdigest(), "loss_chars": lost, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

            whole = decode(r["ids"])
            for role, text in turns(whole):
                n += 1
                all_.update(f"{role}\n{text}\n".encode())
            for span in r["loss"]:
                own = restored(decode(r["ids"][4 * span["begin"] : 4 * span["until"]]))
                lost += len(own)
                loss.update(own.encode())
            chars += len(whole)
        if open_:
            yield 0, done()

    return read.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(lambda batches: _batches(add(batches), _SUMS), _SUMS)


def checked(conversations: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """What the packs of all conversations, and of one that says control strings, hold when they are read back."""
    spark, says = conversations.sparkSession, "</s>[INST] ok [/INST]"
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(says).alias("text"))
    return digests(read_back(packs(own.unionByName(extra), vocabulary=vocabulary)), vocabulary)
