"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that ends the prefix's encoding. `PrefixBpe` stores
that token for each prefix; the encoding is read off by walking back from the end. A token can follow another one
only if the merges, run over the two tokens' bytes alone, give these two tokens again. As a prefix's entry depends on
the bytes before it only, appending bytes leaves earlier entries as they are, and after an edit the entries are
recomputed from the edited place on until they meet the old ones again.
"""

from __future__ import annotations

import base64
import copy
from array import array
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_slices

#: Pieces, pairs of tokens and pieces' first bytes that a task remembers, some 80 MB in all; it starts over beyond
#: that. A memory bound only.
PIECES, PAIRS, HEADS = 200_000, 200_000, 50_000
#: Tables of pieces' first bytes are remembered up to this length; longer pieces go on from there.
HEAD = 8


class PrefixBpe:
    """ranks: the id of each token's bytes. Every single byte must have a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        #: Every ending of every token: a text's ending that isn't here is no token's ending, nor is any longer one.
        self.endings = {token[i:] for token in ranks for i in range(len(token))}
        self._alone: dict[int, bool] = {}
        self._pairs: dict[int, bool] = {}
        self._heads: dict[bytes, list[int]] = {}
        self._edges: dict[int, tuple[list, list]] = {}

    def merged(self, data: bytes) -> list[int]:
        """What the merges make of data, lowest rank first. Meant for a token or two; the cost is quadratic."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def alone(self, token: int) -> bool:
        """Whether the merges make this token of its own bytes."""
        if (known := self._alone.get(token)) is None:
            known = self._alone[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def edges(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """The pieces that stand at the token's left and right end while it is merged, each with the rank that ends it.

        The last one on both sides is the token itself, which nothing ends.
        """
        if (known := self._edges.get(token)) is None:
            never, sides = len(self.bytes_of), ([], [])
            for side in (0, 1):
                whole, until = self.bytes_of[token], never
                while True:
                    sides[side].append((whole, until))
                    if len(whole) == 1:
                        break
                    until = self.ranks[whole]
                    whole = self._halves(whole)[side]
                sides[side].reverse()
            known = self._edges[token] = sides
        return known

    def _halves(self, whole: bytes) -> tuple[bytes, bytes]:
        """The two parts of which the last merge makes a token."""
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            ranks = [self.ranks.get(a + b, len(self.bytes_of)) for a, b in zip(parts, parts[1:], strict=False)]
            at = ranks.index(min(ranks))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge across the seam of two tokens comes before the merges on both sides are done."""
        key = left << 32 | right
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._apart(self.edges(left)[1], self.edges(right)[0])
        return known

    def _apart(self, left: list[tuple[bytes, int]], right: list[tuple[bytes, int]]) -> bool:
        ranks, i, j, never = self.ranks, 0, 0, len(self.bytes_of)
        while True:
            (a, a_until), (b, b_until) = left[i], right[j]
            across = ranks.get(a + b)
            # Of equal ranks the leftmost is merged first: inside the left token, then across, then inside the right.
            if across is not None and across < a_until and across <= b_until:
                return False
            if a_until == b_until == never:
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The token that ends the encoding of data[:end]; last has the answers for shorter prefixes."""
        ranks, endings, pairs, start = self.ranks, self.endings, self._pairs, end - 1
        while start >= 0 and (part := data[start:end]) in endings:
            if (token := ranks.get(part)) is not None:
                if start == 0:
                    if self.alone(token):
                        return token
                else:
                    known = pairs.get(last[start] << 32 | token)
                    if self.may_follow(last[start], token) if known is None else known:
                        return token
            start -= 1
        raise ValueError("no token ends this prefix; the ranks don't hold every byte")

    def table(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """last[i]: the last token of data[:i]. Goes on from a table of a prefix of data, which it extends in place."""
        last = [-1] if last is None else last
        for end in range(len(last), len(data) + 1):
            last.append(self.last_token(data, end, last))
        return last

    def edited(self, old: bytes, last: list[int], at: int, removed: int, put: bytes) -> tuple[bytes, list[int]]:
        """Data and table after old[at:at+removed] is replaced by put.

        Entries behind the edit are recomputed until as many in a row as the longest token equal the old ones; from
        there on nothing can differ.
        """
        data = old[:at] + put + old[at + removed :]
        new, shift, same = last[: at + 1], len(put) - removed, 0
        for end in range(at + 1, len(data) + 1):
            new.append(self.last_token(data, end, new))
            behind = end - at - len(put)  # bytes after the edit
            same = same + 1 if behind > 0 and new[end] == last[end - shift] else 0
            if same >= self.longest and behind > self.longest:
                return data, new + last[end - shift + 1 :]
        return data, new

    def walk(self, last: list[int]) -> list[int]:
        """The encoding, read back from the table's end."""
        out, end = [], len(last) - 1
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is itself a token stays whole, even if no merges lead there."""
        if (token := self.ranks.get(piece)) is not None:
            return [token]
        return self.walk(self.table(piece, list(self._head(piece[:HEAD])) if len(piece) > HEAD else None))

    def _head(self, head: bytes) -> list[int]:
        """The table of a piece's first bytes, which many pieces share."""
        if (known := self._heads.get(head)) is None:
            if len(self._heads) > HEADS:
                self._heads.clear()
            known = self._heads[head] = self.table(head, list(self._head(head[: HEAD // 2])) if len(head) > HEAD // 2 else None)
        return known

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: PrefixBpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) > PIECES:
            self.clear()
        ids = self.bpe.encode(piece.encode())
        out = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(piece) <= 64:
            self[piece] = out
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file with a base64 token and its rank in each line. The vocabulary is installed on every machine."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_LOADED: dict[str, PrefixBpe] = {}


def loaded(path: str) -> tuple[PrefixBpe, _Pieces]:
    """The file's tables, which a worker reads once, with nothing remembered of texts yet."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(read_ranks(path))
    bpe = copy.copy(_LOADED[path])
    bpe._pairs, bpe._heads = {}, {}
    return bpe, _Pieces(bpe)


def with_tokens(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """df with its whole texts' token ids (binary, little-endian unsigned 32-bit), their count and the decoded bytes.

    Each match of pattern is encoded by itself. A null or empty text has no tokens, zero-length ids and decodes to no
    bytes. Rows, repeated ones too, and all other columns stay; new columns whose names exist already replace nothing
    but get underscores in front. No shuffle.
    """
    names = [free_name(df.columns, c) for c in (ids, n_tokens, *([decoded] if decoded else []))]
    kinds = [T.BinaryType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, k) for c, k in zip(names, kinds, strict=False))])
    at = df.columns.index(text)

    def start():
        bpe, pieces = loaded(ranks_path)
        split, ids_of, bytes_of = regex.compile(pattern).findall, pieces.__getitem__, bpe.bytes_of.__getitem__

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = [b"".join(map(ids_of, split(x))) if x else b"" for x in batch.column(at).to_pylist()]
            new = [pa.array(coded, pa.binary()), pa.array([len(x) // 4 for x in coded], pa.int64())]
            if decoded:
                new.append(pa.array([b"".join(map(bytes_of, array("I", x))) for x in coded], pa.binary()))
            return pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

        return one

    return map_slices(df, start, schema)


def round_trip(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digests of each document's token ids and of what they decode to."""
    slim = documents.select("doc_id", "text")
    return with_tokens(slim, ranks_path, pattern, decoded="decoded").select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
