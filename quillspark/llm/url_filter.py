"""URL filter: a weighted vocabulary found by Aho-Corasick with boundary checks, under a list of rules.

A URL is blocked on one strict term or on several distinct soft terms. A term counts only where no letter or digit
stands directly before or after it. Rules for hosts and paths go before the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import LOWER, free_name, map_slices, raw

STRICT = ("porn", "porno", "xxx", "xvideos", "hentai", "escort", "escorts", "viagra", "cialis", "casino", "phishing", "malware", "warez", "keygen", "spam-farm", "linkfarm", "payday-loan")
SOFT = ("adult", "sex", "sexy", "nude", "naked", "cam", "cams", "dating", "hookup", "bet", "bets", "betting", "poker", "slots", "jackpot", "gambling", "loan", "loans", "pills", "pharmacy", "cheap", "discount", "free", "crack", "cracked", "torrent", "download", "replica", "spam", "click", "popup", "bonus", "win", "crypto")
#: Distinct soft terms that block.
SOFT_LIMIT = 2


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))


def host_and_path(url: bytes | None) -> tuple[bytes, bytes]:
    """Host, lower-cased, and path; both empty without '://'."""
    if url is None or (at := url.find(b"://")) < 0:
        return b"", b""
    rest = url[at + 3 :]
    cut = min((i for i in map(rest.find, (b"/", b"?", b"#")) if i >= 0), default=len(rest))
    path = rest[cut:]
    return rest[:cut].translate(LOWER), path[: min((i for i in map(path.find, (b"?", b"#")) if i >= 0), default=len(path))]


class Rules:
    """The longest rule that fits a host (or a domain above it) and the start of a path."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.by_host: dict[bytes, list[Rule]] = {}
        for r in rules:
            self.by_host.setdefault(r.host.encode(), []).append(r)

    def find(self, host: bytes, path: bytes) -> Rule | None:
        best, labels = None, host.split(b".")
        for i in range(len(labels)):
            for r in self.by_host.get(b".".join(labels[i:]), ()):
                if path.startswith(r.path.encode()) and (best is None or (len(r.name), r.name) > (len(best.name), best.name)):
                    best = r
        return best


def vocabulary(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton | None:
    terms = {**dict.fromkeys(soft, False), **dict.fromkeys(strict, True)}
    if not terms:
        return None
    a = ahocorasick.Automaton()
    for term, is_strict in terms.items():
        a.add_word(term, (term, is_strict))
    a.make_automaton()
    return a


def hits(url: bytes | None, a: ahocorasick.Automaton | None) -> tuple[set[str], set[str]]:
    """Strict and soft terms that stand by themselves in the lower-cased URL."""
    strict: set[str] = set()
    soft: set[str] = set()
    if url and a is not None:
        low = url.translate(LOWER).decode("latin-1")
        for last, (term, is_strict) in a.iter(low):
            first = last - len(term) + 1
            if not (first and _in_word(low[first - 1])) and not (last + 1 < len(low) and _in_word(low[last + 1])):
                (strict if is_strict else soft).add(term)
    return strict, soft


def _in_word(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9" or c >= "\x80"


def with_verdicts(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """df with host, path, rule, verdict (allow or block), n_strict, n_soft (distinct terms).

    Null URLs and URLs without '://' have an empty host and path and fit no rule; the vocabulary still reads the
    whole URL, and null has no terms. Rows, repeated ones too, and other columns stay; a clashing new name gets
    underscores in front. No shuffle; the vocabulary is a parameter, not data.
    """
    kinds = {"host": T.StringType(), "path": T.StringType(), "rule": T.StringType(), "verdict": T.StringType(), "n_strict": T.LongType(), "n_soft": T.LongType()}
    names = {c: free_name(df.columns, c) for c in kinds}
    schema = T.StructType([*df.schema.fields, *(T.StructField(names[c], k) for c, k in kinds.items())])
    at = df.columns.index(url)

    def start():
        known, a = Rules(rules), vocabulary(strict, soft)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in kinds]
            for x in raw(batch.column(at)):
                host, path = host_and_path(x)
                rule = known.find(host, path)
                hard, mild = hits(x, a)
                verdict = rule.verdict if rule else "block" if hard or len(mild) >= soft_limit else "allow"
                for values, v in zip(out, (host.decode(), path.decode(), rule.name if rule else None, verdict, len(hard), len(mild)), strict=True):
                    values.append(v)
            new = [pa.array(v, pa.int64() if c.startswith("n_") else pa.string()) for c, v in zip(kinds, out, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

        return one

    return map_slices(df, start, schema)


def judged(pages: DataFrame) -> DataFrame:
    return with_verdicts(pages.select("page_id", "url")).drop("url")
