"""The training-data operators on small and odd tables, against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat_format, components, decontaminate, language_id, license_scan, line_dedup, sharding, simhash, simhash_dedup, topk, url_filter
from quillspark.llm.queries import vocabulary_file

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, no text, no words, repeated rows, ties, other scripts, control characters, a very long text.
ODD = [None, "", " \n\t ", "!!! ...", "one", "One", "a b c", "É à ü ÀÉ", "中文 文字", "x" * 5000, "the end\r\nof\x0bit\x1fall \x00 \u00a0 z", "😀 smile 😀", "tie tie tie tie tie tie", "tie tie tie tie tie tie", "'s don't we'll 12345 6.7 \n\n\n  x  "]


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    df = docs(spark, [*ODD, "word " * 60_000])
    return df.unionByName(df.filter("doc_id = 5")).unionByName(spark.createDataFrame([(None, "no id", None, None, None)], DOCS))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clash(df, *names):
    """df with columns that have the names of results."""
    for n in names:
        df = df.withColumn(n, F.lit("old"))
    return df


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# URL filters


def test_url_filter(spark):
    urls = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/porn": ("", "", None, "block"), "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"), "https://x.www.example.com/en": ("x.www.example.com", "/en", "com/", "allow"), "x://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"), "x://net/fr/": ("net", "/fr/", "net/fr/", "block"),
        "x://planet/fr/": ("planet", "/fr/", None, "allow"), "x://a.com": ("a.com", "", None, "allow"), "x://a.com?x=/": ("a.com", "", None, "allow"), "x://porn.com/": ("porn.com", "/", "com/", "allow"), "x://a.org/porn": ("a.org", "/porn", None, "block"), "x://a.org/pornography": ("a.org", "/pornography", None, "allow"),
        "x://a.org/free": ("a.org", "/free", None, "allow"), "x://a.org/free/free": ("a.org", "/free/free", None, "allow"), "x://a.org/free?WIN=1": ("a.org", "/free", None, "block"), "x://spam-farm.org#x": ("spam-farm.org", "", None, "block"), "x://a.org/éfree/win": ("a.org", "/éfree/win", None, "allow"), "x://a#b://c/d": ("a", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert got == dict(enumerate(urls.values()))
    extra = url_filter.with_verdicts(clash(pages, "host", "VERDICT").unionByName(clash(pages, "host", "VERDICT")))
    assert extra.count() == 2 * len(urls) and {"_host", "_verdict", "host", "VERDICT"} <= set(extra.columns)
    assert url_filter.judged(pages.limit(0)).count() == 0


# Language identification


def test_language_id(spark, documents, odd):
    got = language_id.predicted(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert got.held_out.any() and (got.lang == got.lang_pred)[got.held_out].mean() > 0.98 and not got.rejected.any() and got.score.between(0, 1).all()
    model = language_id.train(documents)
    rows = language_id.with_language(clash(odd, "score"), model).select("text", "lang_pred", "_score", "rejected").collect()
    assert len(rows) == odd.count()
    for text, lang, score, rejected in rows:
        known = bool(text) and any(map(str.isalpha, text))
        assert (lang == "und") == (not known) and 0 <= score <= 1 and (known or rejected)
    assert [r.rejected for r in language_id.with_language(docs(spark, ["привет как дела сегодня хорошо " * 20]), model).collect()] == [True]
    # Neither null nor repeated ids, nor a row that fills a language, keep a language from being learned.
    words = {"aa": "uno dos tres cuatro cinco", "bb": "eins zwei drei vier", "cc": "hat nagy kicsi fehér"}
    many = [(None if i % 2 else 7, f"{words[k]} {i % 50} " * 3, k, "s", None) for k in words for i in range(600 if k != "cc" else 1)]
    many += [(9, "same row here", "aa", "s", None)] * 2000
    got = language_id.predicted(spark.createDataFrame([(None if i is None else i * 4, *x) for i, *x in many], DOCS)).groupBy("lang_pred").count().collect()
    assert {r[0]: r[1] for r in got} == {"aa": 2600, "bb": 600, "cc": 1}
    # The nearest centroid by cosine, with vectors made in a plain way.
    texts = [r.text for r in documents.limit(60).collect()] + ["la casa", "the house 12"]
    for t in texts:
        low = b" " + b" ".join(words_of(t)) + b" " if hasattr(words_of(t)[0], "decode") else (" " + " ".join(words_of(t)) + " ").encode()
        at, counts = language_id.trigrams(t.encode())
        assert counts.sum() >= len(low) - 2
        v = np.zeros(1 << language_id.BITS)
        for a, n in zip(at, counts, strict=True):
            v[a] = (1 + math.log(n)) * model.idf[a]
        cosines = [float(v @ c / (np.linalg.norm(v))) for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        name, score, _ = model.predict(t)
        assert name == model.languages[model.of[best]] and abs(score - min(1, max(0, cosines[best]))) < 1e-5
    empty = language_id.predicted(documents.limit(0))
    assert empty.count() == 0
    assert {r.lang_pred for r in language_id.predicted(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# Licence scans


def test_license_scan(spark, odd):
    texts = ["MIT License", "mit-license, MIT  LICENSE", "the gnu general public license and apache license; cc-by", "cc by cc by", "mitlicense", "license mit", None, "", "gnu general", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "under the GNU General Public License as published by the Free Software Foundation", "x " * 30_000 + "MIT license " * 2000]
    got = license_scan.labelled(docs(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        ws = words_of(t)
        places = [(i, x.label) for x in license_scan.BASE for i in range(len(ws)) if [w.decode() for w in x.words] == ws[i : i + len(x.words)]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "mit-terms" in got[9].labels and got[9].n_base == 0 and got[9].score == 1 and got[10].labels == "gpl,gpl-notice"
    assert license_scan.with_licenses(clash(odd, "matches")).count() == odd.count() and license_scan.labelled(odd.limit(0)).count() == 0


def brute_places(ws, templates):
    """(label, start) of every place with all key phrases, by comparing every template at every place."""
    out = []
    for t in templates:
        for start in range(-len(t.words), len(ws)):
            if all(start + at >= 0 and ws[start + at : start + at + len(k)] == k for at, k in t.key_places):
                out.append((t.label, start))
    return sorted(out)


def test_license_index_finds_all_places():
    rng = random.Random(5)
    templates = (*license_scan.BASE, *license_scan.NOTICES)
    vocabulary = sorted({w for t in templates for _, k in t.key_places for w in k})
    for round_ in range(300):
        idf = {w: rng.choice([0.0, 1.0, rng.random()]) for w in vocabulary if rng.random() < 0.9}
        index = license_scan.Index(license_scan.BASE, license_scan.NOTICES, idf)
        ws = []
        for _ in range(rng.randrange(12)):
            t = rng.choice(templates)
            ws += rng.choice([t.words, t.words[rng.randrange(len(t.words)) :], [rng.choice(vocabulary)], [b"x"], [w for _, k in t.key_places for w in k]])
        got = sorted((index.templates[i][0], start) for i, start, _ in index.scan(ws))
        assert got == brute_places(ws, templates), round_


def test_license_words_looked_up():
    idf = {w: 1.0 for t in (*license_scan.BASE, *license_scan.NOTICES) for w in t.words} | {b"gnu": 5.0, b"mit": 4.0}
    index = license_scan.Index(license_scan.BASE, license_scan.NOTICES, idf)
    able, taken = index.looked_up(frozenset([b"gnu", b"mit", b"license", b"by"]))
    assert [index.templates[i][0] for i in able] == ["mit"] and taken == [b"mit", b"license"], "gnu is rarer, but no template with it can stand here"
    assert index.looked_up(frozenset([b"gnu", b"public"])) == ([], [])


# Line dedup


def test_line_dedup(spark, odd):
    rows = [(i, f"menu\nown {i}\n\n menu \nend" if i < 30 else f"own {i}\nmenu" if i < 33 else f"own {i}", "en", "a" if i < 30 else "b", None) for i in range(60)]
    df = spark.createDataFrame([*rows, (60, None, "en", "a", None), (61, "menu", "en", None, None), (62, "", "en", "a", None)], DOCS)
    for limit in (line_dedup.BROADCAST_LINES, 0):
        got = {r.doc_id: r for r in line_dedup.without_boilerplate(clash(df, "n_lines"), broadcast_lines=limit).collect()}
        assert got[3].text == "own 3\n" and got[3]._n_lines == 5 and got[3].n_dropped == 3, "blank lines stay"
        assert got[31].text == "own 31\nmenu" and got[31].n_dropped == 0, "boilerplate is a matter of the site"
        assert got[60].text is None and got[61].text == "menu" and got[62].text == "" and got[60]._n_lines == 0 and len(got) == 63
    assert line_dedup.without_boilerplate(odd).count() == odd.count() and line_dedup.cleaned(odd.limit(0)).count() == 0
    twice = df.unionByName(df)
    assert line_dedup.without_boilerplate(twice).count() == 126


# Decontamination


def brute_contamination(texts, items):
    out = []
    for t in texts:
        ws, hit, of = words_of(t), set(), set()
        for item, x in items:
            iw = words_of(x)
            n = min(10, len(iw))
            for i, j in itertools.product(range(len(iw) - n + 1 if n else 0), range(len(ws) - n + 1)):
                if iw[i : i + n] == ws[j : j + n]:
                    hit |= set(range(j, j + n))
                    of.add(str(item))
        out.append((len(ws), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_memory():
    """The automaton grows with the benchmark's text, not with its windows."""
    import subprocess
    import sys

    code = """
import random
from quillspark.llm.decontaminate import Windows
r = random.Random(1)
vocabulary = [("%x" % r.randrange(1 << 28)).encode() for _ in range(100_000)]
items = [(str(i), r.choices(vocabulary, k=60)) for i in range(5_000)]
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
before = rss(); w = Windows(items, 10); print((rss() - before) / sum(len(x) + 1 for _, ws in items for x in ws))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
    assert float(done.stdout) < 60


def test_decontamination(spark, odd, documents):
    r = random.Random(5)
    make = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = [(1, make(14)), (2, "Short  one!"), (3, None), (4, "..."), (10, make(10)), (5, make(9)), (5, make(9))]
    texts = [f"Well, SHORT-one. {items[0][1].upper()} short", make(300), "short", None, "", "short one short one", " ".join(x[1] or "" for x in items), items[0][1].replace(" ", "\n-- ")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(texts, items)
    got = decontaminate.contamination(docs(spark, texts), benchmark).orderBy("doc_id").collect()
    assert [tuple(x)[1:] for x in got] == want
    small = decontaminate.with_contamination(docs(spark, texts), benchmark, part_bytes=20).orderBy("doc_id").collect()
    assert [(x.n_hit, len(x.items)) for x in small] == [w[1:3] for w in want], "in parts"
    few = decontaminate.with_contamination(clash(docs(spark, texts), "ITEMS", "row"), benchmark, part_bytes=20)
    assert [(x.n_hit, [tuple(s) for s in x.spans]) for x in few.orderBy("doc_id").collect()] == [(x.n_hit, [tuple(s) for s in x.spans]) for x in small]
    long = make(20_000).split()
    periodic = [(1, " ".join(long)), (2, "a b " * 3000), (3, "a " * 40)]
    want_long = brute_contamination(["x " + " ".join(long[5000:5060]) + " y", "b a " * 30, "a " * 12, "a " * 9], [(1, " ".join(long[4900:5100])), (2, "a b " * 20), (3, "a " * 40)])
    got = decontaminate.contamination(docs(spark, ["x " + " ".join(long[5000:5060]) + " y", "b a " * 30, "a " * 12, "a " * 9]), spark.createDataFrame(periodic, "item_id long, text string")).orderBy("doc_id").collect()
    assert [(x.n_words, x.n_hit, x.contaminated) for x in got] == [(w[0], w[1], w[4]) for w in want_long]
    x = decontaminate.with_contamination(clash(docs(spark, texts[:1]), "spans"), benchmark).first()
    assert [texts[0][s.begin : s.until] for s in x._spans] == ["SHORT-one. " + items[0][1].upper()] or "".join(texts[0][s.begin : s.until] for s in x._spans).startswith("SHORT-one")
    assert decontaminate.contamination(odd, benchmark).count() == odd.count() and not decontaminate.contamination(odd, benchmark.limit(0)).filter("contaminated").count()
    assert decontaminate.drop_contaminated(docs(spark, texts), benchmark).count() == sum(not w[4] for w in want) and decontaminate.contamination(odd.limit(0), benchmark).count() == 0


# Sharding


def check_shards(df, shards, got):
    import zlib

    rows = got.toPandas()
    source = df.toPandas()
    assert len(rows) == len(source) and rows.shard.between(0, shards - 1).all()
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = {(None if np.isnan(i) else int(i), zlib.crc32((t or "").encode())): len((t or "").encode()) + 16 for i, t in zip(source.doc_id.astype(float), source.text, strict=True)}
    for r in rows.itertuples():
        assert sizes[None if np.isnan(r.doc_id) else int(r.doc_id), r.text_crc32] == r.size
    each = rows.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    together = max(sharding.TOGETHER * rows["size"].sum() / shards, 0)
    assert (abs(each - rows["size"].sum() / shards) <= rows["size"].max() + 2 * together).all()


def test_sharding(spark, documents, odd):
    check_shards(documents, 40, sharding.assigned(documents))
    check_shards(odd, 3, sharding.with_shards(odd, shards=3))
    copies = docs(spark, ["same text"] * 900 + [f"other {i}" for i in range(1500)])
    got = sharding.with_shards(copies, shards=8)
    check_shards(copies, 8, got)
    assert sharding.assigned(documents.limit(0)).count() == 0
    again = sharding.with_shards(copies.repartition(7), shards=8)
    assert got.exceptAll(again).count() == 0, "the input's partitions don't matter"
    cut = sharding.splitters([(k, 1.0) for k in range(100)] + [(500, 100.0)], 10)
    assert {500, 501} <= set(cut) and len(cut) > 4
    assert sharding.splitters([], 10) == []
    check_shards(clash(odd, "size", "shard", "key", "g"), 3, sharding.with_shards(clash(odd, "size", "shard", "key", "g"), shards=3))


def brute_shards(rows, shards):
    """(doc_id, shard, slot) by one sort and running sums, for tables without a text that fills a range."""
    recs = sorted((xxhash.xxh64_intdigest((t or "").encode(), 42), i, len((t or "").encode()) + 16) for i, t in rows)
    recs = sorted((k - (1 << 64) if k >> 63 else k, i, n) for k, i, n in recs)
    total, out, at, slots = sum(n for *_, n in recs), [], 0, {}
    for _, group in itertools.groupby(recs, key=lambda r: r[0]):
        group, start = list(group), at
        small = sum(n for *_, n in group) <= sharding.TOGETHER * total / shards
        for _, i, n in group:
            shard = min(shards - 1, int((start if small else at) / (total / shards)))
            out.append((i, shard, slots.setdefault(shard, 0)))
            slots[shard] += 1
            at += n
    return sorted(out)


def test_sharding_against_brute_force(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    copies = collections.Counter(t or "" for _, t in rows)
    total = sum((len(t.encode()) + 16) * n for t, n in copies.items())
    assert max((len(t.encode()) + 16) * n for t, n in copies.items() if n > 1) < sharding.OVERFULL * total / (8 * sharding.SPLITTERS)
    got = sharding.with_shards(documents, shards=8).select("doc_id", "shard", "slot").collect()
    assert sorted(tuple(r) for r in got) == brute_shards(rows, 8)


def test_overfull_ranges_are_subdivided(spark, tmp_path):
    rows = [(7, 1, j % 900) for j in range(3000)] + [(7, 2, 5)] * 2000 + [(k, 1, k) for k in range(100, 1100)]  # one key, one key and id, others
    spark.createDataFrame(rows, "key long, size long, doc_id long").write.parquet(str(tmp_path / "t"))
    slim = spark.read.parquet(str(tmp_path / "t")).select("*", F.xxhash64("doc_id").alias("salt"), F.xxhash64("_metadata.file_name", "_metadata.row_index").alias("place"))
    for bounds in ([], [500]):
        placed, found = sharding.ranged(slim, bounds, 300)
        assert placed.count() == len(rows) and sum(r["rows"] for r in found) == len(rows)
        assert max(r.bytes for r in found) <= 300, "ranges are measured and cut until none is overfull"
        keys = [(r.key_min, r.key_max) for r in found]
        assert all(a[1] <= b[0] for a, b in zip(keys, keys[1:], strict=False)), "ranges stay in order"


# SimHash


def brute_fingerprint(text, n=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + n]), 42) for i in range(max(1, len(ws) - n + 1))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints, radius):
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= radius:
            a, b = find(i), find(j)
            group[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash(spark, documents, odd):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        prints = [brute_fingerprint(r.text) for r in rows]
        got = simhash.near_groups(df).collect()
        by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
        assert len(got) == len(rows)
        roots = brute_groups(prints, 4)
        ids = {}
        for i, root in enumerate(roots):
            ids.setdefault(root, []).append(rows[i].doc_id)
        for i, root in enumerate(roots):
            assert by[rows[i].doc_id, f"{prints[i]:016x}"] == min((x for x in ids[root] if x is not None), default=None)
    assert simhash.near_groups(documents.limit(0)).count() == 0
    few = documents.limit(20)
    assert sorted(simhash.near_groups(clash(few, "fp", "first", "FINGERPRINT")).collect(), key=str) == sorted(simhash.near_groups(few).collect(), key=str)


def test_simhash_walks_trees(spark, monkeypatch):
    """Shards of a larger table are trees of hundreds of fingerprints, of which a query sees a part only."""
    slim = simhash.with_fingerprint(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), name="fp")
    first = simhash.materialize(slim.groupBy("fp").agg(F.min("doc_id").alias("first")))
    sizes = [r["count"] for r in simhash.shards(first, 4).groupBy("kind", "value").count().collect()]
    assert sum(sizes) == 5 * first.count() and np.median(sizes) > 100 and max(sizes) <= simhash.SHARD
    tree = simhash.BkTree(np.array([r.fp for r in first.collect()], np.int64).view(np.uint64)[:2000])
    assert not isinstance(tree.root, np.ndarray) and len(tree.root[1]) > 10
    seen, real = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: seen.append(x.size) or real(x))
    list(tree.within(tree.prints[:100], 1))
    assert sum(seen) < 0.6 * 100 * 2000


def test_simhash_links(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = lambda: np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)
    prints = np.unique(np.concatenate([seeds] + [seeds ^ flips() ^ flips() ^ flips() for _ in range(40)]))
    fps = prints.view(np.int64).tolist()
    df = spark.createDataFrame([(p, i if i % 7 else None) for i, p in enumerate(fps)], "fp long, first long")
    roots = brute_groups([int(p) for p in prints], 4)
    want = sorted(sorted(int(prints.view(np.int64)[i]) for i in range(len(prints)) if roots[i] == r) for r in set(roots))
    for shard in (4096, 20):  # large shards are dealt again
        edges = simhash.links(df, 4, shard=shard)
        assert all((e.u, e.v) == tuple(i if i % 7 else None for i in (fps.index(e.u_fp), fps.index(e.v_fp))) for e in edges.limit(50).collect())
        found = components.components(edges, "u_fp", "v_fp").collect()
        of = {r.node: r.root for r in found}
        groups = {}
        for p in prints.view(np.int64).tolist():
            groups.setdefault(of.get(p, p), []).append(p)
        assert sorted(map(sorted, groups.values())) == want
    tree = simhash.BkTree(prints)
    pairs = {(int(i), int(j)) for a, b in tree.within(prints, 4) for i, j in zip(a, b, strict=True)}
    assert pairs == set(zip(*map(np.ndarray.tolist, np.nonzero(np.bitwise_count(prints[:, None] ^ prints) <= 4)), strict=True))
    for used in (3, 13):
        for _ in range(200):
            x = {int(b) for b in rng.choice(64, 4, replace=False)}
            assert any(not x & set(g) for g in simhash.groups_of(tuple(range(64)), 4, used))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4300)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_dedup(spark, odd):
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    originals = [[r.choice(vocabulary) for _ in range(200)] for _ in range(60)]
    texts = []
    for o in originals:
        texts.append(" ".join(o))
        for _ in range(3):
            c = list(o)
            for _ in range(2):
                c[r.randrange(200)] = r.choice(vocabulary)
            texts.append(" ".join(c))
    texts += [texts[0], texts[0].upper(), " ".join(originals[5][:60] + originals[6][:60])]
    df = docs(spark, texts)
    kept = simhash_dedup.without_near_duplicates(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {4 * i for i in range(60)} | {242}
    rest = simhash_dedup.without_near_duplicates(clash(odd, "t", "fp")).collect()
    assert [x.text for x in rest if not (x.text or "").strip()] == [None], "texts without words are one group"
    assert sum(x.text == "One" for x in rest) + sum(x.text == "one" for x in rest) == 1 and sum(x.text == "no id" for x in rest) == 1
    assert sum((x.text or "").startswith("tie") for x in rest) == 1
    assert simhash_dedup.without_near_duplicates(odd.limit(0)).count() == 0


def brute_near(texts, similarity=0.8):
    """The first index of each text's group."""
    sets = [set(simhash.hashes(simhash.shingle_words(t.encode()), 5).tolist()) for t in texts]
    group = list(range(len(texts)))
    for j, i in itertools.product(range(len(texts)), repeat=2):
        both = len(sets[i] & sets[j])
        if i < j and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((group[i], group[j]))
            group = [a if x == b else x for x in group]
    return group


def test_near_dedup_in_dense_groups(spark):
    """All texts have the same set of words, so that fingerprints of it tell nothing."""
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    originals = [[*vocabulary, *(r.choice(vocabulary) for _ in range(200))] for _ in range(60)]
    texts = [" ".join(o) for o in originals] + [" ".join([*o[:150], "w1 w2 w3", *o[151:]]) for o in originals]
    want = brute_near(texts)
    assert len(set(want)) == 60
    assert {x.doc_id for x in simhash_dedup.without_near_duplicates(docs(spark, texts)).collect()} == set(want)


def test_near_dedup_of_contiguous_edits(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(60):
        o = [word() for _ in range(r.choice((150, 200, 600)))]
        k = int(len(o) * 0.18)
        more, at = [word() for _ in range(k)], r.randrange(len(o) - k)
        texts += [" ".join(x) for x in (o, o + more, o[: len(o) - k], more + o, o[:at] + more[: k // 3] + o[at + k // 3 :])]
    want = brute_near(texts)
    assert len(set(want)) == 60
    assert {x.doc_id for x in simhash_dedup.without_near_duplicates(docs(spark, texts)).collect()} == set(want)


def all_near(sets, similarity=0.8):
    """Every pair of sets that are similar enough: such sets share one of their rarest items, the others are counted."""
    often = {}
    for x in sets:
        for h in x:
            often[h] = often.get(h, 0) + 1
    index, pairs = {}, set()
    for i, x in enumerate(sets):
        rare, seen = sorted(x, key=lambda h: (often[h], h))[: len(x) - math.ceil(similarity * len(x)) + 1], set()
        for h in rare:
            seen.update(index.get(h, ()))
            index.setdefault(h, []).append(i)
        for j in seen:
            both = len(x & sets[j])
            if both >= similarity * (len(x) + len(sets[j]) - both):
                pairs.add((j, i))
    return pairs


def test_near_dedup_of_a_whole_table(spark):
    """Recall over all documents, against all pairs of a similarity of 0.8 or more, found in another way."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sorted({r.text or "": r.doc_id for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)}.items(), key=lambda r: r[1])
    sets = [set(simhash.hashes(simhash.shingle_words(t.encode()), 5).tolist()) for t, _ in rows]
    pairs = all_near(sets)
    assert len(pairs) > 40
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        group[max(a, b)] = min(a, b)
    first = {t: find(i) for i, (t, _) in enumerate(rows)}
    got = {r.doc_id: r.kept_id for r in simhash_dedup.groups(df).collect()}
    assert got == {r.doc_id: rows[first[r.text or ""]][1] for r in df.select("doc_id", "text").collect()}


def test_near_dedup_deals_large_buckets(spark):
    """Buckets over the limit are dealt over parts; every pair of two roots still meets."""
    columns = "key long, n long, root long, rows long, " + ", ".join(f"{c} long" for c in simhash_dedup.FACTS)
    root = [0] * 120 + list(range(120, 160)) + [200] * 20
    rows = [(k, i, r, 180 if k == 7 else 29, 100, 0, 0, 0, 0) for k in (7, 8) for i, r in enumerate(root) if k == 7 or i > 150]
    for many in (1 << 20, 1):
        left, pairs, rounds = rows, [], 0
        while left:
            out = simhash_dedup._bucketed(spark.createDataFrame(left, columns), 0.8, many * 4**rounds, 180, chunk=25).collect()
            pairs += [(x.u, x.v) for x in out if x.key is None]
            rest = {(x.key, x.u) for x in out if x.key is not None}
            left, rounds = [x for x in rows if (x[0], x[1]) in rest], rounds + 1
        assert set(pairs) == {(i, j) for i in range(180) for j in range(i + 1, 180) if root[i] != root[j]}
        assert rounds == 1 or many == 1


def test_near_dedup_compares_all_of_a_bucket(spark):
    """Texts of one bucket, in rounds: each pair of two roots once, unless sizes or parities rule it out."""
    size, root, p3 = np.r_[np.full(80, 100), np.full(10, 70)], np.r_[np.zeros(50, int), np.arange(50, 90)], np.r_[np.zeros(70, int), np.full(20, (1 << 30) - 1)]
    columns = "key long, n long, root long, rows long, " + ", ".join(f"{c} long" for c in simhash_dedup.FACTS)
    left, pairs, many, rounds = range(90), [], 1, 0
    while left:
        rows = [(7, i, int(root[i]), len(left), int(size[i]), 0, 0, 0, int(p3[i])) for i in left]
        got = simhash_dedup._bucketed(spark.createDataFrame(rows, columns), 0.8, many).collect()
        pairs += [(x.u, x.v) for x in got if x.key is None]
        left, many, rounds = [x.u for x in got if x.key is not None], many * 4, rounds + 1
    assert rounds > 1 and sorted(pairs) == [(i, j) for i in range(90) for j in range(i + 1, 90) if root[i] != root[j] and size[i] == size[j] and p3[i] == p3[j]]
    rng = np.random.default_rng(5)
    for n in (0, 1, 50, 2000):
        h = rng.integers(0, 1 << 63, 2 * n + 1, np.uint64)
        a, b = h[: n + n // 2], h[n // 2 :]
        assert np.bitwise_count((simhash_dedup.parities(a) ^ simhash_dedup.parities(b)).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def joined(n, pairs, root):
    """The least member of each one's group, which pairs and equal roots make."""
    group = [root.index(r) for r in root]
    for a, b in pairs:
        a, b = sorted((group[a], group[b]))
        group = [a if x == b else x for x in group]
    return group


def test_near_dedup_rows_grow_with_a_bucket(spark):
    """A bucket of texts that may all be similar gives fewer rows than it has, not one for each pair, and joins them all."""
    columns = "key long, n long, root long, rows long, " + ", ".join(f"{c} long" for c in simhash_dedup.FACTS)
    for n in (40, 200):
        root = [0] * (n // 4) + list(range(n // 4, n))
        size = [100 if i % 3 else 50 for i in range(n)]
        rows = [(k, i, root[i], n, size[i], 0, 0, 0, 0) for k in (7, 8) for i in range(n)]
        possible = [(i, j) for i in range(n) for j in range(i + 1, n) if root[i] != root[j] and size[i] == size[j]]
        for chunk in (1000, 50):
            out = [(x.key, x.u, x.v) for x in simhash_dedup._bucketed(spark.createDataFrame(rows, columns), 0.8, most=n, chunk=chunk).collect()]
            assert all(k is None and u < v for k, u, v in out) and {(u, v) for _, u, v in out} <= set(possible)
            assert joined(n, [(u, v) for _, u, v in out], list(range(n))) == joined(n, possible, list(range(n)))
            assert len(out) < 2 * n * -(-n // chunk)


def test_near_dedup_decides_all_pairs_of_a_cluster(spark):
    """Links join what all pairs of a similarity of 0.8 or more join, in one unit and in blocks; none is superfluous."""
    r = random.Random(6)
    sets = [set() for _ in range(3)]
    for _ in range(25):
        sets.append({r.getrandbits(64) for _ in range(r.choice((1, 4, 5, 60, 700)))})
        for _ in range(r.randrange(8)):  # copies of copies, about as far apart as the limit
            x = sorted(sets[-1])
            gone = set(r.sample(x, int(len(x) * r.choice((0.05, 0.1, 0.11, 0.12, 0.2)))))
            sets.append(set(x) - gone | {r.getrandbits(64) for _ in range(r.choice((0, len(gone))))})
    for x in sets[3:]:
        x.add(1)  # one that all have
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = [i if r.random() < 0.8 else r.randrange(n) for i in range(n)]
    want = joined(n, pairs, root)
    assert len(set(joined(n, pairs, list(range(n))))) < n - 40
    given = spark.createDataFrame([(i, 9, root[i], len(x)) for i, x in enumerate(sets)], "n long, cluster long, root long, size long")
    shingles = spark.createDataFrame([(i, sorted(h - (h >> 63 << 64) for h in x)) for i, x in enumerate(sets)], "n long, h array<long>")
    for block in (1 << 20, 4000):
        out = [(x.u, x.v) for x in simhash_dedup._links(given, shingles, 0.8, block).collect()]
        assert {tuple(sorted(x)) for x in out} <= set(pairs) and joined(n, out, root) == want
        assert len(out) == len(set(root)) - len(set(want)) or block < 1 << 20


# Exact top-k


def brute_top(rows, k=5):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in {i: v for i, v in sorted(good, reverse=True) if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in good if j != i)[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(6)
    for scale in (2e5, 2e6, 1e15):  # 64-bit integers; then, for one vector, Python's
        rows = [(i, [*rng.normal(0, 2e5, 8).tolist(), 0.0]) for i in range(120)] + [(125, [1.0] * 8 + [scale])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(tuple(r) for r in topk.nearest(df).collect()) == brute_top(rows)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 40).astype(np.float32).tolist()) for i in range(700)]
    rows += [(i, [0.125] * 40) for i in range(700, 900)]  # ties
    rows += [(900, None), (950, [0.1, None]), (1000, [float("nan")]), (1050, [float("inf")] * 40), (1100, []), (1150, [1.0]), (None, [1.0] * 40), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    for slab in (topk.SLAB, 7):
        got = sorted(tuple(r) for r in topk.top_k(clash(df, "score"), F.col("vec_id") % 50 == 0, slab=slab).collect())
        assert got == want
    assert topk.nearest(df.limit(0)).count() == 0 and topk.nearest(df.filter("vec_id = 50")).count() == 0
    best = topk.Best(np.arange(3), rng.normal(0, 50, (64, 3)).round(), 5)
    m = np.hstack([rng.normal(0, 50, (64, 20_000)).round()])
    for at in range(0, 20_000, 4096):
        best.add(np.arange(100 + at, 100 + at + m[:, at : at + 4096].shape[1]), m[:, at : at + 4096])
    scores = best.queries.T @ m
    assert (best.scores == -np.sort(-scores, 1)[:, :5]).all(), "pairs that are pruned aren't among the best"


@pytest.mark.parametrize(("fall", "most"), [(0.0, 1.0), (0.05, 0.7), (0.15, 0.4)])
def test_top_k_saves_products(fall, most):
    """The faster the dimensions' mass falls, the fewer products are made; the answer stays the same."""
    rng = np.random.default_rng(8)
    weight = np.exp(-fall * rng.permutation(64))[:, None]
    m = np.floor(256 * rng.normal(0, 1, (64, 30_000)) * weight)
    ids, chosen = np.arange(30_000), np.arange(0, 30_000, 50)
    least = topk.floors(chosen, m[:, chosen], 5)
    best = topk.Best(chosen, m[:, chosen], 5, least)
    for at in range(0, 30_000, topk.VECTORS):
        best.add(ids[at : at + topk.VECTORS], m[:, at : at + topk.VECTORS])
    scores = m[:, chosen].T @ m
    scores[np.arange(len(chosen)), chosen] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :5]
    assert (best.found == order).all() and (least <= best.scores[:, -1]).all()
    assert best.made <= most * best.dense, best.made / best.dense


# Chat formatting


@pytest.mark.parametrize("vocabulary", [None, vocabulary_file()], ids=["code points", "bpe"])
def test_chat_format(spark, vocabulary):
    _, decode = chat_format.coder(vocabulary)
    odd_texts = ["hi", None, "", "</s>[INST] ok [/INST]", "\\", "\\<s>", "a\\</s>\nb", "<|im_start|>x<|im_end|>", "<<SYS>><</SYS>>", "\n", "<s>role\n"]
    r = random.Random(8)
    rows = [(c, t, role, odd_texts[(c * 7 + t * 3) % len(odd_texts)]) for c in range(30) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"][: c % 6])]
    rows += [(100 + c, t, "user" if t % 2 == 0 else "assistant", f"shared {t}" if t < 4 else r.choice("ab")) for c in range(50) for t in range(6)]
    rows += [(200, t, "assistant" if t % 2 else "user", f"long {t}") for t in range(700)] + [(201, t, "assistant" if t % 2 else "user", f"long {t}" if t < 600 else "other") for t in range(700)]
    rows += [(None, 1, "user", "no id"), (300, None, None, "no turn"), (301, 0, "we\\ird\nrole", "x"), (302, 0, "user", "tie"), (302, 0, "assistant", "tie"), (303, 0, "user", "long word " * 150_000), (303, 1, "assistant", "é" * 300_000), (303, 2, "user", "end")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {x.conv_id: tuple(x)[1:5] for x in chat_format.checked(clash(df, "segment").repartition(5), vocabulary).collect()}
    by = {}
    for row in sorted([*rows, (-1, 0, "user", odd_texts[3]), (-1, 1, "assistant", odd_texts[3])], key=lambda x: (str(x[0]), -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        by.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    for c, ts in by.items():
        loss = "".join(t for role, t in ts if role == "assistant")
        assert got[c] == (len(ts), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    assert len(got) == len(by)
    packed = chat_format.packs(df.coalesce(1), vocabulary=vocabulary).collect()
    whole = "".join(decode(bytes(p.ids)) for p in packed)
    assert whole.count("shared 0") <= len(packed), "shared turns stand once in a pack"
    for p in packed:
        for n in p.nodes:
            assert n.position >= sum(i.until - i.begin for i in n.attends) and all(i.until <= n.begin for i in n.attends)
            own = decode(bytes(p.ids[4 * n.begin : 4 * n.until]))
            assert "</s>" not in own[:-5] and own.endswith("</s>\n")
            places = np.frombuffer(p.position_ids, "<u4")[n.begin : n.until]
            assert (places == np.arange(n.position, n.position + n.until - n.begin)).all()
            if n.parent >= 0:
                parent = p.nodes[n.parent]
                assert n.position == parent.position + parent.until - parent.begin and n.attends[-1].until == parent.until
        assert len(p.ids) == len(p.position_ids) == 4 * p.nodes[-1].until, "every token stands once"
    small = chat_format.digests(chat_format.read_back(chat_format.packs(df, pack_tokens=50, vocabulary=vocabulary)), vocabulary)
    assert {x.conv_id: tuple(x)[1:5] for x in small.collect()} == {c: v for c, v in got.items() if c != -1}
    assert [x.conv_id for x in chat_format.checked(df.limit(0), vocabulary).collect()] == [-1]
    for t in odd_texts:
        assert t is None or chat_format.restored(chat_format.escaped(t)) == t and not any(c in chat_format.escaped(t) for c in chat_format.CONTROL)


# Byte-level BPE


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    path, pattern = vocabulary_file()
    model = bpe.PrefixBpe(bpe.read_ranks(path))
    return model, tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=model.ranks, special_tokens={}), path, pattern


def test_bpe_documents(spark, coder, documents, odd):
    model, reference, path, pattern = coder
    for df in (documents, odd):
        got = bpe.with_tokens(clash(df, "ids"), path, pattern, decoded="decoded").collect()
        assert len(got) == df.count()
        for r in got:
            ids = np.frombuffer(r._ids, np.uint32).tolist()
            assert ids == reference.encode_ordinary(r.text or "") and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
    r = bpe.round_trip(docs(spark, [None]), path, pattern).first()
    assert r.n_tokens == 0 and r.ids_sha256 == r.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.round_trip(odd.limit(0), path, pattern).count() == 0


def test_bpe_edits(coder):
    model, reference, *_ = coder
    r = random.Random(6)
    parts = ["a", "b", "the", "ing", "é", "中", " ", "1", "\n", "tion", "zz", "😀", "str"]
    for _ in range(300):
        data = "".join(r.choice(parts) for _ in range(r.randrange(1, 60))).encode()
        last = model.table(data)
        assert model.walk(last) == reference._encode_single_piece(data) or len(model.walk(last)) > 1 and model.ranks.get(data) is not None
        grown = model.table(data + b"tail", list(last))
        assert grown == model.table(data + b"tail"), "appends"
        at = r.randrange(len(data) + 1)
        removed, put = r.randrange(len(data) - at + 1), "".join(r.choice(parts) for _ in range(r.randrange(4))).encode()
        new, table = model.edited(data, last, at, removed, put)
        assert new == data[:at] + put + data[at + removed :] and table == model.table(new), "edits"
    ids = list(model.ranks.values())
    for _ in range(3000):
        a, b = r.choice(ids), r.choice(ids)
        assert model.may_follow(a, b) == (model.merged(model.bytes_of[a] + model.bytes_of[b]) == [a, b])
    long = b"ab" * 3000 + b"a" * 3000
    assert model.encode(long) == reference._encode_single_piece(long)
    data, last = long, model.table(long)
    new, table = model.edited(data, last, 100, 3, b"xyz")
    assert table == model.table(new)
