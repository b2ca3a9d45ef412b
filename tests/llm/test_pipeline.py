"""The pipeline against a plain version of its stages, and the queries against their SQL."""

import hashlib
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
import corpus_pipeline  # noqa: E402
from quillspark.llm import queries as llm  # noqa: E402
from quillspark.llm import simhash  # noqa: E402

from .test_llm import words_of  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], SF)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns, name
        frames.append(spark.createDataFrame(out.collect(), out.schema))
    rows = [{r.doc_id: r.text for r in f.collect()} for f in frames]
    assert {i for i, t in rows[0].items() if not any(map(str.isalpha, t or ""))} == set(rows[0]) - set(rows[1])
    assert set(rows[1]) == set(rows[2])
    sets = {i: set(simhash.hashes(simhash.shingle_words(t.encode()), 5).tolist()) for i, t in rows[2].items()}
    group = {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    assert {find(i) for i in ids} == set(rows[3])
    items = [words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {" ".join(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9)) if w}
    clean = {i for i, t in rows[3].items() if not any(f" {x} " in f" {' '.join(words_of(t))} " for x in windows)}
    assert clean == set(rows[4]) == set(rows[5])
    from quillspark.llm.bpe import loaded

    model = loaded(llm.vocabulary_file()[0])[0]
    for r in frames[-1].collect():
        assert model.decode(np.frombuffer(r.ids, np.uint32).tolist()) == r.text.encode()
    again = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in again.collect()} == clean
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_bpe_stage_decodes(spark, monkeypatch):
    texts = ["a b", "中文 😀\r\n", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.bpe_stage(spark, docs, SF).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
    real = corpus_pipeline.bpe.with_tokens
    monkeypatch.setattr(corpus_pipeline.bpe, "with_tokens", lambda *a, **k: real(*a, **k).withColumn("decoded", F.lit(b"a")))
    with pytest.raises(Exception, match="decode to their text"):
        corpus_pipeline.bpe_stage(spark, docs, SF).collect()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df, want = llm.queries()[name](spark, SF), c.sql(llm.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    rounded = lambda row: tuple(round(x, 9) if isinstance(x, float) else x for x in row)
    assert sorted(map(rounded, df.select(*want.columns).collect()), key=repr) == sorted(map(rounded, want.fetchall()), key=repr)
