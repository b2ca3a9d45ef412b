"""A corpus pipeline of five stages, each over all rows that the one before it kept.

In all stages null texts count as empty, very long texts are handled whole, an empty table gives an empty one, and
further columns stay, whatever their names. Repeated rows and ties are settled by near-dedup only: of rows with one id
and text one stays, and of a group the row with the smallest id (nulls last), then the smallest MD5 of the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, language_id, line_dedup, simhash_dedup
from quillspark.llm.common import delete_folder, free_name, shared_folder, table
from quillspark.llm.queries import vocabulary_file

#: Stages work on hashes and whole texts in ways that SQL can't express (a fitted model, SimHash, BPE).
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the language model rejects: null texts, texts without letters, or far from all languages.

    If no document has a language, nothing is known and all go.
    """
    marked = language_id.with_language(docs, language_id.train(docs.filter(~language_id.held_out())))
    return marked.filter(~F.col(f"`{marked.columns[-1]}`")).select(*(f"`{c}`" for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; n_chars, where there is such a column, follows. Null texts stay null."""
    cleaned = line_dedup.without_boilerplate(docs)
    if "n_chars" in docs.columns:
        changed = F.col(f"`{cleaned.columns[-1]}`") > 0
        cleaned = cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cleaned.select(*(f"`{c}`" for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash_dedup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a passage of the benchmark occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the token ids, their count and the digest of what they decode to, which must be the text."""
    coded = bpe.with_tokens(docs, *vocabulary_file(), decoded="decoded")
    decoded = F.col(f"`{coded.columns[-1]}`")
    same = decoded == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    digest = F.when(same, F.sha2(decoded, 256)).otherwise(F.raise_error(F.lit("token ids don't decode to their text")))
    return coded.select(*(f"`{c}`" for c in coded.columns[:-1]), digest.alias(free_name(coded.columns, "decoded_sha256")))


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written as Parquet in the shared folder and read again.

    A stage's folder goes when the next one is written. A new column of the last stage that clashes gets underscores.
    """
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            delete_folder(spark, f"{folder}/{i - 1}")
    return docs
