"""Language identification: nearest of several centroids per language by cosine, with rejection by distance.

A text's vector holds its hashed byte trigrams (of lower-cased words) by TF-IDF, at length one. The model is fitted on
a bounded sample of labelled rows: each language's vectors are clustered by spherical k-means, and each language gets a
distance beyond which a text is rejected. Prediction reads the text only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, free_name, map_slices

#: Labelled rows per language in the sample that the model is fitted on, on average; up to a quarter more may be taken.
SAMPLE = 400
CENTROIDS = 4
BITS = 14
#: Languages that a model may have.
MOST_LANGUAGES = 500
#: Of the least cosine that training texts reach, so much is enough; shorter texts need less, see `floor`.
SLACK = 0.5
UNKNOWN = "und"


def trigrams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's byte trigrams and how often each occurs."""
    b = np.frombuffer(b" %s " % text.translate(ALNUM), np.uint8).astype(np.uint32)
    v = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    v = v[(v != 0x202020)]
    counts = np.bincount((v * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    centroids: np.ndarray | None = None  # a row for each
    of: np.ndarray | None = None  # the language of each centroid
    least: np.ndarray | None = None  # the cosine that each language asks for

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        v = (1 + np.log(counts)) * self.idf[at]
        norm = np.sqrt(v @ v)
        return v / norm if norm else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine in 0..1, rejected. A text without letters is unknown, as all are to an empty model."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        at, counts = trigrams(text.encode())
        cosines = self.vector(at, counts) @ self.columns()[at] if len(at) else np.zeros(len(self.of))
        best = int(np.argmax(cosines))  # ties: the first language by name
        score = min(1.0, max(0.0, float(cosines[best])))
        n = int(counts.sum())
        return self.languages[self.of[best]], score, score < self.least[self.of[best]] * np.sqrt(n / (n + 300.0))

    def columns(self) -> np.ndarray:
        if not hasattr(self, "_columns"):
            self._columns = np.ascontiguousarray(self.centroids.T)
        return self._columns


def clustered(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from the rows that are farthest from the mean and one another: the same for the same rows."""
    mean = rows.mean(0)
    picked = [int(np.argmax(rows @ mean))]
    near = rows @ rows[picked[0]]
    while len(picked) < min(k, len(rows)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[picked[-1]])
    centres = rows[picked]
    for _ in range(rounds):
        nearest = np.argmax(rows @ centres.T, 1)
        new = [rows[nearest == i].mean(0) for i in range(len(centres)) if (nearest == i).any()]
        centres = np.array([c / max(np.sqrt(c @ c), 1e-12) for c in new], np.float32)
    return centres


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], k: int = CENTROIDS) -> Model:
    """sample: language, buckets and counts of each labelled text."""
    sample = [s for s in sample if len(s[1])]
    if not sample:
        return Model()
    df = np.zeros(1 << BITS, np.int64)
    for _, at, _ in sample:
        df[at] += 1
    model = Model(sorted({s[0] for s in sample}), np.log((1 + len(sample)) / (1 + df)) + 1)
    centres, of, least = [], [], []
    for i, language in enumerate(model.languages):
        own = [s for s in sample if s[0] == language]
        rows = np.zeros((len(own), 1 << BITS), np.float32)
        for row, (_, at, counts) in zip(rows, own, strict=True):
            row[at] = model.vector(at, counts)
        c = clustered(rows, k)
        centres.append(c)
        of += [i] * len(c)
        n = np.array([s[2].sum() for s in own])
        least.append(SLACK * float((np.max(rows @ c.T, 1) / np.sqrt(n / (n + 300.0))).min()))
    model.centroids, model.of, model.least = np.concatenate(centres), np.array(of), np.array(least)
    return model


def features(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Language, buckets and counts of each row: what the driver gets of the sample is bounded by the buckets."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("at", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def start():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [trigrams((x or "").encode()) for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array([a.astype(np.uint16).tobytes() for a, _ in found], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary())], names=schema.names)

        return one

    return map_slices(df.select(F.col(lang).cast("string"), F.col(text).cast("string")), start, schema)


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from about `sample` rows of each language, picked by a hash of key and text, at least one of each.

    Rows without language or text are left out; rows of equal key and text count once, so neither null nor repeated
    keys nor repeated rows crowd others out. Ties of the hash count as one row. An empty table gives a model that knows
    no language. Languages are at most MOST_LANGUAGES; more raise an error.
    """
    lang_, text_ = F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")
    place = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`"), F.lit("language sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    usable = labelled.select(lang_, text_, place.alias("place")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: (r[1], r[2]) for r in usable.groupBy("lang").agg(F.count(F.lit(1)), F.min("place")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return Model()
    rates = F.create_map(*(x for name, (n, least) in sorted(counts.items()) for x in (F.lit(name), F.lit(max(least, min(1.0, 1.25 * sample / n))))))
    one = usable.filter(F.col("place") <= rates[F.col("lang")]).groupBy("lang", "place").agg(F.first("text").alias("text"))
    picked = features(one.orderBy("place", "lang").limit(2 * sample * len(counts)), "text", "lang").collect()
    return fit(sorted(((r.lang, np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.counts, np.uint32).astype(np.int64)) for r in picked), key=lambda s: (s[0], s[1].tobytes(), s[2].tobytes())))


def with_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred (a language of the model; `und` for a null text or one without letters), score and rejected.

    rejected: the text is unknown, or farther from every centroid than its language's limit. Very long texts are read
    whole; of equally near languages the first by name is taken. Rows, repeated ones too, and other columns stay; a
    clashing new name gets underscores in front. An empty table gives an empty one. No shuffle. The model, of at most
    MOST_LANGUAGES times CENTROIDS times 64 KB, is broadcast.
    """
    kinds = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(free_name(df.columns, c), k) for c, k in kinds.items())])
    at, held = df.columns.index(text), df.sparkSession.sparkContext.broadcast(model)

    def start():
        predict = held.value.predict

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [predict(x) for x in batch.column(at).to_pylist()]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([bool(f[2]) for f in found], pa.bool_())]
            return pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

        return one

    return map_slices(df, start, schema)


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def predicted(documents: DataFrame) -> DataFrame:
    """Each document's language, learned from those that aren't held out."""
    model = train(documents.filter(~held_out()))
    return with_language(documents.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")
