"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (1 to 3 bytes, A-Z lowered), weighted by TF-IDF and
normalised. Each language has several centroids, from spherical k-means over a bounded sample of
its texts; the language of the closest centroid by cosine is predicted. A text further from all
centroids than texts of its length should be is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import textkernel as K
from quillon.llm.runtime import session, steps, table, text_parts, turn_to

DIMS = 4096
CENTROIDS = 4
#: Most labelled texts of a language that the centroids are fitted on.
SAMPLE = 300
#: Labels up to which what is known of each is broadcast (8,192 times SAMPLE ids are 40 MB); more are joined by shuffles.
LANGUAGES = 8192
#: A text is rejected below this share of the cosine that its language's texts reach at its length.
SHARE = 0.2
#: Letters count runs of other bytes (digits, punctuation) as one space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = re.compile("[A-Za-z]")


def counts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, one row for each text; n-grams don't cross texts."""
    n = len(offsets) - 1
    out = np.zeros(n * DIMS)
    if not len(buf):
        return out.reshape(n, DIMS)
    b = _FOLD[buf].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(offsets))
    for k in (1, 2, 3):
        if len(b) < k:
            break
        m = len(b) - k + 1
        h = np.full(m, k * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            h = (h ^ b[j : j + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        same = doc[:m] == doc[k - 1 :]
        blank = np.ones(m, bool)
        for j in range(k):
            blank &= b[j : j + m] == 32
        keep = same & ~blank
        out += np.bincount((doc[:m] + (h % np.uint32(DIMS)))[keep], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(c) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def has_letter(text: str) -> bool:
    return bool(_LETTER.search(text)) or any(map(str.isalpha, text))


def cluster(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start; rows of v have length 1."""
    centres = [v.mean(0)]
    near = v @ centres[0]
    for _ in range(min(k, len(v)) - 1):
        centres.append(v[int(np.argmin(near))])
        near = np.maximum(near, v @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = v[own == j].mean(0)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _rows(col: pa.Array):
    for lo, hi in steps(col):
        yield lo, counts(*text_parts(col.slice(lo, hi - lo)))


def _frequencies(batches):
    total, n = np.zeros(DIMS), 0
    for b in batches:
        n += b.num_rows
        for _, c in _rows(b.column(0)):
            total += (c > 0).sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["df", "n"])


def _fit(idf_b):
    def run(group: pa.Table) -> pa.Table:
        col = group["text"].combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        c = np.concatenate([x for _, x in _rows(col)])
        keep = c.sum(1) > 0
        lang = group["lang"][0].as_py()
        if not keep.any():
            return pa.table({"lang": pa.array([], pa.string()), "centre": pa.array([], pa.list_(pa.float32())), "mid": pa.array([], pa.float64())})
        v = weighted(c[keep], idf_b.value)
        centres = cluster(v, CENTROIDS)
        mid = float(np.median((v @ centres.T).max(1)))
        return pa.table({"lang": [lang] * len(centres), "centre": pa.array([x.astype(np.float32).tolist() for x in centres], pa.list_(pa.float32())), "mid": [mid] * len(centres)})

    return run


class Model:
    """idf, languages, centroids (rows), the language of each and its median cosine."""

    def __init__(self, idf, langs, centres, mids):
        self.idf, self.langs, self.centres, self.mids = idf, langs, centres, mids

    def predict(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, cosine, and whether the text is too far from it, for rows of counts."""
        near = weighted(c, self.idf).astype(np.float32) @ self.centres.T
        best = near.argmax(1)
        cos = np.clip(near[np.arange(len(c)), best].astype(np.float64), 0, 1)
        # a short text has few n-grams and so a smaller cosine: allow for it
        grams = c.sum(1)
        least = SHARE * self.mids[best] * np.minimum(1, np.sqrt(grams / 3000))
        return best, cos, cos < least


def _predict(model_b):
    def run(batches):
        turn_to("langid")
        m = model_b.value
        for b in batches:
            n = b.num_rows
            lang, score, far = ["und"] * n, np.zeros(n), np.ones(n, bool)
            texts = b.column(2).to_pylist()
            if len(m.langs):
                for lo, c in _rows(b.column(2)):
                    best, cos, out = m.predict(c)
                    for i in range(len(c)):
                        if texts[lo + i] and has_letter(texts[lo + i]):
                            lang[lo + i], score[lo + i], far[lo + i] = m.langs[best[i]], cos[i], out[i]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["rid", "held_out", "lang_pred", "score", "rejected"])

    return run


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Centroids from at most SAMPLE distinct texts of each language, among rows where train is true and neither text nor
    language is null: those whose hashes come first. Ids play no part, so null, repeated and shared ones don't matter. The model takes 64 KB a language in every worker."""
    spark = session(docs.sparkSession)
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"))
    # of a frequent language only texts below a hash come to its window: four times as many as asked for, on average
    hashed = rows.withColumn("h", F.xxhash64("text"))
    share = hashed.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * SAMPLE) / F.approx_count_distinct("h")).alias("share"))
    # a row for each language: broadcast if they are few
    told = F.broadcast if share.count() <= LANGUAGES else lambda d: d
    low = hashed.join(told(share), "lang").filter((F.col("h") / 2.0**64 + 0.5) < F.col("share"))
    # copies, however many and whatever their ids, count once
    once = low.groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = once.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("k") <= SAMPLE).select("text", "lang")
    sample = sample.persist()
    try:
        parts = sample.select("text").mapInArrow(_frequencies, "df array<double>, n long").collect()
        n = sum(p["n"] for p in parts)
        df = np.sum([np.array(p["df"]) for p in parts], axis=0) if parts else np.zeros(DIMS)
        idf = np.log((1 + n) / (1 + df)) + 1
        idf_b = spark.sparkContext.broadcast(idf)
        got = sample.groupBy("lang").applyInArrow(_fit(idf_b), "lang string, centre array<float>, mid double").orderBy("lang").collect()
    finally:
        sample.unpersist()
    return Model(idf, [r["lang"] for r in got], np.array([r["centre"] for r in got], np.float32).reshape(-1, DIMS), np.array([r["mid"] for r in got]))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """id_col, held_out, lang_pred, score (cosine), rejected for each row of docs.

    lang_pred is 'und' with score 0, and the row is rejected, if the text is null or has no letter
    or the model knows no language. Repeated rows and null ids are kept; ties go to the first
    centroid in order of language; long texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    spark = session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("rid"), F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), f"rid {kind}, held_out boolean, lang_pred string, score double, rejected boolean").withColumnRenamed("rid", id_col)


def _accept(model_b, text_at: int, lang_at: int | None):
    def run(batches):
        turn_to("langid")
        for b in batches:
            probe = pa.RecordBatch.from_arrays([pa.array(range(b.num_rows), pa.int64()), pa.array([False] * b.num_rows), b.column(text_at)], ["rid", "held_out", "text"])
            got = next(iter(_predict(model_b)(iter([probe]))))
            if lang_at is not None:
                b = b.set_column(lang_at, b.schema.field(lang_at).name, got["lang_pred"])
            yield b.filter(pa.compute.invert(got["rejected"]))

    return run


def accepted(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """The rows of docs whose language the model knows, whole, with lang_col set to the prediction."""
    spark = session(docs.sparkSession)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    at = docs.columns.index(text_col)
    return docs.mapInArrow(_accept(spark.sparkContext.broadcast(model), at, docs.columns.index(lang_col) if lang_col else None), docs.schema)


def held(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learnt from those whose crc32 of the id modulo 3 isn't 1."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs, F.coalesce(~held(), F.lit(True))), held_out=held()).select("doc_id", "held_out", "lang_pred", "score", "rejected")
