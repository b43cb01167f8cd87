"""A training corpus from documents: language ID, near duplicates, decontamination, personal data, tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the next stage's docs. Stages but the last keep the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontam, langid, ngramjoin, pii
from quillon.llm.runtime import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, with lines below them where docs has columns called so in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def _hashes(*columns) -> tuple:
    """128 bits of columns' values; null is a value of its own."""
    told = [F.coalesce(c.cast("string"), F.lit("\x00null")) for c in columns]
    return F.xxhash64(*told), F.xxhash64(F.lit(1), *told)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay, with lang as predicted; those that are rejected go.

    Null texts and texts without a letter are rejected. Each row is judged by its own text: repeated rows and
    null or shared ids don't matter, nor do other columns. Ties go to the first language in order. An empty table stays
    empty. Texts of any length are read whole, in steps of bounded size.
    """
    return langid.accepted(docs, langid.fit(docs, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of 5-word shingles at 80 percent one row stays: that of the smallest doc_id, where null comes
    last; of rows that share it, the one with the smallest hash.

    Rows are told apart by their whole content, not by their id: different texts under one id are judged one by one, and
    repeated rows, null ids included, are copies of which one stays. Null texts and texts without words are linked with
    nothing and all stay. Columns other than those of documents take part in a row's identity and are passed on.
    An empty table stays empty.
    """
    key, low, high, wordless = _free(docs, "_key", "_a", "_b", "_wordless")
    a, b = _hashes(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.withColumns({low: a, high: b})
    whole = keyed.withColumn(key, F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col(low), F.col(high)))
    found = ngramjoin.ngram_components(whole, id_col=key, k=5, percent=80)
    hashes = (F.col(f"{key}.{low}").alias(low), F.col(f"{key}.{high}").alias(high))
    gone = found.filter(f"n_shingles > 0 AND component_id <> {key}").select(*hashes).distinct()
    empty = found.filter("n_shingles = 0").select(*hashes).distinct().withColumn(wordless, F.lit(True))
    rows = keyed.join(gone, [low, high], "left_anti").join(empty, [low, high], "left")
    # copies of a row that stays have its hashes, so they meet where the joins have brought them
    once = rows.filter(F.col(wordless).isNull()).dropDuplicates([low, high])
    return once.select(docs.columns).union(rows.filter(wordless).select(docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly, go.

    A row is judged by its own text: one with a null id goes if its text holds an item, and a clean one stays though
    another row under its id goes. Repeated rows go or stay together; null and empty texts stay; other columns are passed on.
    An empty table, or an empty benchmark, changes nothing.
    """
    (key,) = _free(docs, "_key")
    a, b = _hashes(F.col("text"))
    keyed = docs.withColumn(key, F.struct(a.alias("a"), b.alias("b")))
    found = decontam.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    return keyed.join(found.select(key).distinct(), key, "left_anti").select(docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets, and n_chars follows.

    Every row stays, repeated ones and those with null ids too; null texts stay null; of spans that overlap the
    first decides; other columns are passed on. An empty table stays empty.
    """
    return pii.redact_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and the token ids themselves, for every row; null texts count as empty."""
    return bpe.encode_texts(docs, keep=True)


STAGES = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", without_pii),
    ("bpe", tokens),
]

#: No SQL for trained centroids, LSH or tokens; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
