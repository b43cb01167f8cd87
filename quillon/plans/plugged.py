"""Queries through the pluggable format: batches with pushed filters, and streams that go on where they ended."""

import uuid

from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.shipping import discard_later, shared_dir
from quillon.sources import datasource
from quillon.sources.tables import load

SCHEMA = "doc_id long, lang string, n_chars long, text string"


def folder(spark, name: str) -> str:
    """A folder of its own below the shared one, deleted when the driver ends."""
    return discard_later(spark, f"{shared_dir(spark)}/quillon-{name}-{uuid.uuid4().hex}")


def lines(spark, path: str, **options):
    return spark.read.format("quillon_lines").schema(SCHEMA).options(path=path, **options).load()


@query("e05_plugged_reader", "SELECT doc_id, lang, length(text) AS n, sha256(text) AS sha FROM documents WHERE n_chars > 500 AND lang IN ('en', 'de') AND text IS NOT NULL")
def plugged_reader(spark, sf):
    """Documents as a folder of record files, read by byte ranges of a megabyte; the filters are decided in the reader."""
    datasource.register(spark)
    path = folder(spark, "lines")
    load(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text").write.format("quillon_lines").option("path", path).mode("append").save()
    got = lines(spark, path, splitBytes=1 << 20, pushdown=True).filter((F.col("n_chars") > 500) & F.col("lang").isin("en", "de") & F.col("text").isNotNull())
    return got.select("doc_id", "lang", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"))


@query("e05_plugged_stream", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def plugged_stream(spark, sf):
    """Half of the documents are written and streamed, then the rest: the second run reads only what is new, into one table."""
    datasource.register(spark)
    path, table, check = (folder(spark, n) for n in ("lines", "streamed", "offsets"))
    docs = load(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.lit(None).cast("string").alias("text"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    for part in (docs.filter(half), docs.filter(~half)):
        part.write.format("quillon_lines").option("path", path).mode("append").save()
        stream = spark.readStream.format("quillon_lines").schema(SCHEMA).options(path=path, splitBytes=1 << 20).load()
        stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(table).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
