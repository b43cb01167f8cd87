"""Files as documents: corpus listings, binary scans, strict JSON, tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.scalars import pad_hex_name
from quillon.operators.order import numbered


def corpus(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length, content, modificationTime) of all files below root that fit the pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def listing(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """docid (five digits, more from 100,000 on) by the case-folded relative path, and the path. Listings are names only, far
    smaller than the corpus; still they are numbered by range partitions, not in one task."""
    rel = F.substring_index(F.col(path), root.rstrip("/") + "/", -1)
    rows = files.select(rel.alias("rel"), F.lower(rel).alias("_k"))
    n = F.col("n").cast("string")
    return numbered(rows, ["_k", "rel"], "n").select(F.lpad(n, F.greatest(F.length(n), F.lit(5)), F.lit("0")).alias("docid"), "rel")


def strict(text: Column, fields: tuple[str, ...]) -> Column:
    """An error for JSON that doesn't parse, isn't an object, or has an unknown field; null if fine."""
    keys = F.json_object_keys(text)
    unknown = F.array_except(keys, F.array(*map(F.lit, fields)))
    return F.when(keys.isNull(), "not a JSON object").when(F.size(unknown) > 0, F.concat(F.lit("unknown field "), F.array_join(F.array_sort(unknown), ", ")))


def binary_name(number: Column, ext: Column) -> Column:
    return pad_hex_name(number, ext)


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    """Delimited text by column name; the schema is given, never inferred."""
    return spark.read.csv(path, sep=sep, header=header, schema=schema, enforceSchema=False)


def read_lines(spark: SparkSession, path: str, schema: str, skip_kind: str | None = "meta") -> DataFrame:
    """NDJSON without its meta rows."""
    rows = spark.read.json(path, schema=schema)
    return rows.filter(F.coalesce(F.col("kind"), F.lit("")) != skip_kind) if skip_kind and "kind" in rows.columns else rows


def first_per(rows: DataFrame, by: str, *order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_k = 1").drop("_k")


def fragments(pages, id_col: str, markup: str, pattern: str):
    """(id, ord, raw, parent, siblings_before): all stretches of markup that match the pattern, verbatim and in order;
    whether they stand in the head or the body, and how many other elements open before them."""
    h = pages.select(id_col, F.split(markup, pattern).alias("gaps"), F.regexp_extract_all(markup, F.lit(pattern), F.lit(0)).alias("raws"))
    x = h.select(id_col, "gaps", F.posexplode("raws").alias("ord", "raw")).withColumn("before", F.array_join(F.slice("gaps", 1, F.col("ord") + 1), ""))
    parent = F.when(F.col("before").contains("<body"), "body").otherwise("head")
    return x.select(id_col, "ord", "raw", parent.alias("parent"), F.size(F.regexp_extract_all("before", F.lit("<[a-zA-Z]"), F.lit(0))).alias("siblings_before"))
