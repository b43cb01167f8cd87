"""Reading tables, and the flattening of texts into addressed paragraphs.

Every operator works on one node table, so none has a traversal of its own: a row for each
paragraph with its document, section, ordinal and page. A page is a block of PAGE paragraphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.shipping import ship

PAGE = 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: int = PAGE) -> DataFrame:
    """(id, section, para, page, text): a row for each line of a text; null texts have none."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("para", "text"))
    return lines.select(F.col(id_col), F.lit(0).alias("section"), "para", F.floor(F.col("para") / page).cast("int").alias("page"), "text")


#: The same in SQL, for oracles: WITH paras AS (...).
PARAS_SQL = f"""paras AS (
  SELECT doc_id, 0 AS section, CAST(para AS INTEGER) AS para, CAST(para // {PAGE} AS INTEGER) AS page, text
  FROM (SELECT doc_id, unnest(range(len(l))) AS para, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def page_index(paras: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """First page of each paragraph, made once and joined by address."""
    return paras.groupBy(id_col, "section", "para").agg(F.min("page").alias("page"))
