"""Literal search with addresses and honest counts, cursors, and edits that use the same matcher."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _needle(query: str, ignore_case: bool) -> str:
    if not query:
        raise ValueError("the search text is empty")
    return query.lower() if ignore_case else query


def _hay(text, ignore_case: bool) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(text) if ignore_case else text


def occurrences(text, query: str, ignore_case: bool = True) -> Column:
    """How often query stands in text, not overlapping."""
    hay, needle = _hay(text, ignore_case), _needle(query, ignore_case)
    return F.coalesce(((F.length(hay) - F.length(F.replace(hay, F.lit(needle), F.lit("")))) / len(needle)).cast("long"), F.lit(0).cast("long"))


def offsets(text, query: str, ignore_case: bool = True) -> Column:
    """Character offsets of all matches. Offsets are taken on the lowered text if case is ignored."""
    needle = _needle(query, ignore_case)
    parts = F.split(_hay(text, ignore_case), re.escape(needle))
    sizes = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p))
    walked = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, n: F.struct((s["at"] + n + len(needle)).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out")),
    )
    return walked["out"]


def grep(paras: DataFrame, query: str, ignore_case: bool = True, id_col: str = "doc_id") -> DataFrame:
    """A row for each match: id, section, para, page, char_offset. Literal, never a pattern."""
    hit = paras.filter(_hay("text", ignore_case).contains(_needle(query, ignore_case)))
    return hit.select(id_col, "section", "para", "page", F.explode(offsets("text", query, ignore_case)).alias("char_offset"))


def search(docs: DataFrame, paras: DataFrame, query: str, limit: int, ignore_case: bool = True, id_col: str = "doc_id") -> DataFrame:
    """matchCount (returned), totalMatchCount and truncated for every document; no match is a row with 0.

    The limit caps what is returned, never the scan. Counts are summed from paragraphs before the
    shuffle, so a document of many lines costs its tasks no memory.
    """
    per_doc = paras.filter(_hay("text", ignore_case).contains(_needle(query, ignore_case))).groupBy(id_col).agg(F.sum(occurrences("text", query, ignore_case)).alias("total"))
    total = F.coalesce("total", F.lit(0)).cast("long")
    out = docs.select(id_col).join(per_doc, id_col, "left")
    return out.select(id_col, F.least(total, F.lit(limit).cast("long")).alias("match_count"), total.alias("total_match_count"), (total > limit).alias("truncated"))


def limited(matches: DataFrame, limit: int, by: str = "doc_id", order=("section", "para", "char_offset")) -> DataFrame:
    """At most limit matches of each document, in order; Spark trims groups before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return matches.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def cursor(matches: DataFrame, cursors: DataFrame, forward: bool = True, by: str = "doc_id") -> DataFrame:
    """The next (or previous) match from each document's cursor (para, off), around the end if need be."""
    at = F.struct("para", "char_offset")
    from_ = F.struct(F.col("c_para").alias("para"), F.col("c_off").alias("char_offset"))
    both = matches.join(cursors, by)
    behind = (at <= from_) if forward else (at >= from_)
    key = F.struct(behind.alias("wrapped"), at.alias("at"))
    if forward:
        got = both.groupBy(by).agg(F.min(key).alias("k"))
    else:
        got = both.groupBy(by).agg(F.max(F.struct((~behind).alias("kept"), at.alias("at"))).alias("k"))
        got = got.select(by, F.struct((~F.col("k.kept")).alias("wrapped"), F.col("k.at").alias("at")).alias("k"))
    return got.select(by, F.col("k.at.para").alias("para"), F.col("k.at.char_offset").alias("char_offset"), F.col("k.wrapped").alias("wrapped"))


def replace_text(docs: DataFrame, find: str, by: str, text_col: str = "text") -> DataFrame:
    """Literal, case-sensitive replacement with its dry-run count; documents without a match have no output."""
    return docs.withColumn("n_replaced", occurrences(text_col, find, ignore_case=False)).filter("n_replaced > 0").withColumn("text_after", F.replace(F.col(text_col), F.lit(find), F.lit(by)))


def changed_pages(targets: DataFrame, index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Sorted pages that a set of paragraphs touches; null for a document with any target that no page covers."""
    hit = targets.join(index.withColumn("found", F.lit(True)), [id_col, "section", "para"], "left")
    return hit.groupBy(id_col).agg(F.when(F.bool_and(F.coalesce("found", F.lit(False))), F.array_sort(F.collect_set("page"))).alias("pages"))
