"""Structural comparison of two tables: positional, by key and field, with verdicts and gates."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.alignment import CELLS, align


def field_diff(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row for each key that differs: diff_kind (missing, extra, changed) and the sorted changed fields."""
    a = before.select(*keys, F.struct(*fields).alias("a"))
    b = after.select(*keys, F.struct(*fields).alias("b"))
    changed = F.array_sort(F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields])))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    j = a.join(b, keys, "full_outer").select(*keys, kind.alias("diff_kind"), F.when(kind == "changed", changed).otherwise(F.array().cast("array<string>")).alias("fields"))
    return j.filter((F.col("diff_kind") != "changed") | (F.size("fields") > 0))


def compare(before: DataFrame, after: DataFrame, strategy: str, keys: list[str], fields: list[str], order: str | None = None, cells: int = CELLS) -> DataFrame:
    """Differences of two documents' rows by strategy. 'identity' matches rows by keys, their stable ids; 'alignment'
    matches the sequences of fields within keys[0] in order, as a longest common subsequence where a gap's cells stay
    within the budget, else by anchors or greedily: (keys[0], diff_kind, before and after order, how)."""
    if strategy == "identity":
        return field_diff(before, after, keys, fields)
    if strategy != "alignment" or order is None:
        raise ValueError("strategy is 'identity', or 'alignment' with an order")
    token = lambda d: d.select(keys[0], order, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("token"))
    got = align(token(before), token(after), keys[0], order, "token", cells).filter("kind <> 'same'")
    return got.select(keys[0], F.when(F.col("kind") == "removed", "missing").otherwise("extra").alias("diff_kind"), "l_order", "r_order", "how")


def page_changes(before: DataFrame, after: DataFrame, by: str, order: str, token: str, page: int = 20) -> DataFrame:
    """(by, page, kind, removed, added) for each page of page lines that differs: lines that the alignment removes count on the page
    where they stood, those it adds on the page where they stand. kind is changed, or removed or added for pages that one side lacks."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_first(order))) - 1
    a, b = (d.select(by, place.alias("o"), token) for d in (before, after))
    pages = lambda d, name: d.groupBy(by).agg(F.ceil(F.count("*") / page).alias(name))
    off = align(a, b, by, "o", token).filter("kind <> 'same'").withColumn("page", F.floor(F.coalesce("l_order", "r_order") / page).cast("int"))
    each = off.groupBy(by, "page").agg(F.count_if(F.col("kind") == "removed").alias("removed"), F.count_if(F.col("kind") == "added").alias("added"))
    sized = each.join(pages(a, "m"), by, "left").join(pages(b, "n"), by, "left")
    kind = F.when(F.col("page") >= F.coalesce("n", F.lit(0)), "removed").when(F.col("page") >= F.coalesce("m", F.lit(0)), "added").otherwise("changed")
    return sized.select(by, "page", kind.alias("kind"), "removed", "added")


def transition(before: Column, after: Column) -> Column:
    """Verdict of a case over two runs (PASS, FAIL, ERROR; null is missing)."""
    return (
        F.when(before.isNull() | after.isNull(), "MISSING")
        .when(before == "ERROR", F.when(after == "ERROR", "ERR_BOTH").otherwise("ERR_BEFORE"))
        .when(after == "ERROR", "ERR_AFTER")
        .when((before == "FAIL") & (after == "PASS"), "IMPROVED")
        .when((before == "PASS") & (after == "FAIL"), "REGRESSED")
        .when(after == "PASS", "STILL_OK")
        .otherwise("STILL_BAD")
    )


def sweep(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str], examples: int = 3) -> DataFrame:
    """Divergences by field path: full counts and the first few keys as examples (a bounded heap for each, no long lists)."""
    long = lambda d: d.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(keys, fields, "path", "value")
    j = long(before).withColumnRenamed("value", "x").join(long(after).withColumnRenamed("value", "y"), [*keys, "path"]).filter(~F.col("x").eqNullSafe(F.col("y")))
    # by hash parts of each path first, so a frequent path isn't one task's; each part keeps its first keys
    part = j.withColumn("_h", F.pmod(F.xxhash64(*keys), F.lit(64))).withColumn("k", F.row_number().over(Window.partitionBy("path", "_h").orderBy(*keys)))
    few = part.groupBy("path", "_h").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("k") <= examples, F.struct(*keys))).alias("e"))
    all_ = few.groupBy("path").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    return all_.select("path", "n", F.array_sort(F.transform(F.slice("e", 1, examples), lambda x: x[keys[0]])).alias("examples"))


def identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """(identical, diff_count): rows of either that the other lacks, as multisets."""
    both = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    off = both.groupBy(*a.columns).agg(F.sum("_d").alias("_d")).filter("_d <> 0")
    return off.agg(F.coalesce(F.sum(F.abs("_d")), F.lit(0)).cast("long").alias("diff_count")).select((F.col("diff_count") == 0).alias("identical"), "diff_count")


def unified(a: str, b: str) -> str:
    return "\n".join(difflib.unified_diff(a.split("\n"), b.split("\n"), lineterm="", n=0))
