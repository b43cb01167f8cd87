"""Hash-chained ledgers.

Chains are checked per ledger key, never over a whole table in one task: each line carries the hash
of the line before, and a key's lines are compared with a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain(rows: DataFrame, by: str, order: str, line: Column) -> DataFrame:
    """Adds seq (from 0 within by), line and prev_hash: the sha256 of the previous line, null for the first."""
    w = Window.partitionBy(by).orderBy(order)
    out = rows.withColumn("line", line)
    return out.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).withColumn("prev_hash", F.lag(F.sha2("line", 256)).over(w))


def broken(ledger: DataFrame, by: str) -> DataFrame:
    """Entries whose seq isn't contiguous or whose prev_hash isn't the previous line's."""
    w = Window.partitionBy(by).orderBy("seq")
    want = F.lag(F.sha2("line", 256)).over(w)
    gap = F.col("seq") - F.coalesce(F.lag("seq").over(w), F.lit(-1))
    return ledger.select(by, "seq", (~F.col("prev_hash").eqNullSafe(want)).alias("bad_hash"), (gap != 1).alias("bad_seq")).filter("bad_hash OR bad_seq")


def double_claims(ledger: DataFrame, claim: str, accepted: Column) -> DataFrame:
    """Claims accepted more than once, with the position of the first."""
    return ledger.filter(accepted).groupBy(claim).agg(F.min("seq").alias("first_seq"), F.count("*").alias("times")).filter("times > 1")


def guarded(rows: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """Compare-and-set: rows whose input isn't what was expected are not executed."""
    return rows.filter(expected.eqNullSafe(actual))
