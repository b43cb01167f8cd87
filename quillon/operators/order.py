"""A global order without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keys sampled for each range whose bounds they give.
SAMPLED = 64
#: Distinct values of all groups together below which medians need no ranges.
FEW = 200_000


def _ranged(df: DataFrame, keys: list[str], ranges: int) -> DataFrame:
    """Adds _p, the range that a row's keys fall in. Bounds come from a sample of bounded size and are fixed
    values from then on: however often the plan runs, a row's range depends on its keys alone."""
    key = F.struct(*keys)
    total = df.count()
    share = min(1.0, SAMPLED * ranges / max(1, total))
    found = df.select(key.alias("k")).sample(share, seed=7).orderBy("k").collect()
    bounds = [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []
    if not bounds:
        return df.withColumn("_p", F.lit(0))
    spark = df.sparkSession
    edge = spark.createDataFrame([([b["k"] for b in bounds],)], df.select(F.array(key).alias("_b")).schema)
    steps = F.array(*[F.lit(1 << j) for j in reversed(range(len(bounds).bit_length()))])
    # binary search: how many bounds are at most the key
    place = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(bounds)) & (F.get(F.col("_b"), p + s - 1) <= key), p + s).otherwise(p))
    return df.crossJoin(F.broadcast(edge)).withColumn("_p", place).drop("_b")


def running(df: DataFrame, keys: list[str], weight: Column, out: str, ranges: int | None = None) -> DataFrame:
    """Adds out, the sum of weight over all rows before a row in the order of keys: rows are summed within
    ranges of keys, and each range starts from the sum of those before it. Rows of equal keys come in any
    order among themselves, all in one range; df is read three times."""
    n = ranges or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = _ranged(df.withColumn("_w", weight.cast("long")), keys, n)
    sizes = parts.groupBy("_p").agg(F.sum("_w").alias("_n"))  # one row for each range
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("_w").over(Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.select("_p", start.alias("_s"))), "_p").withColumn(out, within + F.col("_s")).drop("_p", "_s", "_w")


def numbered(df: DataFrame, keys: list[str], out: str, ranges: int | None = None) -> DataFrame:
    """Adds out, the 0-based place of each row in the order of keys (which should be unique)."""
    return running(df, keys, F.lit(1), out, ranges)


def medians(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """by and out, the exact median of value (nulls left out) for each group: values are counted first, then
    ordered by ranges, so neither a large group nor a frequent value comes to one task."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    if counts.limit(FEW + 1).count() <= FEW:  # few distinct values: their order fits one window for each group
        w = Window.partitionBy(*by).orderBy(value)
        below = F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.select(*by, F.col(value).cast("double").alias("_v"), below.alias("_lo"), "_c", F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
        return _middle(placed, by, out)
    placed = running(counts, [*by, value], F.col("_c"), "_at")
    groups = placed.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.min("_at").alias("_first"), F.sum("_c").alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    j = placed.join(groups, same).select(*by, F.col(value).cast("double").alias("_v"), (F.col("_at") - F.col("_first")).alias("_lo"), "_c", "_n")
    return _middle(j, by, out)


def _middle(placed: DataFrame, by: list[str], out: str) -> DataFrame:
    """The medians from counted values (_v, _c) with their places in their groups (_lo) and the groups' sizes (_n)."""
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = lambda p: F.when((F.col("_lo") <= p) & (p < F.col("_lo") + F.col("_c")), F.col("_v"))
    return placed.groupBy(*by).agg(((F.max(holds(low)) + F.max(holds(high))) / 2).alias(out))
