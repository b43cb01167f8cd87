"""Alignment of two sequences for each key, anchored and cut into gaps, so that no key is ever one row.

A gap (at first a whole key) whose cells, one for each pair of its lines, stay within a budget is aligned exactly as a longest
common subsequence. A larger one is cut:

1. at safe anchors: tokens that occur once on either side of the gap and that no pair of equal tokens crosses. Every
   longest common subsequence holds them, so the cut costs nothing;
2. where that isn't enough, at the longest increasing run of the tokens that occur once on either side (fit to be anchors);
3. and where no such token is left, or ROUNDS cuts were made, lines are paired greedily: the k-th of a token with the k-th, as
   far as they come in order.

The result says how each gap was aligned, so a caller knows where it is exact ('exact'), exact but for anchors that were
chosen ('anchored'), or only in order ('greedy').
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.joins import common_pairs
from quillon.shipping import cut_lineage, ship

#: Cells of a gap that is aligned exactly and lines that it may have, cuts before the greedy way, and anchors of which one
#: task finds the longest run.
CELLS, LINES, ROUNDS, RUN = 1 << 26, 1 << 18, 4, 1 << 20


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (ties: that with the smallest values at the end of each length)."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
        last[k : k + 1] = [i]
        before[i] = last[k - 1] if k else -1
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _runs(t: pa.Table) -> pa.Table:
    """The anchors of one stretch that are kept; beyond RUN those that exceed all before them."""
    t = t.sort_by("l")
    r = t["r"].to_numpy()
    keep = increasing(r.tolist()) if len(r) <= RUN else np.flatnonzero(np.maximum.accumulate(r) == r)
    return t.take(pa.array(keep, pa.int64())).select(["key", "gap", "l", "r"])


def anchors(lines: DataFrame, key_kind: str, fit: Column) -> DataFrame:
    """(key, gap, l, r, safe) from lines (key, gap, side, at, token) of gaps: tokens that occur once on either side."""
    by = ["key", "gap", "token"]
    left, right = F.col("side") == 0, F.col("side") == 1
    tokens = lines.groupBy(*by).agg(F.count_if(left).alias("n"), F.count_if(right).alias("m"), F.min(F.when(left, F.col("at"))).alias("l"), F.min(F.when(right, F.col("at"))).alias("r"), F.max(F.when(right, F.col("at"))).alias("far"))
    both = tokens.filter("n > 0 AND m > 0")
    # what a left line may be paired with lies between r and far; nothing crosses an anchor if all before it ends before and all after it begins after
    reach = lines.filter(left).join(both, by).select("key", "gap", "at", F.col("r").alias("low"), F.col("far").alias("high"), ((F.col("n") == 1) & (F.col("m") == 1)).alias("once"), fit.alias("fit"))
    order = Window.partitionBy("key", "gap").orderBy("at")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("low").over(Window.partitionBy("key", "gap").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1))
    seen = reach.withColumns({"before": before, "after": after}).filter("once AND fit")
    clear = (F.coalesce("before", F.lit(-1)) < F.col("low")) & (F.col("after").isNull() | (F.col("after") > F.col("low")))
    return seen.select("key", "gap", F.col("at").alias("l"), F.col("low").alias("r"), clear.alias("safe"))


def _chosen(found: DataFrame, key_kind: str) -> DataFrame:
    """(key, gap, l, r): the longest increasing run of a gap's anchors. Anchors that cross no other part them into stretches,
    each of which is one group of pairs of numbers."""
    order = Window.partitionBy("key", "gap").orderBy("l")
    before = F.max("r").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min("r").over(Window.partitionBy("key", "gap").orderBy(F.desc("l")).rowsBetween(Window.unboundedPreceding, -1))
    free = found.withColumn("free", ((F.coalesce(before, F.lit(-1)) < F.col("r")) & (F.coalesce(after, F.lit(1 << 62)) > F.col("r"))).cast("int"))
    parted = free.withColumn("stretch", F.sum("free").over(order))
    crossed = parted.filter("free = 0").select("key", "gap", "stretch", "l", "r")
    kept = crossed.groupBy("key", "gap", "stretch").applyInArrow(_runs, f"key {key_kind}, gap string, l long, r long")
    return parted.filter("free = 1").select("key", "gap", "l", "r").union(kept)


def _cut(lines: DataFrame, at: DataFrame) -> DataFrame:
    """Lines that aren't anchors, in the gaps between them: a gap's name grows by the number of anchors before."""
    marks = at.select("key", "gap", F.lit(0).alias("side"), F.col("l").alias("at")).union(at.select("key", "gap", F.lit(1), "r")).withColumn("mark", F.lit(1))
    told = lines.join(marks, ["key", "gap", "side", "at"], "left")
    n = F.coalesce(F.sum("mark").over(Window.partitionBy("key", "gap", "side").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return told.withColumn("n", n).filter("mark IS NULL").select("key", F.concat_ws(".", "gap", F.col("n").cast("string")).alias("gap"), "side", "at", "token")


def _exact(lines: DataFrame, key_kind: str) -> DataFrame:
    """(key, gap, l, r) of the pairs of a longest common subsequence of each gap. Gaps come one after the other, so a task
    holds the lines of one, which the budget bounds."""

    def run(batches):
        def pairs(rows, key):
            a, b = ([(at, token) for side, at, token in rows if side == s] for s in (0, 1))
            return [(*key, a[i][0], b[j][0]) for i, j in common_pairs([t for _, t in a], [t for _, t in b])]

        now, rows = None, []
        for batch in batches:
            out = []
            for key, gap, *row in zip(*(batch.column(n).to_pylist() for n in ("key", "gap", "side", "at", "token")), strict=True):
                if (key, gap) != now:
                    if rows:
                        out += pairs(rows, now)
                    now, rows = (key, gap), []
                rows.append(row)
            yield table(out, batch.schema)
        if rows:
            yield table(pairs(rows, now), batch.schema)

    def table(out, schema):
        k, g, i, j = zip(*out, strict=True) if out else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(k, schema.field("key").type), pa.array(g, pa.string()), pa.array(i, pa.int64()), pa.array(j, pa.int64())], ["key", "gap", "l", "r"])

    return lines.repartition("key", "gap").sortWithinPartitions("key", "gap", "side", "at").mapInArrow(run, f"key {key_kind}, gap string, l long, r long")


def _greedy(lines: DataFrame) -> DataFrame:
    """(key, gap, l, r): the k-th of a token with the k-th of the other side, those that exceed all before them."""
    by = Window.partitionBy("key", "gap", "side", "token").orderBy("at")
    k = lines.withColumn("k", F.row_number().over(by))
    both = k.filter("side = 0").select("key", "gap", "token", "k", F.col("at").alias("l")).join(k.filter("side = 1").select("key", "gap", "token", "k", F.col("at").alias("r")), ["key", "gap", "token", "k"])
    before = F.max("r").over(Window.partitionBy("key", "gap").orderBy("l").rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn("b", before).filter("b IS NULL OR r > b").select("key", "gap", "l", "r")


def _small(left: DataFrame, right: DataFrame, by: str, cells: int) -> bool:
    """Whether the largest key of one side and the largest of the other would be one gap within the budget."""
    n, m = (d.groupBy(by).count().agg(F.max("count")).first()[0] or 0 for d in (left, right))
    return n * m <= cells and n + m <= LINES


def _whole(rows: DataFrame, by: str, kind: str, token: str) -> DataFrame:
    """Keys that all are gaps within the budget, aligned as they come by: one shuffle, and a task holds one key."""

    def run(batches):
        def aligned(key, lines):
            a, b = ([(o, t) for side, o, t in lines if side == s] for s in (0, 1))
            out, i, j = [], 0, 0
            for x, y in [*common_pairs([t for _, t in a], [t for _, t in b]), (len(a), len(b))]:
                out += [(key, "removed", o, None, t, None) for o, t in a[i:x]] + [(key, "added", None, o, t, None) for o, t in b[j:y]]
                if x < len(a) and y < len(b):
                    out.append((key, "same", a[x][0], b[y][0], a[x][1], "exact"))
                i, j = x + 1, y + 1
            return out

        def made(out, schema):
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (schema.field("k").type, pa.string(), pa.int64(), pa.int64(), schema.field("t").type, pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [by, "kind", "l_order", "r_order", token, "how"])

        now, lines, schema = object(), [], None  # no key equals it, null doesn't either
        for batch in batches:
            out, schema = [], batch.schema
            for key, *line in zip(*(batch.column(n).to_pylist() for n in ("k", "side", "o", "t")), strict=True):
                if key != now:
                    out += aligned(now, lines) if lines else []
                    now, lines = key, []
                lines.append(line)
            yield made(out, schema)
        if lines:
            yield made(aligned(now, lines), schema)

    order = ["k", "side", F.asc_nulls_first("o")]
    token_kind = rows.schema["t"].dataType.simpleString()
    # by a digest of the key: where both sides of a union come shuffled by the key itself, Spark drops a repartition by it,
    # and adaptive execution then coalesces the sides apart
    return rows.repartition(F.xxhash64("k")).sortWithinPartitions(*order).mapInArrow(run, f"`{by}` {kind}, kind string, l_order long, r_order long, `{token}` {token_kind}, how string")


def align(left: DataFrame, right: DataFrame, by: str, order: str, token: str, cells: int = CELLS, fit: Column | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(by, kind, l_order, r_order, token, how): kind is same for pairs, else removed (left only) or added; how is exact,
    anchored or greedy for a pair, as its gap was aligned (safe anchors count as exact), and null for other rows.

    fit (a condition on token) says which tokens may be chosen as anchors. Rows of a side are in the order of their numbers,
    which should be unique for a key; null keys, orders and tokens are values like others, and null orders come first. Empty
    sides give rows of one kind; two empty tables none.
    """
    ship(left.sparkSession)
    kind = left.schema[by].dataType.simpleString()
    if _small(left, right, by, cells):
        plain = lambda d, s: d.select(F.col(by).alias("k"), F.lit(s).alias("side"), F.col(order).cast("long").alias("o"), F.col(token).alias("t"))
        return _whole(plain(left, 0).union(plain(right, 1)), by, kind, token)
    hashed = F.sha2(F.concat(F.when(F.col(token).isNull(), "n").otherwise("t"), F.coalesce(F.col(token).cast("string"), F.lit(""))), 256)
    fine = fit if fit is not None else F.lit(True)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_first(order))) - 1

    def side(df: DataFrame, s: int) -> DataFrame:
        # lines are compared by digest; whether a token may be an anchor goes with it
        return df.select(F.col(by).alias("key"), F.lit(s).alias("side"), place.cast("long").alias("at"), F.col(order).cast("long").alias("o"), F.col(token).alias("t"), F.concat(F.when(fine, "+").otherwise("-"), F.substr(hashed, F.lit(1), F.lit(32))).alias("token"))

    whole = cut_lineage(side(left, 0).union(side(right, 1)), "align-lines")
    cur = whole.select("key", F.lit("").alias("gap"), "side", "at", "token").withColumn("key", F.struct("key"))
    kind = f"struct<key:{kind}>"  # so that null keys are values
    pairs: list[DataFrame] = []
    hows = F.lit("exact")
    for turn in range(rounds + 1):
        sizes = cur.groupBy("key", "gap").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m")).filter("n > 0 AND m > 0")
        sized = cur.join(sizes, ["key", "gap"])  # gaps with one side only have no pairs
        sized = cut_lineage(sized, "align-gaps")
        fits = (F.col("n") * F.col("m") <= cells) & (F.col("n") + F.col("m") <= LINES)
        pairs.append(_exact(sized.filter(fits).select(cur.columns), kind).withColumn("how", hows))
        large = sized.filter(~fits).select(cur.columns)
        if large.isEmpty():
            break
        if turn == rounds:
            pairs.append(_greedy(large).withColumn("how", F.lit("greedy")))
            break
        found = cut_lineage(anchors(large, kind, F.col("token").startswith("+")), "align-anchors")
        if turn == 0:
            at = found.filter("safe").drop("safe")
        else:
            at = cut_lineage(_chosen(found.drop("safe"), kind), "align-chosen")
            hows = F.lit("anchored")
            # gaps without an anchor won't get one
            stuck = large.join(at.select("key", "gap").distinct(), ["key", "gap"], "left_anti")
            pairs.append(_greedy(stuck).withColumn("how", F.lit("greedy")))
            large = large.join(at.select("key", "gap").distinct(), ["key", "gap"], "left_semi")
        pairs.append(at.select("key", "gap", "l", "r").withColumn("how", hows))
        cur = cut_lineage(_cut(large, at), "align-cut")
    same = reduce(DataFrame.union, pairs).select(F.col("key.key").alias("key"), "l", "r", "how")
    same = cut_lineage(same, "align-pairs")
    line = lambda s, o: whole.filter(F.col("side") == s).select(F.col("key").alias("k"), F.col("at").alias(f"at{s}"), F.col("o").alias(o), F.col("t").alias(f"t{s}"))
    # each line of either side has one pair at most
    a = line(0, "l_order").join(same, F.col("k").eqNullSafe(F.col("key")) & (F.col("at0") == F.col("l")), "left").select("k", "at0", "l_order", "t0", "r", "how")
    b = line(1, "r_order").withColumnRenamed("k", "k1")
    both = a.join(b, F.col("k").eqNullSafe(F.col("k1")) & (F.col("r") == F.col("at1")), "full_outer")
    known = F.when(F.col("at0").isNull(), "added").when(F.col("at1").isNull(), "removed").otherwise("same")
    key = F.when(F.col("at0").isNull(), F.col("k1")).otherwise(F.col("k"))
    return both.select(key.alias(by), known.alias("kind"), "l_order", "r_order", F.when(F.col("at0").isNull(), F.col("t1")).otherwise(F.col("t0")).alias(token), F.col("how"))
