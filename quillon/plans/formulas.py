"""Formula queries over lineitem as grids: a table is an order, a row a line, columns are A quantity, B price, C discount, D tax."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators.formula import block, evaluate
from quillon.plans.registry import query
from quillon.sources.tables import load

COLUMNS = {"A": "a", "B": "b", "C": "c", "D": "d"}
_GRID = """g AS (SELECT l_orderkey AS t, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS r, l_quantity AS a, CASE WHEN l_quantity > 45 THEN NULL ELSE l_extendedprice END AS b, l_discount AS c, l_tax AS d FROM lineitem)"""


def grid(spark, sf):
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("t"), r.alias("r"), F.col("l_quantity").alias("a"), F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_extendedprice")).alias("b"), F.col("l_discount").alias("c"), F.col("l_tax").alias("d"))


#: name: (formula, column it stands in, SQL of the same).
_W = "(PARTITION BY t ORDER BY r ROWS BETWEEN"
CASES = {
    "f01_cell_ref": ("=A1+1", "D", "max(a) FILTER (r = 1) OVER (PARTITION BY t) + 1"),
    "f02_range": ("=SUM(A1:B3)", "D", "coalesce(sum(a) FILTER (r <= 3) OVER (PARTITION BY t), 0) + coalesce(sum(b) FILTER (r <= 3) OVER (PARTITION BY t), 0)"),
    "f03_wildcard": ("=A?*2", "D", "a * 2"),
    "f04_above": ("=SUM(above)", "A", f"coalesce(sum(a) OVER {_W} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"),
    "f04_below": ("=MAX(below)", "A", f"max(a) OVER {_W} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"),
    "f05_left": ("=SUM(left)*2", "D", "(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) * 2"),
    "f05_right": ("=SUM(right)", "B", "c + d"),
    "f06_arithmetic": ("=-(A?+2)*3/(C?-0.05)", "D", "-(a + 2) * 3 / nullif(c - 0.05, 0)"),
    "f07_sum": ("=SUM(A?,B?,10)", "D", "coalesce(a, 0) + coalesce(b, 0) + 10"),
    "f08_average": ("=AVERAGE(A1:A9)", "D", "avg(a) FILTER (r <= 9) OVER (PARTITION BY t)"),
    "f08_avg": ("=AVG(A?,B?)", "D", "CASE WHEN b IS NULL THEN a ELSE (a + b) / 2 END"),
    "f09_product": ("=PRODUCT(A?,C?)", "D", "a * c"),
    "f10_min": ("=MIN(A1:A9)", "D", "min(a) FILTER (r <= 9) OVER (PARTITION BY t)"),
    "f11_max": ("=MAX(A?,B?)", "D", "greatest(a, b)"),
    "f12_count": ("=COUNT(B1:B9)", "D", "CAST(count(b) FILTER (r <= 9) OVER (PARTITION BY t) AS DOUBLE)"),
    "f13_trig": ("=ROUND(COS(A?)+SIN(A?)+TAN(C?),6)", "D", "round(cos(a) + sin(a) + tan(c), 6)"),
    "f14_inverse_trig": ("=ROUND(ACOS(C?)+ASIN(C?)+ATAN(A?),6)", "D", "round(acos(c) + asin(c) + atan(a), 6)"),
    "f15_abs": ("=ABS(10-A?)", "D", "abs(10 - a)"),
    "f16_exp": ("=ROUND(EXP(C?),6)", "D", "round(exp(c), 6)"),
    "f17_log": ("=ROUND(LOG(C?),6)", "D", "CASE WHEN c > 0 THEN round(ln(c), 6) END"),
    "f18_log10": ("=ROUND(LOG10(A?),6)", "D", "CASE WHEN a > 0 THEN round(log10(a), 6) END"),
    "f19_sqrt": ("=ROUND(SQRT(A?),6)", "D", "round(sqrt(a), 6)"),
    "f20_radian": ("=ROUND(RADIAN(A?),6)", "D", "round(radians(a), 6)"),
    "f21_sign": ("=SIGN(A?-25)", "D", "CAST(sign(a - 25) AS DOUBLE)"),
    "f22_ceiling": ("=CEILING(A?/3)", "D", "ceil(a / 3)"),
    "f23_floor": ("=FLOOR(A?/3)", "D", "floor(a / 3)"),
    "f24_round": ("=ROUND(A?/4)", "D", "round(a / 4, 0)"),
    "f25_trunc": ("=TRUNC((A?-25)/3)", "D", "trunc((a - 25) / 3) + 0.0"),
    "f26_mod": ("=MOD(A?-25,7)", "D", "CAST((a - 25) % 7 AS DOUBLE)"),
    "f27_if": ("=IF(C?,A?,-1)", "D", "CASE WHEN c <> 0 THEN a ELSE -1 END"),
    "f28_int": ("=INT((A?-25)/3)", "D", "trunc((a - 25) / 3) + 0.0"),
}


def _make(formula, target):
    def run(spark, sf):
        return evaluate(grid(spark, sf), formula, "t", "r", COLUMNS, target, "value").select("t", "r", "value")

    return run


for _name, (_formula, _target, _sql) in CASES.items():
    query(_name, f"WITH {_GRID} SELECT t, r, CAST({_sql} AS DOUBLE) AS value FROM g")(_make(_formula, _target))


@query("f29_block", f"WITH {_GRID} SELECT t, sum(a) AS \"A\", sum(b) AS \"B\", round(sum(c), 6) AS \"C\", round(sum(d), 6) AS \"D\" FROM g GROUP BY t")
def block_sum(spark, sf):
    out = block(grid(spark, sf), "SUM", "t", COLUMNS)
    return out.select("t", "A", "B", F.round("C", 6).alias("C"), F.round("D", 6).alias("D"))
