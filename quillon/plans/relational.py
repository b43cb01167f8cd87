"""Star-schema queries of our own: pricing summary, revenue by join, shares, semi joins, approximate counts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.sources.tables import load


@query("rel_pricing_summary", """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf):
    l = load(spark, sf, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))  # noqa: E741
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("rel_region_revenue", """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1""")
def region_revenue(spark, sf):
    """Filters reach the scan; Spark broadcasts the dimensions it knows to be small, and shuffles the rest."""
    l = load(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))  # noqa: E741
    o = load(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz'1994-01-01' AND o_orderdate < timestamp_ntz'1996-01-01'").select("o_orderkey", "o_custkey")
    per_order = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "rev")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return per_order.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.round(F.sum("rev"), 2).alias("revenue"))


@query("rel_brand_share", "SELECT p_brand, round(sum(l_quantity), 2) AS qty, round(100.0 * sum(l_quantity) / sum(sum(l_quantity)) OVER (), 6) AS share FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def brand_share(spark, sf):
    l = load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))  # noqa: E741
    b = l.join(load(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.sum("q").alias("q"))
    total = b.agg(F.sum("q").alias("t"))
    return b.crossJoin(F.broadcast(total)).select("p_brand", F.round("q", 2).alias("qty"), F.round(F.col("q") * 100.0 / F.col("t"), 6).alias("share"))


@query("rel_order_priority", "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount > 0.09) GROUP BY 1")
def order_priority(spark, sf):
    l = load(spark, sf, "lineitem").filter("l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey"))  # noqa: E741
    return load(spark, sf, "orders").join(l, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("rel_distinct_estimate", "SELECT l_returnflag, true AS close FROM lineitem GROUP BY 1")
def distinct_estimate(spark, sf):
    """An estimate of distinct counts within 15 per cent of the exact ones."""
    # beside an exact distinct count the estimate would keep a sketch for each value: distinct pairs first, then one for each flag
    once = load(spark, sf, "lineitem").select("l_returnflag", "l_partkey").distinct()
    g = once.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.count("l_partkey").alias("e"))
    return g.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= F.col("e") * 0.15).alias("close"))


@query("rel_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS quartile, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey), 6) AS pr FROM customer")
def ntile(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return load(spark, sf, "customer").select("c_custkey", F.ntile(4).over(w).alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("pr"))


@query("rel_unpivot", "SELECT l_returnflag, name, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT l_returnflag, unnest(['quantity', 'lines']) AS name, unnest([l_quantity, 1.0]) AS value FROM lineitem) GROUP BY ALL")
def unpivot(spark, sf):
    l = load(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("quantity"), F.lit(1.0).alias("lines"))  # noqa: E741
    return l.unpivot("l_returnflag", ["quantity", "lines"], "name", "value").groupBy("l_returnflag", "name").agg(F.sum("value").alias("total"))


@query("rel_nation_pairs", "SELECT count(*) AS pairs FROM nation, region")
def nation_pairs(spark, sf):
    """A cross join of two tables of fixed size."""
    return load(spark, sf, "nation").crossJoin(F.broadcast(load(spark, sf, "region"))).agg(F.count("*").alias("pairs"))
