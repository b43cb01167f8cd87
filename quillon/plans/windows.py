"""Window, ordering, sampling and set queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators.order import numbered
from quillon.plans.joins import RUN_A, RUN_B, runs
from quillon.plans.registry import query
from quillon.sources.tables import load


@query("w01_priority_dedup", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def priority_dedup(spark, sf):
    """The record of the highest priority; of equals the later one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority", F.desc("o_orderdate"), F.desc("o_orderkey"))
    return load(spark, sf, "orders").withColumn("k", F.row_number().over(w)).filter("k = 1").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("w02_steps", "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) > 1.0 AS step FROM lineitem")
def steps(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.abs(F.col("l_quantity") - F.lag("l_quantity").over(w)) > 1.0).alias("step"))


@query("w03_running_frames", "SELECT c_nationkey, c_custkey, round(sum(c_acctbal) OVER w, 2) AS running, count(*) OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def running_frames(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(-2, 0)
    return load(spark, sf, "customer").select("c_nationkey", "c_custkey", F.round(F.sum("c_acctbal").over(w), 2).alias("running"), F.count("*").over(w).alias("n"))


@query("w04_nearest_ancestor", "WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderpriority < '3' THEN o_orderkey END AS head FROM orders) SELECT o_orderkey, max(head) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM x")
def nearest_ancestor(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    head = F.when(F.col("o_orderpriority") < "3", F.col("o_orderkey"))
    return load(spark, sf, "orders").select("o_orderkey", F.last(head, ignorenulls=True).over(w).alias("parent"))


@query("w05_first_position", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, min(ts) AS first_ts FROM events GROUP BY 1")
def first_position(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.min("ts").alias("first_ts"))


@query("w09_next_present", "SELECT l_orderkey, l_linenumber, CASE WHEN d > 0 THEN d END AS step FROM (SELECT l_orderkey, l_linenumber, l_partkey, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - l_quantity AS d FROM lineitem)")
def next_present(spark, sf):
    """Step to the next key that is there; a step back or none is null (a new page)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    d = F.lead("l_quantity").over(w) - F.col("l_quantity")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", d.alias("d")).select("l_orderkey", "l_linenumber", F.when(F.col("d") > 0, F.col("d")).alias("step"))


@query("w10_first_occurrence", "SELECT l_partkey, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS first_supplier FROM lineitem GROUP BY 1")
def first_occurrence(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("first_supplier"))


@query("o01_input_order", "SELECT page_id, CAST(row_number() OVER (ORDER BY lower(url), page_id) - 1 AS INTEGER) AS ord FROM pages ORDER BY ord")
def input_order(spark, sf):
    """A global ordinal without a one-task window: ranges are sorted, counted, and offset by the ranges before."""
    return numbered(load(spark, sf, "pages").select("page_id", F.lower("url").alias("_k")), ["_k", "page_id"], "ord").select("page_id", F.col("ord").cast("int").alias("ord")).orderBy("ord")


@query("o02_leaderboard", "SELECT c_custkey, c_nationkey, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, -3) DESC) AS INTEGER) AS rank FROM customer")
def leaderboard(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.round("c_acctbal", -3).desc())
    return load(spark, sf, "customer").select("c_custkey", "c_nationkey", F.dense_rank().over(w).alias("rank"))


@query("l01_visible_limit", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) AS total, (SELECT count(*) FROM orders WHERE o_totalprice > 300000) > 25 AS truncated FROM orders WHERE o_totalprice > 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def visible_limit(spark, sf):
    """A top list that says how much it leaves out."""
    hit = load(spark, sf, "orders").filter("o_totalprice > 300000").select("o_orderkey", "o_totalprice")
    total = hit.agg(F.count("*").alias("total"))
    top = hit.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > 25)


@query("l02_summary_always", "SELECT 'line' AS kind, n_name AS label, 1::BIGINT AS n FROM (SELECT * FROM nation ORDER BY n_name LIMIT 3) UNION ALL SELECT 'summary', 'all', count(*) FROM nation")
def summary_always(spark, sf):
    n = load(spark, sf, "nation")
    lines = n.orderBy("n_name").limit(3).select(F.lit("line").alias("kind"), F.col("n_name").alias("label"), F.lit(1).cast("long").alias("n"))
    return lines.union(n.agg(F.lit("summary").alias("kind"), F.lit("all").alias("label"), F.count("*").alias("n")))


@query("m01_systematic_sample", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE i IN (SELECT CAST(floor(k * (SELECT count(*) FROM orders) / 50.0) AS BIGINT) FROM range(50) t(k))")
def systematic_sample(spark, sf):
    """Evenly spaced rows: int(i * n / 50)."""
    o = load(spark, sf, "orders").select("o_orderkey")
    n = o.agg(F.count("*").alias("n"))
    picks = spark.range(50).crossJoin(F.broadcast(n)).select(F.floor(F.col("id") * F.col("n") / 50.0).alias("i"))
    return numbered(o, ["o_orderkey"], "i").join(F.broadcast(picks), "i", "left_semi").select("o_orderkey")


@query("m02_seeded_sample", "SELECT page_id FROM pages ORDER BY sha256(url || '42'), page_id LIMIT 30")
def seeded_sample(spark, sf):
    return load(spark, sf, "pages").orderBy(F.sha2(F.concat("url", F.lit("42")), 256), "page_id").limit(30).select("page_id")


@query("u01_key_union", f"SELECT doc_id FROM {RUN_A} UNION SELECT doc_id FROM {RUN_B}")
def key_union(spark, sf):
    a, b = runs(spark, sf)
    return a.select("doc_id").union(b.select("doc_id")).distinct()


@query("u02_difference", "SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def difference(spark, sf):
    return load(spark, sf, "customer").select("c_nationkey").exceptAll(load(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))


@query("u03_set_bridge", "SELECT count(*) AS missing FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation)")
def set_bridge(spark, sf):
    return load(spark, sf, "supplier").select("s_nationkey").subtract(load(spark, sf, "nation").select("n_nationkey")).agg(F.count("*").alias("missing"))


@query("u04_intersect", "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(spark, sf):
    return load(spark, sf, "customer").select("c_nationkey").intersect(load(spark, sf, "supplier").select("s_nationkey"))


@query("u05_distinct_tuples", "SELECT l_returnflag, l_linestatus, l_tax, min(l_orderkey) AS first_order FROM lineitem GROUP BY ALL")
def distinct_tuples(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_tax").agg(F.min("l_orderkey").alias("first_order"))
