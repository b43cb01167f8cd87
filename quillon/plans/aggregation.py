"""Aggregation queries."""

from pyspark.sql import functions as F

from quillon.operators.order import medians
from quillon.plans.joins import RUN_A, RUN_B, runs
from quillon.plans.registry import query
from quillon.sources.tables import PARAS_SQL, load, paragraphs


@query("a01_page_list", f"WITH {PARAS_SQL} SELECT doc_id, CAST(max(page) + 1 AS BIGINT) AS pages FROM paras GROUP BY 1")
def page_list(spark, sf):
    """The list by file that the totals are made of."""
    return paragraphs(load(spark, sf, "documents")).groupBy("doc_id").agg((F.max("page") + 1).cast("long").alias("pages"))


@query("a01_total_pages", f"WITH {PARAS_SQL}, p AS (SELECT doc_id, CAST(max(page) + 1 AS BIGINT) AS n FROM paras GROUP BY 1) SELECT lang, sum(n)::BIGINT AS total_pages, count(*) AS files FROM p JOIN documents USING (doc_id) GROUP BY 1")
def total_pages(spark, sf):
    docs = load(spark, sf, "documents")
    per = paragraphs(docs).groupBy("doc_id").agg((F.max("page") + 1).alias("n"))
    return docs.select("doc_id", "lang").join(per, "doc_id").groupBy("lang").agg(F.sum("n").alias("total_pages"), F.count("*").alias("files"))


@query("a02_grouped_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def grouped_counts(spark, sf):
    return load(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("a03_delta_histogram", "WITH d AS (SELECT CASE WHEN l_tax > 0.07 THEN NULL ELSE CAST(l_quantity AS INTEGER) % 5 - 2 END AS delta FROM lineitem) SELECT delta, count(*) AS n, round(100.0 * count(*) FILTER (delta = 0) / nullif(max(valid), 0), 4) AS match_pct FROM d, (SELECT count(delta) AS valid FROM d) GROUP BY 1")
def delta_histogram(spark, sf):
    """Counts by delta; errors are a bucket of their own (null) and no part of the ratio."""
    d = load(spark, sf, "lineitem").select(F.when(F.col("l_tax") > 0.07, None).otherwise(F.col("l_quantity").cast("int") % 5 - 2).alias("delta"))
    h = d.groupBy("delta").agg(F.count("*").alias("n"))
    valid = h.agg(F.sum(F.when(F.col("delta").isNotNull(), F.col("n"))).alias("valid"))
    return h.crossJoin(F.broadcast(valid)).select("delta", "n", F.when(F.col("valid") != 0, F.round(F.when(F.col("delta") == 0, F.col("n")).otherwise(0) * 100.0 / F.col("valid"), 4)).alias("match_pct"))


@query("a04_diff_summary", f"SELECT CASE WHEN a.verdict IS NULL THEN 'added' WHEN b.verdict IS NULL THEN 'removed' WHEN a.verdict <> b.verdict THEN 'modified' ELSE 'same' END AS category, count(*) AS n FROM {RUN_A} a FULL JOIN {RUN_B} b USING (doc_id) GROUP BY 1")
def diff_summary(spark, sf):
    a, b = runs(spark, sf)
    j = a.withColumnRenamed("verdict", "x").join(b.withColumnRenamed("verdict", "y"), "doc_id", "full_outer")
    return j.groupBy(F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "modified").otherwise("same").alias("category")).agg(F.count("*").alias("n"))


@query("a06_conditional_counters", f"SELECT count(*) FILTER (a.verdict = 'FAIL' AND b.verdict = 'PASS') AS improved, count(*) FILTER (a.verdict = 'PASS' AND b.verdict = 'FAIL') AS regressed, count(*) FILTER (a.verdict = 'PASS' AND b.verdict = 'PASS') AS same_ok, count(*) FILTER (a.verdict = 'FAIL' AND b.verdict = 'FAIL') AS same_bad, count(*) FILTER (a.verdict IS NULL OR b.verdict IS NULL) AS err FROM {RUN_A} a FULL JOIN {RUN_B} b USING (doc_id)")
def conditional_counters(spark, sf):
    a, b = runs(spark, sf)
    j = a.withColumnRenamed("verdict", "x").join(b.withColumnRenamed("verdict", "y"), "doc_id", "full_outer")
    is_ = lambda x, y: (F.col("x") == x) & (F.col("y") == y)
    return j.agg(*[F.count_if(c).alias(n) for n, c in (("improved", is_("FAIL", "PASS")), ("regressed", is_("PASS", "FAIL")), ("same_ok", is_("PASS", "PASS")), ("same_bad", is_("FAIL", "FAIL")), ("err", F.col("x").isNull() | F.col("y").isNull()))])


@query("a07_bounded_examples", "SELECT o_orderpriority, count(*) AS n, (list(o_orderkey ORDER BY o_orderkey) FILTER (o_totalprice > 400000))[:5] AS examples FROM orders GROUP BY 1")
def bounded_examples(spark, sf):
    """Full counts, and the five first examples: a rank filter before the shuffle, no long list."""
    from pyspark.sql import Window

    o = load(spark, sf, "orders")
    total = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    some = o.filter("o_totalprice > 400000").withColumn("k", F.row_number().over(w)).filter("k <= 5").groupBy("o_orderpriority").agg(F.array_sort(F.collect_list("o_orderkey")).alias("examples"))
    return total.join(some, "o_orderpriority", "left")


@query("a08_median_deltas", "SELECT l_returnflag, median(l_quantity - 25) AS median_delta, min(l_quantity - 25) AS min_delta, max(l_quantity - 25) AS max_delta FROM lineitem GROUP BY 1")
def median_deltas(spark, sf):
    l = load(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") - 25).alias("d"))  # noqa: E741
    ends = l.groupBy("l_returnflag").agg(F.min("d").alias("min_delta"), F.max("d").alias("max_delta"))
    mid = medians(l, ["l_returnflag"], "d", "median_delta").withColumnRenamed("l_returnflag", "flag")
    return ends.join(mid, F.col("l_returnflag").eqNullSafe(F.col("flag")), "left").select("l_returnflag", "median_delta", "min_delta", "max_delta")


@query("a09_distinct_ids", "SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def distinct_ids(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query("a10_batch_totals", "SELECT count(*) AS total, count(*) FILTER (length(text) > 100) AS success, count(*) FILTER (length(text) <= 100 AND length(text) > 0) AS failed, count(*) FILTER (text IS NULL OR text = '') AS skipped FROM documents")
def batch_totals(spark, sf):
    n = F.length("text")
    return load(spark, sf, "documents").agg(F.count("*").alias("total"), F.count_if(n > 100).alias("success"), F.count_if((n <= 100) & (n > 0)).alias("failed"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("skipped"))


@query("a11_hotspots", "SELECT lang, source, count(*) AS n FROM documents WHERE sha256(text) <> sha256(replace(text, ' the ', ' The ')) GROUP BY ALL ORDER BY n DESC, lang, source LIMIT 20")
def hotspots(spark, sf):
    """Payloads that differ between what was read and what was generated, counted by role and control."""
    d = load(spark, sf, "documents").filter(F.sha2("text", 256) != F.sha2(F.replace("text", F.lit(" the "), F.lit(" The ")), 256))
    return d.groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "source").limit(20)


@query("a12_pack_scores", "SELECT o_custkey, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP") + ", count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) AS total FROM orders GROUP BY 1")
def pack_scores(spark, sf):
    p = load(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0, ["F", "O", "P"])
    return p.withColumn("total", F.col("F") + F.col("O") + F.col("P"))


@query("a13_distinct_sorted", "SELECT p_brand, list_sort(list(DISTINCT p_size)) AS sizes FROM part GROUP BY 1")
def distinct_sorted(spark, sf):
    return load(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("sizes"))


@query("a14_loss_merge", "SELECT kind, count(*) AS n FROM (SELECT 'long' AS kind FROM documents WHERE length(text) > 5000 UNION ALL SELECT 'junk' FROM documents WHERE contains(text, '|') UNION ALL SELECT 'link' FROM pages WHERE contains(html, '?page=')) GROUP BY 1")
def loss_merge(spark, sf):
    d, p = load(spark, sf, "documents"), load(spark, sf, "pages")
    a = d.filter(F.length("text") > 5000).select(F.lit("long").alias("kind"))
    b = d.filter(F.col("text").contains("|")).select(F.lit("junk").alias("kind"))
    return a.union(b).union(p.filter(F.col("html").contains("?page=")).select(F.lit("link").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("a15_json_leaves", "SELECT event_type, CAST(sum(len(json_keys(props))) AS BIGINT) AS leaves FROM events GROUP BY 1")
def json_leaves(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.sum(F.size(F.json_object_keys("props"))).alias("leaves"))


@query("a16_valid_medians", "SELECT p_brand, median(p_retailprice) FILTER (p_size > 10 AND p_retailprice > 1200) AS med, max(p_retailprice) FILTER (p_size > 10 AND p_retailprice > 1200) AS top, count(*) FILTER (p_size > 10 AND p_retailprice > 1200) AS valid, count(*) AS n FROM part GROUP BY 1")
def valid_medians(spark, sf):
    """Groups without a valid row are reported too, with nulls."""
    ok = (F.col("p_size") > 10) & (F.col("p_retailprice") > 1200)
    p = load(spark, sf, "part").select("p_brand", ok.alias("ok"), F.when(ok, F.col("p_retailprice")).alias("v"))
    all_ = p.groupBy("p_brand").agg(F.max("v").alias("top"), F.count_if("ok").alias("valid"), F.count("*").alias("n"))
    mid = medians(p, ["p_brand"], "v", "med").withColumnRenamed("p_brand", "brand")
    return all_.join(mid, F.col("p_brand").eqNullSafe(F.col("brand")), "left").select("p_brand", "med", "top", "valid", "n")


@query("a17_net_effect", f"WITH j AS (SELECT CASE a.verdict WHEN 'PASS' THEN 0 ELSE 1 END AS x, CASE b.verdict WHEN 'PASS' THEN 0 ELSE 1 END AS y FROM {RUN_A} a JOIN {RUN_B} b USING (doc_id)) SELECT count(*) FILTER (y < x) AS improved, count(*) FILTER (y > x) AS worsened, count(*) FILTER (y < x) - count(*) FILTER (y > x) AS net FROM j")
def net_effect(spark, sf):
    a, b = runs(spark, sf)
    sev = lambda c: F.when(F.col(c) == "PASS", 0).otherwise(1)
    j = a.withColumnRenamed("verdict", "x").join(b.withColumnRenamed("verdict", "y"), "doc_id").select(sev("x").alias("x"), sev("y").alias("y"))
    up, down = F.count_if(F.col("y") < F.col("x")), F.count_if(F.col("y") > F.col("x"))
    return j.agg(up.alias("improved"), down.alias("worsened"), (up - down).alias("net"))


@query("a18_nested_max", "SELECT event_id, coalesce(CASE WHEN event_type <> 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END, 0) AS top FROM events")
def nested_max(spark, sf):
    """Largest of a nested list, 0 if the list is empty or missing."""
    vals = F.transform(F.map_values(F.from_json("props", "map<string,string>")), lambda v: v.cast("long"))
    got = F.when(F.col("event_type") != "click", F.array_max(vals))
    return load(spark, sf, "events").select("event_id", F.coalesce(got, F.lit(0).cast("long")).alias("top"))


_GS = "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS qty, count(*) AS n FROM lineitem GROUP BY "


@query("rel_cube", _GS + "CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf):
    return load(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("rel_rollup", _GS + "ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf):
    return load(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@query("rel_grouping_sets", _GS + "GROUPING SETS ((l_returnflag), (l_linestatus))")
def grouping_sets(spark, sf):
    l = load(spark, sf, "lineitem")  # noqa: E741
    return l.groupingSets([["l_returnflag"], ["l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
