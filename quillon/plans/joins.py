"""Join queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import scalars
from quillon.operators import joins as J
from quillon.operators.alignment import align
from quillon.plans.registry import query
from quillon.sources.tables import PARAS_SQL, load, paragraphs

#: Two snapshots of verdicts for the same documents, as two projections of labels.
RUN_A = "(SELECT doc_id, CASE quality WHEN 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM labels WHERE doc_id % 10 <> 3)"
RUN_B = "(SELECT doc_id, CASE WHEN toxic = 1 THEN 'FAIL' WHEN quality = 1 OR doc_id % 4 = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM labels WHERE doc_id % 10 <> 7)"


def runs(spark, sf):
    l = load(spark, sf, "labels")  # noqa: E741
    a = l.filter("doc_id % 10 <> 3").select("doc_id", F.when(F.col("quality") == 1, "PASS").otherwise("FAIL").alias("verdict"))
    b = l.filter("doc_id % 10 <> 7").select("doc_id", F.when(F.col("toxic") == 1, "FAIL").when((F.col("quality") == 1) | (F.col("doc_id") % 4 == 0), "PASS").otherwise("FAIL").alias("verdict"))
    return a, b


@query("j01_compare_runs", f"SELECT doc_id, coalesce(a.verdict, 'MISSING') AS before, coalesce(b.verdict, 'MISSING') AS after FROM {RUN_A} a FULL JOIN {RUN_B} b USING (doc_id)")
def compare_runs(spark, sf):
    return J.compare_runs(*runs(spark, sf), ["doc_id"], "verdict")


@query("j02_lookup", "SELECT l.l_orderkey, l.l_linenumber, o_orderstatus, o_totalprice FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def lookup(spark, sf):
    l = load(spark, sf, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_linenumber")  # noqa: E741
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    return l.join(o, "l_orderkey", "left")


@query("j03_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def semi(spark, sf):
    l = load(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))  # noqa: E741
    return load(spark, sf, "orders").select("o_orderkey").join(l, "o_orderkey", "left_semi")


@query("j04_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti(spark, sf):
    return load(spark, sf, "documents").select("doc_id").join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "j05_containment",
    """WITH s AS (SELECT user_id, event_id AS span_id, epoch_us(ts) // 1000000 AS lo, epoch_us(ts) // 1000000 + 3600 AS hi FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS at FROM events WHERE event_type = 'purchase')
    SELECT p.event_id, s.span_id FROM p JOIN s ON p.user_id = s.user_id AND p.at BETWEEN s.lo AND s.hi""",
)
def containment(spark, sf):
    """Purchases within an hour of a user's sign-up, as a bucketed range join."""
    e = load(spark, sf, "events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    s = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("lo"), (F.col("at") + 3600).alias("hi"))
    p = e.filter("event_type = 'purchase'").select("user_id", "event_id", "at")
    return J.contained(p, s, ["user_id"], "at", "lo", "hi", 3600).select("event_id", "span_id")


@query("j06_address_join", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_name, s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 WHERE l_linenumber = 1")
def address_join(spark, sf):
    l = load(spark, sf, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")  # noqa: E741
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    s = load(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return l.join(p, "l_partkey", "left").join(s, "l_suppkey", "left")


@query(
    "j07_positional",
    f"""WITH {PARAS_SQL}, a AS (SELECT doc_id // 2 AS pair, para, text FROM paras WHERE doc_id % 2 = 0), b AS (SELECT doc_id // 2 AS pair, para, text FROM paras WHERE doc_id % 2 = 1)
    SELECT pair, para, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed' WHEN a.text <> b.text THEN 'changed' ELSE 'same' END AS kind FROM a FULL JOIN b USING (pair, para)""",
)
def positional(spark, sf):
    p = paragraphs(load(spark, sf, "documents")).withColumn("pair", F.floor(F.col("doc_id") / 2))
    a, b = (p.filter(F.col("doc_id") % 2 == k).select("pair", "para", F.col("text").alias(c)) for k, c in ((0, "a"), (1, "b")))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("same")
    return a.join(b, ["pair", "para"], "full_outer").select("pair", "para", kind.alias("kind"))


def _lines(spark, sf, parity):
    return load(spark, sf, "lineitem").filter(f"l_orderkey % 2 = {parity}").select(F.floor(F.col("l_orderkey") / 2).alias("pair"), F.col("l_linenumber").cast("long").alias("line"), F.concat("l_returnflag", "l_linestatus").alias("token"))


def _sides(spark, sf):
    once = lambda d: d.groupBy("pair", "line").agg(F.min("token").alias("token"))
    return once(_lines(spark, sf, 0)), once(_lines(spark, sf, 1))


@query("j08_lcs_align")
def lcs_align(spark, sf):
    """No SQL: of several longest alignments SQL can't name the one; j08_lcs_length has SQL for their length."""
    return align(*_sides(spark, sf), "pair", "line", "token").select("pair", "kind", "l_order", "r_order", "token")


@query(
    "j08_lcs_length",
    """WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS t FROM lineitem GROUP BY 1, 2),
    s AS (SELECT l_orderkey // 2 AS pair, l_orderkey % 2 AS side, list(t ORDER BY l_linenumber) AS s FROM l GROUP BY 1, 2),
    b AS (SELECT a.pair, a.s AS a, b.s AS b FROM s a JOIN s b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
    d AS (
      SELECT pair, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: 0) AS r FROM b
      UNION ALL SELECT pair, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda k: CASE WHEN k > 0 AND a[i + 1] = b[k] THEN greatest(r[k + 1], r[k] + 1) ELSE r[k + 1] END))) FROM d WHERE i < len(a))
    SELECT pair, CAST(r[len(b) + 1] AS BIGINT) AS common, CAST(len(a) - r[len(b) + 1] AS BIGINT) AS removed, CAST(len(b) - r[len(b) + 1] AS BIGINT) AS added FROM d WHERE i = len(a)""",
)
def lcs_length(spark, sf):
    """How much of both orders the longest alignment keeps, for pairs that have two sides."""
    got = align(*_sides(spark, sf), "pair", "line", "token")
    n = {k: F.count_if(F.col("kind") == v).alias(k) for k, v in (("common", "same"), ("removed", "removed"), ("added", "added"))}
    both = (F.count("l_order") > 0) & (F.count("r_order") > 0)
    return got.groupBy("pair").agg(*n.values(), both.alias("both")).filter("both").drop("both")


@query("j09_fuzzy_forward")
def fuzzy_forward(spark, sf):
    """No SQL: greedy and order-dependent. Lines are compared by their match keys of 24 cleaned characters."""
    c = load(spark, sf, "conversations").select("conv_id", F.col("turn").alias("line"), scalars.match_key(F.col("text")).alias("text"))
    return J.fuzzy_forward(c, c.withColumn("text", F.concat(F.lit(">"), "text")), "conv_id", "line", "text")


@query("j10_identity_compare", f"SELECT a.sha AS stable_id, count(*) AS pairs FROM (SELECT sha256(role || chr(10) || turn) AS sha FROM conversations WHERE conv_id % 2 = 0) a JOIN (SELECT sha256(role || chr(10) || turn) AS sha FROM conversations WHERE conv_id % 2 = 1) b USING (sha) GROUP BY 1")
def identity_compare(spark, sf):
    """Same stable id on both sides; counts are multiplied, not pairs listed."""
    c = load(spark, sf, "conversations").select("conv_id", F.sha2(F.concat("role", F.lit("\n"), F.col("turn").cast("string")), 256).alias("stable_id"))
    a, b = (c.filter(F.col("conv_id") % 2 == k).groupBy("stable_id").agg(F.count("*").alias(f"n{k}")) for k in (0, 1))
    return a.join(b, "stable_id").select("stable_id", (F.col("n0") * F.col("n1")).alias("pairs"))


@query("j11_mail_merge", "SELECT n_name AS template, r_name AS value, replace('Dear {name} of {place}', '{name}', n_name) AS letter FROM nation, region WHERE n_regionkey = r_regionkey")
def mail_merge(spark, sf):
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    j = n.join(J.small(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_name").alias("template"), F.col("r_name").alias("value"), F.replace(F.lit("Dear {name} of {place}"), F.lit("{name}"), F.col("n_name")).alias("letter"))


@query("j12_common_names", f"SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both_sides, count(*) FILTER (b.doc_id IS NULL) AS only_before, count(*) FILTER (a.doc_id IS NULL) AS only_after FROM {RUN_A} a FULL JOIN {RUN_B} b ON a.doc_id = b.doc_id")
def common_names(spark, sf):
    a, b = runs(spark, sf)
    j = a.select("doc_id", F.lit(1).alias("a")).join(b.select("doc_id", F.lit(1).alias("b")), "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"), F.count_if(F.col("b").isNull()).alias("only_before"), F.count_if(F.col("a").isNull()).alias("only_after"))


@query(
    "j13_prefix_fallback",
    """WITH k AS (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_name || ' (REPUBLIC)' END AS key FROM nation)
    SELECT n_nationkey, key, arg_min(n.n_regionkey, (n.n_name <> key, n.n_name)) AS region FROM k LEFT JOIN (SELECT n_name, n_regionkey FROM nation) n ON starts_with(key, n.n_name) GROUP BY 1, 2""",
)
def prefix_fallback(spark, sf):
    n = load(spark, sf, "nation")
    k = n.select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" (REPUBLIC)"))).alias("key"))
    return J.lookup(k, n.select("n_name", F.col("n_regionkey").alias("region")), F.col("key"), "n_name", "region")


@query(
    "rel_asof_join",
    """SELECT p.event_id, p.user_id, arg_max(v.event_id, (v.ts, v.event_id)) AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts <= p.ts GROUP BY 1, 2""",
)
def asof(spark, sf):
    e = load(spark, sf, "events")
    p = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    v = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_view"))
    return J.as_of(p, v, ["user_id"], "ts", "ts", ["last_view"]).select("event_id", "user_id", "last_view")


@query("rel_topk_per_group", "SELECT c_nationkey, c_custkey, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer) WHERE rank <= 3")
def topk_per_group(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return load(spark, sf, "customer").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("c_nationkey", "c_custkey", "rank")
