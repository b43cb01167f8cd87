"""Structure, table and chart queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import scalars
from quillon.operators import structure as S
from quillon.plans.registry import query
from quillon.sources.tables import PARAS_SQL, load, paragraphs


@query(
    "t15_outline",
    """WITH x AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS line, CAST(l_quantity AS INTEGER) % 3 + 1 AS level FROM lineitem)
    SELECT a.l_orderkey, a.line, a.level, CAST(max(p.line) AS INTEGER) AS parent FROM x a LEFT JOIN x p ON p.l_orderkey = a.l_orderkey AND p.line < a.line AND p.level < a.level GROUP BY ALL""",
)
def outline(spark, sf):
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    x = load(spark, sf, "lineitem").select("l_orderkey", line.alias("line"), (F.col("l_quantity").cast("int") % 3 + 1).alias("level"))
    return S.parents(x, "l_orderkey", "line", "level", 3)


@query(
    "t16_clause_markers",
    f"""WITH {PARAS_SQL}, m AS (SELECT doc_id, para, CASE para % 4 WHEN 0 THEN '제' || (para + 1) || '조 ' WHEN 1 THEN '1. ' WHEN 2 THEN 'a) ' ELSE '' END || text AS t FROM paras)
    SELECT doc_id, para, CASE WHEN regexp_matches(t, '^제([0-9]+)조(의[0-9]+)?') THEN 1 WHEN regexp_matches(t, '^([0-9]+)[.)] ') THEN 2 WHEN regexp_matches(t, '^([a-z])[.)] ') THEN 3 END AS level FROM m""",
)
def clause_markers(spark, sf):
    return paragraphs(_marked(spark, sf)).select("doc_id", "para", S.marker_level(F.col("text")).alias("level"))


def _head(i):
    """The marker that line i gets."""
    k = i % 4
    return F.when(k == 0, F.concat(F.lit("제"), (i + 1).cast("string"), F.lit("조 "))).when(k == 1, "1. ").when(k == 2, "a) ").otherwise("")


def _marked(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(_head(i), x)), "\n").alias("text"))


@query(
    "t17_gated_clauses",
    f"""WITH {PARAS_SQL}, m AS (SELECT doc_id, para, para % 4 AS k FROM paras)
    SELECT doc_id, para, CAST(CASE WHEN k < 3 THEN k + 1 ELSE 0 END AS INTEGER) AS level, CASE WHEN k > 0 THEN CAST(para - 1 AS INTEGER) END AS parent, CASE k WHEN 0 THEN 'article' WHEN 1 THEN 'item' WHEN 2 THEN 'subitem' ELSE 'body' END AS kind FROM m""",
)
def gated_clauses(spark, sf):
    """Every fourth line is an article, the next its item, the next a sub-item, the next its text."""
    return S.clauses(_marked(spark, sf))


@query(
    "t18_structure_mode",
    f"""WITH {PARAS_SQL}, s AS (SELECT doc_id, bool_or(regexp_matches(text, '^(#{{1,6}}) ')) AS o, bool_or(regexp_matches(text, '^제([0-9]+)조')) AS c, bool_or(regexp_matches(text, '^([0-9]+)[.)] ')) AS n FROM paras GROUP BY 1)
    SELECT doc_id, CASE WHEN o THEN 'outline' WHEN c THEN 'clause' WHEN n THEN 'list' ELSE 'none' END AS mode FROM s""",
)
def structure_mode(spark, sf):
    p = paragraphs(load(spark, sf, "documents"))
    any_ = lambda c: F.bool_or(c)
    return p.groupBy("doc_id").agg(S.structure_mode(any_(F.col("text").rlike("^(#{1,6}) ")), any_(F.col("text").rlike(r"^제([0-9]+)조")), any_(F.col("text").rlike(r"^([0-9]+)[.)] "))).alias("mode"))


@query(
    "t19_tables_spans",
    """WITH c AS (SELECT l_orderkey, l_linenumber AS r, CAST(l_quantity AS INTEGER) % 3 AS rs, CAST(l_tax * 100 AS INTEGER) % 3 AS cs, l_returnflag AS t FROM lineitem),
    x AS (SELECT *, unnest(range(greatest(rs, 1))) AS dr FROM c), y AS (SELECT *, unnest(range(greatest(cs, 1))) AS dc FROM x)
    SELECT l_orderkey, CAST(r + dr AS INTEGER) AS row, CAST(dc AS INTEGER) AS col, CASE WHEN dr = 0 AND dc = 0 THEN 'anchor' WHEN dr = 0 THEN 'left' WHEN dc = 0 THEN 'up' ELSE 'cross' END AS token, count(*) AS n FROM y GROUP BY ALL""",
)
def tables_spans(spark, sf):
    c = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row"), F.lit(0).alias("col"), (F.col("l_quantity").cast("int") % 3).alias("row_span"), ((F.col("l_tax") * 100).cast("int") % 3).alias("col_span"), F.col("l_returnflag").alias("text"))
    return S.expand_spans(c, ("l_orderkey",)).groupBy("l_orderkey", "row", "col", "token").agg(F.count("*").alias("n"))


@query("t20_note_counts", f"WITH {PARAS_SQL} SELECT doc_id, count(*) FILTER (contains(text, '.')) AS notes, count(*) FILTER (length(text) > 200 AND page < 8) AS long_notes FROM paras GROUP BY 1")
def note_counts(spark, sf):
    return paragraphs(load(spark, sf, "documents")).groupBy("doc_id").agg(F.count_if(F.col("text").contains(".")).alias("notes"), F.count_if((F.length("text") > 200) & (F.col("page") < 8)).alias("long_notes"))


@query("t21_navigation", "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS entry FROM pages WHERE contains(html, '<h1>')")
def navigation(spark, sf):
    return load(spark, sf, "pages").filter(F.col("html").contains("<h1>")).select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("entry"))


@query(
    "t22_bookmarks",
    """SELECT n_nationkey, CASE WHEN n_name = 'FRANCE' THEN 'La France' ELSE n_name END AS name FROM nation WHERE n_name <> 'GERMANY' UNION ALL SELECT 99, 'ADDED'""",
)
def bookmarks(spark, sf):
    """Rename one, delete one, add one; the rest stay."""
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    kept = n.filter("n_name <> 'GERMANY'").select("n_nationkey", F.when(F.col("n_name") == "FRANCE", "La France").otherwise(F.col("n_name")).alias("name"))
    return kept.union(spark.createDataFrame([(99, "ADDED")], "n_nationkey int, name string"))


@query("t24_chart_matrix", "SELECT strftime(ts, '%Y-%m-%d') AS category, " + ", ".join(f"round(sum(value) FILTER (event_type = '{t}'), 2) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def chart_matrix(spark, sf):
    """Categories are days, series are event types; the list of series is fixed, so no job finds it."""
    e = load(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("category"), "event_type", "value")
    series = ("click", "error", "purchase", "signup", "view")
    return e.groupBy("category").pivot("event_type", list(series)).agg(F.round(F.sum("value"), 2))


@query("t24_chart_long", "SELECT strftime(ts, '%Y-%m-%d') AS category, event_type AS series, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def chart_long(spark, sf):
    """The matrix of counts turned back into rows."""
    e = load(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("category"), "event_type")
    wide = e.groupBy("category").pivot("event_type", ["click", "view"]).count()
    return wide.unpivot("category", ["click", "view"], "series", "n").filter("n is not null")


@query(
    "t28_anchor_candidates",
    f"""WITH {PARAS_SQL}, s AS (SELECT doc_id, para, text, length(text) AS n, len(list_distinct(string_split(text, ''))) AS u, length(text) - length(replace(text, ' ', '')) AS b FROM paras WHERE text <> '')
    SELECT doc_id, para, sha256(text) AS signature, n >= 40 AND u >= 12 AND b * 100 <= 30 * n AND list_aggregate(string_split(text, ''), 'entropy') >= 3.3 AS is_anchor FROM s""",
)
def anchors(spark, sf):
    p = paragraphs(load(spark, sf, "documents")).filter("text <> ''")
    n, t = F.length("text"), F.col("text")
    blanks = n - F.length(F.replace("text", F.lit(" "), F.lit("")))
    # only lines that may be anchors are taken apart
    may = (n >= 40) & (blanks * 100 <= n * 30)
    told = p.withColumns({"may": may, "bits": scalars.entropy(F.when(may, t))})
    rich = F.when(~F.col("may") | (F.col("bits") < 3.3), False).otherwise(F.size(F.array_distinct(F.split(t, ""))) >= 12)
    return told.select("doc_id", "para", F.sha2("text", 256).alias("signature"), rich.alias("is_anchor"))


@query("t29_default_numbering", "SELECT n_nationkey, (n_regionkey + 1) || '.' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) || '.' AS number FROM nation")
def default_numbering(spark, sf):
    """Without a definition an outline is numbered by its level path and a trailing dot."""
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return load(spark, sf, "nation").select("n_nationkey", F.concat((F.col("n_regionkey") + 1).cast("string"), F.lit("."), k.cast("string"), F.lit(".")).alias("number"))


@query("p09_set_cell", """WITH g AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS r FROM orders)
    SELECT g.o_orderkey, l_linenumber AS anchor_row, CASE WHEN l_linenumber IS NULL THEN 'out of grid' WHEN l_linenumber <> r THEN 'covered by ' || l_linenumber ELSE 'set' END AS outcome
    FROM g LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_tax * 100 AS INTEGER) % 2 + 1 AS rs FROM lineitem) c ON c.l_orderkey = g.o_orderkey AND g.r BETWEEN l_linenumber AND l_linenumber + rs - 1""")
def set_cell(spark, sf):
    """Writing to (table, row): a merged cell names its anchor, a missing one is out of the grid."""
    g = load(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("r"))
    c = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_tax") * 100).cast("int") % 2 + 1).alias("rs")).distinct()
    j = g.join(c, (F.col("l_orderkey") == F.col("o_orderkey")) & F.col("r").between(F.col("l_linenumber"), F.col("l_linenumber") + F.col("rs") - 1), "left")
    a = F.col("l_linenumber")
    return j.select("o_orderkey", a.alias("anchor_row"), F.when(a.isNull(), "out of grid").when(a != F.col("r"), F.concat(F.lit("covered by "), a.cast("string"))).otherwise("set").alias("outcome"))


@query("p21_control_gaps", "SELECT l_orderkey, CAST(sum(CASE WHEN gap > 1 THEN gap - 1 ELSE 0 END) AS BIGINT) AS hidden_controls FROM (SELECT l_orderkey, l_linenumber * 2 - lag(l_linenumber * 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS gap FROM lineitem) GROUP BY 1")
def control_gaps(spark, sf):
    """Positions of inline controls show as gaps between neighbouring character offsets."""
    o = F.col("l_linenumber") * 2
    gap = o - F.lag(o).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    x = load(spark, sf, "lineitem").select("l_orderkey", gap.alias("gap"))
    return x.groupBy("l_orderkey").agg(F.sum(F.when(F.col("gap") > 1, F.col("gap") - 1).otherwise(0)).cast("long").alias("hidden_controls"))


@query(
    "t19_nested_tables",
    """WITH RECURSIVE t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 3 THEN o_orderkey // 3 END AS up FROM orders),
    d AS (SELECT id, 0 AS depth FROM t WHERE up IS NULL UNION ALL SELECT t.id, d.depth + 1 FROM t JOIN d ON t.up = d.id WHERE d.depth < 7)
    SELECT id AS table_id, CAST(id % 3 AS INTEGER) AS section, CAST(id % 50 AS INTEGER) AS paragraph, CAST(depth AS INTEGER) AS depth, l_linenumber AS row, CAST(l_suppkey % 4 AS INTEGER) AS col,
      CAST(least(greatest(CAST(l_quantity AS INTEGER) % 3, 1), 6 - l_linenumber) AS INTEGER) AS row_span, CAST(least(2, 3 - l_suppkey % 4) AS INTEGER) AS col_span, l_returnflag AS text
    FROM lineitem JOIN d ON id = l_orderkey WHERE l_linenumber < 6 AND l_suppkey % 4 < 3""",
)
def nested_tables(spark, sf):
    """Orders stand in the order of a third of their number; lines are anchor cells, some outside of their grid."""
    o, key = load(spark, sf, "orders"), F.col("o_orderkey")
    t = o.select(key.alias("table_id"), F.when(key > 3, F.expr("o_orderkey div 3")).alias("parent_id"), F.lit(6).alias("rows"), F.lit(3).alias("cols"), (key % 3).cast("int").alias("section"), (key % 50).cast("int").alias("paragraph"))
    c = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 4).cast("int").alias("col"), (F.col("l_quantity").cast("int") % 3).alias("row_span"), F.lit(2).alias("col_span"), F.col("l_returnflag").alias("text"))
    return S.export_tables(t, c)
