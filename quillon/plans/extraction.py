"""Extraction queries: values, links, fields, personal data, templates."""

from pyspark.sql import functions as F

from quillon.operators import extraction as X
from quillon.operators import forms, templates
from quillon.plans.registry import query
from quillon.sources import markup
from quillon.sources.tables import PARAS_SQL, load, paragraphs

_KINDS = ", ".join(f"('{k}', regexp_extract_all(text, '{p}'))" for k, p in X.PATTERNS.items())


@query(
    "t08_extract_data",
    f"""WITH {PARAS_SQL}, k AS (SELECT doc_id, section, para, page, unnest([{', '.join(f"{{'kind': '{k}', 'vals': regexp_extract_all(text, '{p}')}}" for k, p in X.PATTERNS.items())}]) AS f FROM paras)
    SELECT doc_id, section, para, page, f.kind AS kind, CAST(unnest(range(len(f.vals))) AS INTEGER) AS ordinal, unnest(f.vals) AS value FROM k""",
)
def extract_data(spark, sf):
    return X.extract_values(paragraphs(load(spark, sf, "documents")))


@query(
    "t09_pii_scan",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) AS emails,
      len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS ips,
      len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 13 AND 19 AND
        list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN (length(x) - i) % 2 = 0 THEN CAST(x[i] AS INTEGER) WHEN CAST(x[i] AS INTEGER) > 4 THEN CAST(x[i] AS INTEGER) * 2 - 9 ELSE CAST(x[i] AS INTEGER) * 2 END)) % 10 = 0)) AS cards
    FROM documents""",
)
def pii_scan(spark, sf):
    return X.pii_counts(load(spark, sf, "documents"))


@query(
    "t10_redact",
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+', '[email]', 'g'), '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}', '[ip]', 'g'), '[0-9]{13,19}', '[digits]', 'g')) AS redacted_sha FROM documents""",
)
def redact(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2(X.redact(F.col("text")), 256).alias("redacted_sha"))


@query(
    "s16_html_links",
    """WITH h AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s(?:[^>]*\\s)?href\\s*=\\s*"([^"]*)"', 1) AS l FROM pages)
    SELECT page_id, CAST(unnest(range(len(l))) AS INTEGER) AS ordinal, unnest(l) AS href FROM h""",
)
def html_links(spark, sf):
    return X.links(load(spark, sf, "pages"))


@query(
    "p03_fields",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE k END AS name, CASE WHEN event_type = 'click' THEN NULL ELSE CAST(json_extract_string(props, '$.' || k) AS BIGINT) END AS value
    FROM (SELECT event_id, event_type, props, unnest(json_keys(props)) AS k FROM events)""",
)
def fields(spark, sf):
    """Fields of every record; one without any has an empty list and stays, as a row of nulls."""
    e = load(spark, sf, "events").withColumn("f", F.when(F.col("event_type") == "click", F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.map_entries(F.from_json("props", "map<string,string>"))))
    return e.select("event_id", F.explode_outer("f").alias("f")).select("event_id", F.col("f.key").alias("name"), F.col("f.value").cast("long").alias("value"))


@query("p04_field_at_cursor", f"WITH {PARAS_SQL} SELECT doc_id, para, strpos(text, ' ') - 1 > 3 AS in_field FROM paras WHERE para = 0")
def field_at_cursor(spark, sf):
    """Whether offset 3 lies in the first word, [start, end)."""
    p = paragraphs(load(spark, sf, "documents")).filter("para = 0")
    end = F.instr("text", " ") - 1
    return p.select("doc_id", "para", ((F.lit(0) <= 3) & (F.lit(3) < end)).alias("in_field"))


@query("p05_guide_values", "SELECT event_id, CASE WHEN value < 50 AND event_type = 'view' THEN NULL ELSE event_type END AS shown FROM events")
def guide_values(spark, sf):
    """A value equal to its guide text counts as a value once it was modified."""
    e = load(spark, sf, "events").select("event_id", F.col("event_type").alias("value"), F.lit("view").alias("guide"), (F.col("value") >= 50).alias("modified"))
    return e.select("event_id", F.when(~F.col("modified") & (F.col("value") == F.col("guide")), None).otherwise(F.col("value")).alias("shown"))


@query(
    "p06_fill_fields",
    """WITH v(name, filled) AS (VALUES ('click', 'K'), ('view', 'V'), ('nosuch', 'N'))
    SELECT event_type AS name, count(*) AS n, any_value(filled) AS filled, false AS not_found FROM events LEFT JOIN v ON name = event_type GROUP BY 1
    UNION ALL SELECT name, 0, filled, true FROM v WHERE name NOT IN (SELECT event_type FROM events)""",
)
def fill_fields(spark, sf):
    """Values by name; names that no field has are reported, not dropped."""
    e = load(spark, sf, "events").groupBy(F.col("event_type").alias("name")).count()
    v = spark.createDataFrame([("click", "K"), ("view", "V"), ("nosuch", "N")], "name string, filled string")
    got = e.join(v, "name", "left").select("name", F.col("count").alias("n"), "filled", F.lit(False).alias("not_found"))
    return got.union(v.join(e, "name", "left_anti").select("name", F.lit(0).cast("long"), "filled", F.lit(True)))


@query(
    "t25_template_schema",
    "SELECT event_type AS block, list_sort(list(DISTINCT k)) AS fields FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY 1",
)
def template_schema(spark, sf):
    e = load(spark, sf, "events").select(F.lit(0).alias("doc_id"), F.col("event_type").alias("block"), F.explode(F.json_object_keys("props")).alias("field"))
    return X.template_schema(e).drop("doc_id")


@query(
    "t26_unique_names",
    """SELECT n_nationkey, n_regionkey, 'field' || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)""",
)
def unique_names(spark, sf):
    n = load(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.lit("field").alias("name"))
    return X.dedup_field_names(n, "n_regionkey", "n_nationkey", "name").drop("name")


@query(
    "t26_document_names",
    """SELECT doc_id, lang, source || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents)""",
)
def document_names(spark, sf):
    """Sources as names that are made unique within a language: few groups, each a large part of all rows."""
    return X.dedup_field_names(load(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "doc_id", "source").drop("source")


@query("p10_form_radio", "SELECT o_custkey, max(o_orderkey) AS chosen, count(*) AS items FROM orders GROUP BY 1")
def form_radio(spark, sf):
    """Radio exclusivity: the last set member of a group is the chosen one."""
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("chosen"), F.count("*").alias("items"))


@query(
    "p10_combo_items",
    "SELECT n_nationkey, 'box' AS control, CAST(i AS INTEGER) AS index, CASE i WHEN 0 THEN n_name ELSE 'item ' || n_regionkey END AS item FROM nation, (VALUES (0), (1)) AS v(i)",
)
def combo_items(spark, sf):
    """Items that a script inserts, in whatever order its calls stand."""
    n = load(spark, sf, "nation")
    script = F.concat(F.lit('function f() { box.InsertString("item '), F.col("n_regionkey").cast("string"), F.lit('", 1); x = 1; box.InsertString("'), F.col("n_name"), F.lit('",0); }'))
    return n.select("n_nationkey", F.explode(forms.combo_items(script)).alias("i")).select("n_nationkey", "i.control", "i.index", "i.item")


@query(
    "p10_set_values",
    """WITH last AS (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS chosen FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
    SELECT o.o_custkey AS custkey, o_orderkey AS name, CASE WHEN o_orderkey % 3 = 2 THEN 'button' ELSE 'radio' END AS kind, 'g' AS "group",
      CASE WHEN o_orderkey % 3 = 2 THEN '7' WHEN chosen IS NULL THEN '1' WHEN o_orderkey = chosen THEN '1' ELSE '0' END AS value
    FROM orders o LEFT JOIN last USING (o_custkey)""",
)
def set_form_values(spark, sf):
    """Of each customer's radio buttons every third is set, in order; push buttons don't take values."""
    o, key = load(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("name")), F.col("name")
    objects = o.select("custkey", "name", F.when(key % 3 == 2, "button").otherwise("radio").alias("kind"), F.lit("g").alias("group"), F.when(key % 3 == 2, "7").otherwise("1").alias("value"))
    sets = o.filter(key % 3 != 1).select("custkey", "name", F.lit("1").alias("value"), key.alias("seq"))
    return forms.set_values(objects, sets, ["custkey"])


_T25 = {
    0: [],  # two bodies
    1: [("", "a", False), ("", "b", False)],
    2: [],  # a block that never ends
    3: [("", "top", False), ("list", "x", True), ("list/inner", "y", True)],
    4: [("list", "x", True)],
}
_T25_MARKS = {
    0: [("body", "b"), ("field", "a"), ("body", "c")],
    1: [("field", "a"), ("field", "b"), ("field", "a")],
    2: [("block", "list"), ("field", "x")],
    3: [("body", "b"), ("field", "top"), ("block", "list"), ("field", "x"), ("block", "inner"), ("field", "y"), ("end", "inner"), ("field", "x"), ("end", "list")],
    4: [("block", "list"), ("field", "x"), ("end", "list")],
}


@query(
    "t25_template_entities",
    "SELECT n_nationkey, path, field, repeated FROM nation JOIN (VALUES " + ", ".join(f"({k}, '{p}', '{f}', {str(r).lower()})" for k, rows in _T25.items() for p, f, r in rows) + ") AS e(k, path, field, repeated) ON n_nationkey % 5 = k",
)
def template_entities(spark, sf):
    """Flat, repeated and nested blocks; documents with errors give nothing."""
    n = load(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("k"))
    m = spark.createDataFrame([(k, i, kind, name) for k, rows in _T25_MARKS.items() for i, (kind, name) in enumerate(rows)], "k int, seq int, kind string, name string")
    return templates.entities(n.join(F.broadcast(m), "k").drop("k"), "n_nationkey", "seq")[0]


@query(
    "s16_html_cells",
    """SELECT page_id, CAST(t AS INTEGER) AS "table", CAST(up AS INTEGER) AS parent, CAST(d AS INTEGER) AS depth, CAST(r AS INTEGER) AS row, CAST(c AS INTEGER) AS col, CAST(rs AS INTEGER) AS row_span, CAST(cs AS INTEGER) AS col_span, CASE text WHEN 'url' THEN url ELSE text END AS text
    FROM pages, (VALUES (0, NULL, 0, 0, 0, 1, 2, 'head'), (0, NULL, 0, 1, 0, 1, 1, 'a & b'), (1, 0, 1, 0, 0, 1, 1, 'url'), (0, NULL, 0, 1, 1, 1, 1, 'outer end')) AS v(t, up, d, r, c, rs, cs, text)""",
)
def html_cells(spark, sf):
    """Cells by a parser: tables in cells are tables of their own, end tags may lack, references are decoded."""
    table = F.concat(F.lit("<TABLE><tr><th colspan='2'>head<tr><td>a &amp; b</td><td>outer <table><tr><td>"), F.col("url"), F.lit("</table>end</table>"))
    return markup.cells(load(spark, sf, "pages").withColumn("html", F.concat("html", table)), "page_id", "html")


@query("p19_empty_names", "SELECT c_custkey, nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, '') AS field_name FROM customer")
def empty_names(spark, sf):
    c = load(spark, sf, "customer").withColumn("name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")))
    return c.select("c_custkey", F.nullif("name", F.lit("")).alias("field_name"))


@query("p20_set_field", "SELECT c_custkey, 'new ' || c_mktsegment AS value, CAST(0 AS INTEGER) AS range_start, CAST(length('new ' || c_mktsegment) AS INTEGER) AS range_end FROM customer")
def set_field(spark, sf):
    """After a set the value is exactly what was set, and the range is measured from it."""
    v = F.concat(F.lit("new "), F.col("c_mktsegment"))
    return load(spark, sf, "customer").select("c_custkey", v.alias("value"), F.lit(0).alias("range_start"), F.length(v).alias("range_end"))
