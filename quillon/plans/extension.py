"""The engine about itself, binary records, charts, round trips, and functions for SQL users."""

from pyspark.sql import functions as F

from quillon.functions import tables
from quillon.operators import diff, security
from quillon.operators.alignment import align
from quillon.plans.registry import ORACLES, QUERIES, query
from quillon.sources import records, sinks
from quillon.sources.tables import PARAS_SQL, load, paragraphs


@query("p14_capabilities")
def capabilities(spark, sf):
    """No SQL: the registry as data, one row for each query, with whether SQL checks it."""
    rows = [(n, (f.__doc__ or "").strip().split("\n")[0], n in ORACLES, True) for n, f in sorted(QUERIES.items())]
    return spark.createDataFrame(rows, "name string, summary string, has_sql boolean, available boolean")


@query(
    "e01_unknown_command",
    """WITH n AS (SELECT DISTINCT c_mktsegment AS name FROM customer), a AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN substr(c_mktsegment, 1, 1) || substr(c_mktsegment, 3) WHEN 1 THEN c_mktsegment || 'ZZ' ELSE 'nothing like it at all' END AS asked FROM customer)
    SELECT c_custkey, asked, arg_min(name, (levenshtein(asked, name), name)) AS suggestion FROM a LEFT JOIN n ON levenshtein(asked, name) <= 3 GROUP BY c_custkey, asked""",
)
def unknown_command(spark, sf):
    """The nearest of the known names, the market segments, within three edits of what each customer asks for, or none."""
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    names, k, s = c.select(F.col("c_mktsegment").alias("name")).distinct(), F.col("c_custkey") % 3, F.col("c_mktsegment")
    asked = c.select("c_custkey", F.when(k == 0, F.concat(F.substring(s, 1, 1), F.expr("substring(c_mktsegment, 3)"))).when(k == 1, F.concat(s, F.lit("ZZ"))).otherwise("nothing like it at all").alias("asked"))
    near = asked.join(F.broadcast(names), F.levenshtein("asked", "name") <= 3, "left")
    return near.groupBy("c_custkey", "asked").agg(F.min(F.struct(F.levenshtein("asked", "name").alias("d"), "name")).alias("b")).select("c_custkey", "asked", F.col("b.name").alias("suggestion"))


@query("e02_table_function", "SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def table_function(spark, sf):
    """A table function that SQL users call; what it does is a built-in, so it stays in the JVM."""
    load(spark, sf, "nation").createOrReplaceTempView("quillon_nation")
    return spark.sql("SELECT n_nationkey, word FROM quillon_nation, LATERAL explode(split(n_name, ' ')) AS t(word)")


@query("e02_search_function", f"WITH {PARAS_SQL}, h AS (SELECT doc_id, para, text, unnest(range(1, length(text) - 1)) AS i FROM paras) SELECT doc_id, para, CAST(i - 1 AS INTEGER) AS char FROM h WHERE substr(text, i, 3) = 'the'")
def search_function(spark, sf):
    """A search that SQL users call on a table."""
    tables.register(spark)
    load(spark, sf, "documents").select("doc_id", "text").createOrReplaceTempView("quillon_documents")
    return spark.sql("SELECT doc_id, para, char FROM quillon_search(TABLE(quillon_documents), 'the')")


@query("e02_extract_function", f"WITH {PARAS_SQL} SELECT doc_id, lang, para, unnest(regexp_extract_all(p.text, '[0-9]+')) AS match FROM paras p JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)")
def extract_function(spark, sf):
    """Numbers by a table function, with the other columns of the table."""
    tables.register(spark)
    load(spark, sf, "documents").select("doc_id", "lang", "text").createOrReplaceTempView("quillon_documents")
    return spark.sql("SELECT doc_id, lang, para, match FROM quillon_extract(TABLE(quillon_documents), '[0-9]+')")


@query("e02_partitioned_function", "SELECT conv_id, turn, CAST(row_number() OVER w - 1 AS INTEGER) AS place, CAST(coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def partitioned_function(spark, sf):
    """A table function with state, over the turns of each conversation in order."""
    tables.register(spark)
    load(spark, sf, "conversations").select("conv_id", "turn", "text").createOrReplaceTempView("quillon_conversations")
    return spark.sql("SELECT conv_id, turn, place, before FROM quillon_numbered(TABLE(quillon_conversations) PARTITION BY conv_id ORDER BY turn)")


@query("e03_configured_filter", "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND length(text) >= 500")
def configured_filter(spark, sf):
    """Filters from a configuration as plain data."""
    conf = {"lang": ["de", "fr"], "min_chars": 500}
    return load(spark, sf, "documents").filter(F.col("lang").isin(conf["lang"]) & (F.length("text") >= conf["min_chars"])).select("doc_id")


@query("e06_cell_getter", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS value FROM lineitem")
def cell_getter(spark, sf):
    """What a cell getter would fetch is a column."""
    from quillon.operators.formula import evaluate

    g = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return evaluate(g, "=A?*2", "l_orderkey", "l_linenumber", {"A": "l_quantity"}, "B", "value").drop("l_quantity")


@query("s10_binary_records", "SELECT n_nationkey, CAST(i AS INTEGER) AS ordinal, i + 1 AS type, 8 + i * 2 AS size, NULL::VARCHAR AS error FROM (SELECT n_nationkey, unnest(range(n_nationkey % 4)) AS i FROM nation)")
def binary_records(spark, sf):
    n = load(spark, sf, "nation").withColumn("k", (F.col("n_nationkey") % 4).cast("int"))
    one = lambda i: F.concat(F.unhex(F.lit(f"{i + 1:02X}000000{8 + 2 * i:02X}000000")), F.unhex(F.lit("0000" * i)))
    blob = F.concat(*[F.when(F.col("k") > i, one(i)).otherwise(F.lit(b"")) for i in range(3)])
    return records.decode(n.select("n_nationkey", blob.alias("blob")), "n_nationkey", "blob")


@query("s11_chart_json", """SELECT strftime(ts, '%Y-%m-%d') AS category, '{"schema":"chart","version":1,"clicks":' || count(*) FILTER (event_type = 'click') || ',"views":' || count(*) FILTER (event_type = 'view') || '}' AS ir FROM events GROUP BY 1""")
def chart_json(spark, sf):
    e = load(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("category")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views"))
    return e.select("category", F.to_json(F.struct(F.lit("chart").alias("schema"), F.lit(1).alias("version"), "clicks", "views")).alias("ir"))


@query("k01_serialize", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def serialize(spark, sf):
    """Rows to bytes and back."""
    n = load(spark, sf, "nation")
    raw = n.select(F.to_json(F.struct("*")).cast("binary").alias("content"))
    return raw.select(F.from_json(F.col("content").cast("string"), n.schema).alias("r")).select("r.*")


@query("k03_typed_errors", "SELECT doc_id, CASE WHEN length(text) > 8000 THEN 'TooLarge' WHEN contains(text, '|') THEN 'Unsupported' END AS error FROM documents")
def typed_errors(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 8000, "TooLarge").when(F.col("text").contains("|"), "Unsupported").alias("error"))


@query("k16_clipboard_html", "SELECT n_nationkey, '<table><tr><td>' || replace(replace(replace(n_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td>' || n_regionkey || '</td></tr></table>' AS html FROM nation")
def clipboard_html(spark, sf):
    n = load(spark, sf, "nation")
    cell = lambda c: F.concat(F.lit("<td>"), sinks.xml_text(c), F.lit("</td>"))
    return n.select("n_nationkey", F.concat(F.lit("<table><tr>"), cell(F.col("n_name")), cell(F.col("n_regionkey").cast("string")), F.lit("</tr></table>")).alias("html"))


@query("w08_wrapping_cursor", "SELECT c_nationkey, coalesce(min(c_custkey) FILTER (c_custkey > 700), min(c_custkey)) AS next_key FROM customer GROUP BY 1")
def wrapping_cursor(spark, sf):
    """The next key after a cursor, around the end if there is none."""
    k = F.col("c_custkey")
    return load(spark, sf, "customer").groupBy("c_nationkey").agg(F.min(F.struct((k <= 700).alias("wrapped"), k.alias("k")))["k"].alias("next_key"))


@query(
    "d04_alignment_noise",
    f"""WITH {PARAS_SQL}, a AS (SELECT doc_id, para, text FROM paras), b AS (SELECT doc_id, para - 1 AS para, text FROM paras WHERE para > 0)
    SELECT (SELECT count(*) FROM a FULL JOIN b USING (doc_id, para) WHERE a.text IS DISTINCT FROM b.text) AS by_place, (SELECT count(DISTINCT doc_id) FROM paras) AS by_alignment""",
)
def alignment_noise(spark, sf):
    """Rows that differ by position, and by alignment, when each text loses its first line: by alignment, that line alone."""
    # lines are only compared, so their digests are shuffled
    p = paragraphs(load(spark, sf, "documents")).select("doc_id", F.col("para").cast("long").alias("para"), F.base64(F.unhex(F.sha2("text", 256))).alias("text"))
    after = p.filter("para > 0").withColumn("para", F.col("para") - 1)
    by_place = diff.field_diff(p, after, ["doc_id", "para"], ["text"]).agg(F.count("*").alias("by_place"))
    aligned = align(p, after, "doc_id", "para", "text").filter("kind <> 'same'").agg(F.count("*").alias("by_alignment"))
    return by_place.crossJoin(F.broadcast(aligned))


def register_functions(spark) -> None:
    """Functions for SQL users: quillon_occurrences(text, literal) and quillon_deceptive(text)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION quillon_occurrences(t STRING, q STRING) RETURNS BIGINT RETURN CAST((length(lower(t)) - length(replace(lower(t), lower(q), ''))) / length(q) AS BIGINT)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quillon_deceptive(t STRING) RETURNS BOOLEAN RETURN coalesce(t, '') RLIKE '{security.DECEPTIVE}'")


@query("e05_sql_functions", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT) AS n FROM documents")
def sql_functions(spark, sf):
    register_functions(spark)
    load(spark, sf, "documents").createOrReplaceTempView("quillon_documents")
    return spark.sql("SELECT doc_id, quillon_occurrences(text, 'THE') AS n FROM quillon_documents")

