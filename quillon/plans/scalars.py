"""Scalar function queries."""

import pandas as pd
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import edits
from quillon.plans.registry import query
from quillon.sources.tables import PARAS_SQL, load, paragraphs


@query("x01_sha256", "SELECT doc_id, sha256(text) AS sha FROM documents")
def sha256(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("x02_commitment", "SELECT c_custkey, sha256(c_name || lower(printf('%08x', c_custkey))) AS c FROM customer")
def commitment(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", S.commitment(F.col("c_name"), F.format_string("%08x", "c_custkey")).alias("c"))


@query(
    "x03_redact_json",
    """SELECT o_orderkey, '{"planVersion":"1","action":"ship","what":{"o_orderstatus":"' || sha256(o_orderstatus || substr(sha256('s/what/o_orderstatus'), 1, 32)) || '","o_orderpriority":"' || sha256(o_orderpriority || substr(sha256('s/what/o_orderpriority'), 1, 32)) || '"}}' AS redacted, CAST(2 AS BIGINT) AS n_leaves FROM orders""",
)
def redact_json(spark, sf):
    """Every string leaf of a plan becomes a commitment, by a recursive walk; SQL can say it as this plan's shape is fixed."""

    @F.pandas_udf("struct<redacted string, leaves array<struct<pointer string, value string, salt string>>>")
    def redact(plan: pd.Series) -> pd.DataFrame:
        rows = [S.redact_json(p, "s") for p in plan]
        return pd.DataFrame({"redacted": [r[0] for r in rows], "leaves": [[dict(zip(("pointer", "value", "salt"), x)) for x in r[1]] for r in rows]})

    o = load(spark, sf, "orders")
    plan = F.to_json(F.struct(F.lit("1").alias("planVersion"), F.lit("ship").alias("action"), F.struct("o_orderstatus", "o_orderpriority").alias("what")))
    return o.select("o_orderkey", redact(plan).alias("r")).select("o_orderkey", "r.redacted", F.size("r.leaves").cast("long").alias("n_leaves"))


@query("x04_json_pointer", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_pointer(spark, sf):
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("x05_validate", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'policy missing' WHEN o_orderkey % 17 = 0 THEN 'id empty' ELSE 'ok' END AS verdict FROM orders")
def validate(spark, sf):
    """Work orders: kind, a non-empty id and a policy are required."""
    o = load(spark, sf, "orders")
    j = F.to_json(F.struct(F.lit("workorder").alias("kind"), F.when(F.col("o_orderkey") % 17 == 0, "").otherwise(F.col("o_orderkey").cast("string")).alias("workorderId"), F.when(F.col("o_orderstatus") != "P", F.lit("strict")).alias("acceptancePolicy")))
    p = o.select("o_orderkey", F.from_json(j, "kind string, workorderId string, acceptancePolicy string").alias("w"))
    w = F.col("w")
    return p.select("o_orderkey", F.when(~F.coalesce(w["kind"], F.lit("")).eqNullSafe("workorder"), "kind wrong").when(w["acceptancePolicy"].isNull(), "policy missing").when(F.coalesce(w["workorderId"], F.lit("")) == "", "id empty").otherwise("ok").alias("verdict"))


@query("x06_json_lines", """SELECT o_orderkey, '{"seq":' || o_orderkey || ',"kind":"order","status":"' || o_orderstatus || '"}' AS line FROM orders""")
def json_lines(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("seq"), F.lit("order").alias("kind"), F.col("o_orderstatus").alias("status"))).alias("line"))


@query(
    "x07_compare_classes",
    """WITH p AS (SELECT doc_id, text AS a, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text || '\u2007' WHEN 2 THEN substr(text, 1, length(text) - 3) WHEN 3 THEN text || 'x' END AS b FROM documents),
    q AS (SELECT *, regexp_replace(a, '[ \t\r\n\u2007]+', '', 'g') AS sa, regexp_replace(b, '[ \t\r\n\u2007]+', '', 'g') AS sb FROM p)
    SELECT doc_id, CASE WHEN b IS NULL THEN 'missing' WHEN a = b THEN 'same' WHEN replace(a, '\u2007', ' ') = replace(b, '\u2007', ' ') THEN 'figure-space-only' WHEN sa = sb THEN 'whitespace-only' WHEN length(sb) < length(sa) THEN 'content-loss' ELSE 'content-diff' END AS class FROM q""",
)
def compare_classes(spark, sf):
    k, t = F.col("doc_id") % 5, F.col("text")
    b = F.when(k == 0, t).when(k == 1, F.concat(t, F.lit("\u2007"))).when(k == 2, F.substring(t, F.lit(1), F.length(t) - 3)).when(k == 3, F.concat(t, F.lit("x")))
    return load(spark, sf, "documents").select("doc_id", S.compare_class(t, b).alias("class"))


@query("x08_normal_lines", "SELECT doc_id, sha256(rtrim(regexp_replace(replace(text || ' ', chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'))) AS sha FROM documents")
def normal_lines(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2(S.normal_lines(F.concat("text", F.lit(" "))), 256).alias("sha"))


@query("x09_match_keys", f"WITH {PARAS_SQL} SELECT doc_id, para, substr(replace(regexp_replace(text, '[\ue000-\uf8ff]', '', 'g'), ' ', ''), 1, 24) AS key FROM paras")
def match_keys(spark, sf):
    return paragraphs(load(spark, sf, "documents")).select("doc_id", "para", S.match_key(F.col("text")).alias("key"))


@query("x10_case_insensitive", "SELECT count(*) AS n FROM documents WHERE contains(lower(text), lower('THE OF'))")
def case_insensitive(spark, sf):
    return load(spark, sf, "documents").filter(F.lower("text").contains("the of")).agg(F.count("*").alias("n"))


@query("x11_int_capture", "SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url, '/([0-9]+)([?]|$)', 1), '') AS INTEGER), -1) AS number FROM pages")
def int_capture(spark, sf):
    return load(spark, sf, "pages").select("page_id", S.int_or(F.col("url"), "/([0-9]+)([?]|$)").alias("number"))


@query("x12_basename", "SELECT page_id, string_split(replace(url, '\\', '/'), '/')[-1] AS base FROM pages")
def basename(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.substring_index(F.replace("url", F.lit("\\"), F.lit("/")), "/", -1).alias("base"))


@query("x13_units", "SELECT p_partkey, p_size * 7200 AS units, CAST(round(p_size * 25.4, 4) AS DOUBLE) AS mm FROM part")
def units(spark, sf):
    return load(spark, sf, "part").select("p_partkey", (F.col("p_size") * 7200).alias("units"), F.round(F.col("p_size") * 25.4, 4).alias("mm"))


@query("x14_rects", "SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber - l_linenumber AS width, l_quantity * 2 - l_quantity AS height FROM lineitem")
def rects(spark, sf):
    l, r = F.col("l_linenumber"), F.col("l_quantity") + F.col("l_linenumber")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (r - l).alias("width"), (F.col("l_quantity") * 2 - F.col("l_quantity")).alias("height"))


@query("x15_entropy", "WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT p_partkey, ch, count(*) AS k FROM c GROUP BY ALL), t AS (SELECT p_partkey, sum(k) AS n FROM n GROUP BY 1) SELECT p_partkey, round(-sum(k / n * log2(k / n)), 6) AS bits FROM n JOIN t USING (p_partkey) GROUP BY 1")
def entropy(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.round(S.entropy(F.col("p_name")), 6).alias("bits"))


@query("x16_char_diff", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS d FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND levenshtein(a.n_name, b.n_name) <= 6")
def char_diff(spark, sf):
    n = load(spark, sf, "nation")
    a, b = (n.select("n_regionkey", F.col("n_nationkey").alias(f"k{x}"), F.col("n_name").alias(x)) for x in "ab")
    d = F.levenshtein("a", "b", 6)
    return a.join(b, "n_regionkey").filter("ka < kb").select("a", "b", d.alias("d")).filter("d >= 0")


@query(
    "x17_entities",
    "SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') || ' éé😀<&lt;&unknown;&#0;&' AS decoded FROM pages",
)
def entities(spark, sf):
    """Whole pages with their character references decoded, and some more at the end of each."""
    p = load(spark, sf, "pages").select("page_id", F.concat("html", F.lit(" &#233;&#xE9;&#x1F600;&lt;&amp;lt;&unknown;&#0;&")).alias("html"))
    return p.select("page_id", S.decode_entities(F.col("html")).alias("decoded"))


#: DuckDB's distance counts bytes, so for it letters of two bytes become bytes that no text holds.
_WIDE = "ñéÊÖÈÄÇÜßêíÑüèÓöçÍÉäóáúàâùûîïôëÁÚÀÂ"
_BYTES = "".join(chr(i) for i in (*range(1, 9), *range(14, 32))) + "~`^|{}\\_<"


@query(
    "x16_edit_script",
    f"""WITH t AS (SELECT conv_id, turn, text AS a, substr(text, 1, length(text) // 3) || '!' || substr(text, length(text) // 3 + 1, length(text) // 3) || substr(text, 2 * (length(text) // 3) + 2) AS b FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, CAST(levenshtein(translate(a, '{_WIDE}', '{_BYTES}'), translate(b, '{_WIDE}', '{_BYTES}')) AS BIGINT) AS edits, sha256(b) AS sha, true AS exact FROM t""",
)
def edit_script(spark, sf):
    """Every turn against a version with a character more and one less: the fewest edits, and what applying them gives."""
    third = F.floor(F.length("text") / 3).cast("int")
    after = F.concat(F.substr("text", F.lit(1), third), F.lit("!"), F.substr("text", third + 1, third), F.substr("text", 2 * third + 2))
    c = load(spark, sf, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", "text", after.alias("after"))
    got = edits.edit_scripts(c, "text", "after")
    return got.select("conv_id", "turn", "edits", F.sha2(edits.applied(F.col("text"), F.col("ops")), 256).alias("sha"), "exact")


@query("x17_decode", "SELECT n_nationkey, n_name AS decoded FROM nation")
def decode(spark, sf):
    n = load(spark, sf, "nation")
    return n.select("n_nationkey", F.decode(F.encode("n_name", "UTF-16LE"), "UTF-16LE").alias("decoded"))


@query("x18_progress", "SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 0.0 ELSE round(o_orderkey * 100.0 / 15000, 2) END::DOUBLE AS pct FROM orders")
def progress(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.round(F.coalesce(F.try_divide(F.col("o_orderkey") * 100.0, F.lit(15000.0)), F.lit(0.0)), 2).alias("pct"))


@query("x19_severity", "SELECT o_orderkey, o_shippriority FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 5 END * 1000 + CASE WHEN o_orderstatus = 'O' THEN o_custkey % 100 ELSE 0 END AS o_shippriority FROM orders)")
def severity(spark, sf):
    """Severities order by tier, then by the number that counts for one tier only; an unknown tier is 5."""
    tier = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(5)
    n = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey") % 100).otherwise(0)
    return load(spark, sf, "orders").select("o_orderkey", (tier * 1000 + n).alias("o_shippriority"))


_LOG = "o_orderstatus || ' diff=' || (o_orderkey % 9) || ' ' || (o_orderkey * 3) || 'ms ' || o_orderpriority"


@query("x20_log_lines", f"SELECT regexp_extract(line, '^([FO]) diff=([0-9]+) ([0-9]+)ms (.*)$', 1) AS status, CAST(regexp_extract(line, '^([FO]) diff=([0-9]+) ([0-9]+)ms (.*)$', 2) AS INTEGER) AS diff, count(*) AS n FROM (SELECT {_LOG} AS line FROM orders) WHERE regexp_matches(line, '^([FO]) diff=([0-9]+) ([0-9]+)ms (.*)$') GROUP BY ALL")
def log_lines(spark, sf):
    """Lines that don't fit the format are dropped, here those of status P."""
    p = "^([FO]) diff=([0-9]+) ([0-9]+)ms (.*)$"
    line = F.concat(F.col("o_orderstatus"), F.lit(" diff="), (F.col("o_orderkey") % 9).cast("string"), F.lit(" "), (F.col("o_orderkey") * 3).cast("string"), F.lit("ms "), F.col("o_orderpriority"))
    l = load(spark, sf, "orders").select(line.alias("line")).filter(F.col("line").rlike(p))  # noqa: E741
    return l.groupBy(F.regexp_extract("line", p, 1).alias("status"), F.regexp_extract("line", p, 2).cast("int").alias("diff")).agg(F.count("*").alias("n"))


@query("x21_key_values", "SELECT event_id, k AS k, 'view=' || k AS raw FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view')")
def key_values(spark, sf):
    e = load(spark, sf, "events").filter("event_type = 'view'")
    raw = F.concat(F.lit("view="), F.get_json_object("props", "$.k"))
    return e.select("event_id", F.str_to_map(raw, F.lit(" "), F.lit("="))["view"].alias("k"), raw.alias("raw"))


