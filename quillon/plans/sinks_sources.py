"""Source and sink queries."""

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from quillon.operators import structure
from quillon.plans.registry import query
from quillon.shipping import discard_later, shared_dir
from quillon.sources import encoding as E
from quillon.sources import files as S
from quillon.sources import records
from quillon.sources import sinks as K
from quillon.sources.manifests import Manifest
from quillon.sources.tables import PARAS_SQL, load, paragraphs


@query("s01_decode_binary", "SELECT doc_id, length(text)::INTEGER AS n_chars, sha256(text) AS sha FROM documents")
def decode_binary(spark, sf):
    """Texts as UTF-16 bytes with a mark, decoded again."""
    b = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))
    d = load(spark, sf, "documents").select("doc_id", b.alias("content"))
    return d.select("doc_id", F.length(E.decoded(F.col("content"))).alias("n_chars"), F.sha2(E.decoded(F.col("content")), 256).alias("sha"))


@query("s01_format_sniff", "SELECT doc_id, ['hwp5', 'hwpx', 'hwp3', 'hml', 'unknown'][1 + doc_id % 5] AS format FROM documents")
def format_sniff(spark, sf):
    """Files by how they begin."""
    heads = ("D0CF11E0A1B11AE1", "504B0304", "48575020446F63756D656E742046696C652056332E3030", "EFBBBF3C48575050".replace("5050", "504D4C3E"), "255044462D")
    k = F.col("doc_id") % 5
    mark = F.unhex(F.element_at(F.array(*[F.lit(h) for h in heads]), (k + 1).cast("int")))
    return load(spark, sf, "documents").select("doc_id", E.file_format(F.concat(mark, F.encode("text", "UTF-8"))).alias("format"))


@query("s10_metafiles", """SELECT n_nationkey, 'wmf' AS format, CAST(i AS INTEGER) AS ordinal, r AS record, CAST(b AS BIGINT) AS bytes, CASE WHEN n_nationkey % 2 = 1 AND i = 2 THEN 'no end' END AS error
    FROM nation, (VALUES (0, 'SETMAPMODE', 8, 0), (1, 'LINETO', 10, 0), (2, 'EOF', 6, 0), (2, NULL, 0, 1)) AS v(i, r, b, k) WHERE i < 2 OR k = n_nationkey % 2""")
def metafiles(spark, sf):
    """Records of metafiles, with and without their end."""
    header = "010009000003" + "00" * 12
    body = "04000000" + "0301" + "0800" + "05000000" + "1302" + "00000000"
    raw = F.unhex(F.concat(F.lit(header + body), F.when(F.col("n_nationkey") % 2 == 0, "030000000000").otherwise("")))
    return records.metafiles(load(spark, sf, "nation").select("n_nationkey", raw.alias("blob")), "n_nationkey", "blob")


@query("k04_atomic_replace", "SELECT 'nations ' || count(*) AS line FROM nation")
def atomic_replace(spark, sf):
    """A manifest that is replaced all at once, read back."""
    m = Manifest(spark, discard_later(spark, f"{shared_dir(spark)}/quillon-manifest-{uuid.uuid4().hex}"))
    for text in ("old", f"nations {load(spark, sf, 'nation').count()}"):
        m.change(lambda _, text=text: text.encode())
    return spark.createDataFrame([(m.read()[1].decode(),)], "line string")


@query("k04_compare_and_set", "SELECT lang, count(*) AS n, CAST(8 AS BIGINT) AS version FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def compare_and_set(spark, sf):
    """Eight writers at once, each adding the counts of its part of the documents to one manifest; who comes second tries again."""
    m = Manifest(spark, discard_later(spark, f"{shared_dir(spark)}/quillon-manifest-{uuid.uuid4().hex}"))
    parts = load(spark, sf, "documents").filter("lang IS NOT NULL").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(8)).cast("int").alias("p"), "lang").count().collect()  # a count for each part and language

    def add(part: int) -> int:
        own = {r["lang"]: r["count"] for r in parts if r["p"] == part}
        sums = lambda old: {k: old.get(k, 0) + own.get(k, 0) for k in {*old, *own}}
        return m.change(lambda b: json.dumps(sums(json.loads(b or b"{}")), sort_keys=True).encode())

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(add, range(8)))
    version, content = m.read()
    return spark.createDataFrame([(k, n, version) for k, n in json.loads(content).items()], "lang string, n long, version long")


@query("s03_parse_xml", "SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def parse_xml(spark, sf):
    n = load(spark, sf, "nation")
    x = F.concat(F.lit("<HML><N>"), K.xml_text(F.col("n_name")), F.lit("</N><R>"), F.col("n_regionkey").cast("string"), F.lit("</R></HML>"))
    return n.select("n_nationkey", F.xpath_string(x, F.lit("/HML/N")).alias("name"), F.xpath_int(x, F.lit("/HML/R")).alias("region"))


@query("s04_signature_probe", "SELECT page_id, true AS is_html FROM pages")
def signature_probe(spark, sf):
    p = load(spark, sf, "pages").select("page_id", F.regexp_replace("html", "^<!DOCTYPE html>", "").cast("binary").alias("content"))
    return p.select("page_id", E.has_root(F.col("content"), "html").alias("is_html"))


@query("s05_encoding_sniff", "SELECT CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16le' ELSE 'utf-16be' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def encoding_sniff(spark, sf):
    k, t = F.col("doc_id") % 3, F.col("text")
    mark = lambda h, c: F.concat(F.unhex(F.lit(h)), F.encode(t, c))
    d = load(spark, sf, "documents").select(F.when(k == 0, mark("EFBBBF", "UTF-8")).when(k == 1, mark("FFFE", "UTF-16LE")).otherwise(mark("FEFF", "UTF-16BE")).alias("content"))
    return d.groupBy(E.sniff(F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


@query("s06_warnings", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['not-utf-8'] WHEN 1 THEN ['nul'] ELSE ['bad-encoding'] END AS warnings FROM documents")
def warnings(spark, sf):
    k = F.col("doc_id") % 3
    c = F.when(k == 0, F.unhex(F.lit("FFFE4100"))).when(k == 1, F.unhex(F.lit("410042"))).otherwise(F.unhex(F.lit("41FF42")))
    return load(spark, sf, "documents").select("doc_id", E.warnings(c).alias("warnings"))


@query("s07_strict_ingest", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown field extra' WHEN o_orderkey % 7 = 0 THEN 'not a JSON object' END AS error FROM orders")
def strict_ingest(spark, sf):
    k = F.col("o_orderkey")
    j = F.when(k % 5 == 0, '{"title":"a","extra":1}').when(k % 7 == 0, "[1, 2").otherwise('{"title":"a","pages":[]}')
    return load(spark, sf, "orders").select("o_orderkey", S.strict(j, ("title", "pages")).alias("error"))


@query("s08_attachments", "SELECT n_nationkey, CAST(i AS INTEGER) AS item, 'BIN' || upper(printf('%04x', i + 1)) || '.png' AS name FROM (SELECT n_nationkey, unnest(range(n_nationkey % 3)) AS i FROM nation)")
def attachments(spark, sf):
    """Embedded binaries one by one, named by number; a document without any has none."""
    n = load(spark, sf, "nation").withColumn("k", (F.col("n_nationkey") % 3).cast("int"))
    one = n.select("n_nationkey", F.explode(F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array().cast("array<int>"))).alias("item"))
    return one.select("n_nationkey", "item", S.binary_name(F.col("item"), F.lit("png")).alias("name"))


@query("s09_binary_names", "SELECT p_partkey, 'BIN' || upper(printf('%04x', p_partkey + 1)) || '.jpg' AS name FROM part")
def binary_names(spark, sf):
    return load(spark, sf, "part").select("p_partkey", S.binary_name(F.col("p_partkey"), F.lit("jpg")).alias("name"))


@query("s12_stream_cap", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 20000 THEN 'stream of ' || octet_length(encode(text)) || ' bytes is over the limit' END AS error FROM documents")
def stream_cap(spark, sf):
    return load(spark, sf, "documents").select("doc_id", E.oversize(F.octet_length("text"), 20_000).alias("error"))


@query("s13_corpus_listing", "SELECT printf('%05d', row_number() OVER (ORDER BY lower(url), url) - 1) AS docid, url AS rel FROM pages")
def corpus_listing(spark, sf):
    return S.listing(load(spark, sf, "pages").select(F.concat(F.lit("root:"), "url").alias("path")).select(F.substring("path", F.lit(6), F.length("path")).alias("path")), "\x00")


@query("s14_text_tables", "SELECT region, count(*) AS n FROM (SELECT n_regionkey AS region FROM nation) GROUP BY 1")
def text_tables(spark, sf):
    """Tab-separated rows read by a given schema."""
    n = load(spark, sf, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("line"))
    rows = n.select(F.from_csv("line", "key int, name string, region int", {"sep": "\t"}).alias("r"))
    return rows.groupBy(F.col("r.region").alias("region")).agg(F.count("*").alias("n"))


@query("s15_preview", "SELECT page_id, substr(html, 1, 64) AS preview FROM pages")
def preview(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.substring("html", 1, 64).alias("preview"))


@query(
    "s17_preserved_fragments",
    """WITH h AS (SELECT page_id, string_split_regex(html, '<script[^<]*</script>|<!--[^<]*-->') AS gaps, regexp_extract_all(html, '<script[^<]*</script>|<!--[^<]*-->') AS raws FROM pages),
    x AS (SELECT page_id, raws, gaps, unnest(range(len(raws))) AS k FROM h),
    y AS (SELECT page_id, k, raws[k + 1] AS raw, array_to_string(gaps[1:k + 1], '') AS before FROM x)
    SELECT page_id, CAST(k AS INTEGER) AS ord, raw, CASE WHEN contains(before, '<body') THEN 'body' ELSE 'head' END AS parent, CAST(len(regexp_extract_all(before, '<[a-zA-Z]')) AS INTEGER) AS siblings_before FROM y""",
)
def preserved_fragments(spark, sf):
    """Every subtree that the model lacks is kept verbatim, with its parent, its order, and how many elements that
    the model has stand before it."""
    return S.fragments(load(spark, sf, "pages"), "page_id", "html", "<script[^<]*</script>|<!--[^<]*-->")


@query("s18_legacy_strings", "SELECT n_nationkey, n_name || '?' AS text FROM nation")
def legacy_strings(spark, sf):
    """ASCII, then a lone lead byte."""
    n = load(spark, sf, "nation").select("n_nationkey", F.concat(F.encode("n_name", "UTF-8"), F.unhex(F.lit("C5"))).alias("raw"))
    return n.select("n_nationkey", E.legacy_decoded("raw").alias("text"))


@query("k05_json_envelope", """SELECT '{"schemaVersion":"1.0","source":"nation","n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS line FROM nation""")
def json_envelope(spark, sf):
    return K.envelope(load(spark, sf, "nation"), "nation", "n_nationkey", "n_name")


@query("k06_page_texts", f"WITH {PARAS_SQL} SELECT doc_id, page, string_agg(text, chr(10) ORDER BY para) AS text FROM paras GROUP BY ALL")
def page_texts(spark, sf):
    return K.page_texts(paragraphs(load(spark, sf, "documents")))


@query("k07_display_glyphs", "SELECT s_suppkey, replace(s_name || chr(61441), chr(61441), '->') AS shown FROM supplier")
def display_glyphs(spark, sf):
    """Only listed private-use glyphs are replaced, and only in what is shown."""
    shown = F.concat("s_name", F.lit(chr(0xF001)))
    return load(spark, sf, "supplier").select("s_suppkey", F.replace(shown, F.lit(chr(0xF001)), F.lit("->")).alias("shown"))


@query("k08_equation_text", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'eq:' || c_custkey ELSE c_name END AS text FROM customer")
def equation_text(spark, sf):
    c = load(spark, sf, "customer")
    text = F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))
    return c.select("c_custkey", F.coalesce(text, F.concat(F.lit("eq:"), F.col("c_custkey").cast("string"))).alias("text"))


@query("k09_markdown", f"WITH {PARAS_SQL} SELECT doc_id, para, CASE WHEN para = 0 THEN '# ' || text ELSE text END AS markdown FROM paras")
def markdown(spark, sf):
    p = paragraphs(load(spark, sf, "documents"))
    return K.markdown(p, F.when(F.col("para") == 0, 1).otherwise(0)).select("doc_id", "para", "markdown")


@query("k02_loss_report", "SELECT event_type AS kind, count(*) AS lost FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def loss_report(spark, sf):
    return K.lean(load(spark, sf, "events").withColumnRenamed("event_type", "kind"), "event_id", ("click", "view"))[1]


@query("k10_preserve_export", """SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '<' || event_type || '/>' ELSE '<!-- ' || replace(event_type || ' ' || coalesce(props, ''), '--', '- -') || ' -->' END AS xml FROM events""")
def preserve_export(spark, sf):
    """Nothing is dropped: kinds that the target can't hold stand as comments."""
    e = load(spark, sf, "events")
    raw = F.concat_ws(" ", "event_type", F.coalesce("props", F.lit("")))
    return e.select("event_id", K.preserved(F.concat(F.lit("<"), F.col("event_type"), F.lit("/>")), F.col("event_type").isin("click", "view"), raw).alias("xml"))


@query("k10_lean_export", "SELECT event_type AS kind, count(*) AS kept FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def lean_export(spark, sf):
    return K.lean(load(spark, sf, "events").withColumnRenamed("event_type", "kind"), "event_id", ("click", "view"))[0].groupBy("kind").agg(F.count("*").alias("kept"))


@query(
    "k11_span_tokens",
    """WITH c AS (SELECT l_orderkey, l_linenumber, 1 + CAST(l_quantity AS INTEGER) % 2 AS rs, 1 + CAST(l_tax * 100 AS INTEGER) % 3 AS cs FROM lineitem),
    y AS (SELECT l_orderkey, unnest(range(cs)) AS dc, dr FROM (SELECT *, unnest(range(rs)) AS dr FROM c))
    SELECT CASE WHEN dr = 0 AND dc = 0 THEN 'anchor' WHEN dr = 0 THEN 'left' WHEN dc = 0 THEN 'up' ELSE 'cross' END AS token, count(*) AS n FROM y GROUP BY 1""",
)
def span_tokens(spark, sf):
    c = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("row"), F.lit(0).alias("col"), (1 + F.col("l_quantity").cast("int") % 2).alias("row_span"), (1 + (F.col("l_tax") * 100).cast("int") % 3).alias("col_span"), F.col("l_returnflag").alias("text"))
    return structure.expand_spans(c, ("l_orderkey",)).groupBy("token").agg(F.count("*").alias("n"))


@query("k12_location_boxes", "SELECT p_partkey, [least(511, p_size * 512 // 60), least(511, p_size * 512 // 120), least(511, (p_size + 10) * 512 // 60), least(511, (p_size + 5) * 512 // 120)]::INTEGER[] AS box FROM part")
def location_boxes(spark, sf):
    s = F.col("p_size")
    return load(spark, sf, "part").select("p_partkey", K.grid_box(s, s, F.lit(10), F.lit(5), F.lit(60), F.lit(120)).alias("box"))


@query("k14_page_range", f"WITH {PARAS_SQL} SELECT doc_id, para, page + 1 AS page, text FROM paras WHERE page + 1 BETWEEN 2 AND 3")
def page_range(spark, sf):
    """Pages 2 to 3, counted from 1 here and only here."""
    return paragraphs(load(spark, sf, "documents")).withColumn("page", F.col("page") + 1).filter("page BETWEEN 2 AND 3").select("doc_id", "para", "page", "text")


@query("k15_csv_round_trip", "SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) AS DOUBLE) AS qty, count(*) AS n FROM lineitem GROUP BY ALL")
def csv_round_trip(spark, sf):
    """A grid out to CSV lines and back in."""
    g = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    back = K.csv_grid(K.grid_csv(g, "l_orderkey", "l_linenumber", ("l_quantity", "l_returnflag")), "l_orderkey", "l_linenumber", "q double, f string")
    return back.groupBy("l_orderkey", "l_linenumber").agg(F.sum("q").alias("qty"), F.count("f").alias("n"))


@query("k17_xml_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def xml_escape(spark, sf):
    return load(spark, sf, "pages").select("page_id", K.xml_text(F.col("html")).alias("escaped"))


@query("k18_stable_order", "SELECT sha256(string_agg(n_name, '|' ORDER BY n_name)) AS digest FROM nation")
def stable_order(spark, sf):
    """A digest over sorted entries, without a clock."""
    return load(spark, sf, "nation").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), "|"), 256).alias("digest"))
