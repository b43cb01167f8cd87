"""Search, cursor and edit queries over documents."""

from pyspark.sql import functions as F

from quillon.operators import search as S
from quillon.plans.registry import query
from quillon.sources.tables import PARAS_SQL, load, page_index, paragraphs

WORD = "the"
_N = "CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS BIGINT)"


@query(
    "t01_grep",
    f"""WITH {PARAS_SQL}, p AS (SELECT *, string_split(lower(text), 'tion') AS l FROM paras WHERE contains(lower(text), 'tion'))
    SELECT doc_id, section, para, page, CAST(list_sum(list_transform(l[:k], lambda x: length(x))) + 4 * (k - 1) AS INTEGER) AS char_offset
    FROM (SELECT *, unnest(range(1, len(l))) AS k FROM p)""",
)
def grep(spark, sf):
    return S.grep(paragraphs(load(spark, sf, "documents")), "tion")


@query(
    "t02_match_pages",
    f"""WITH {PARAS_SQL} SELECT doc_id, page, sum({_N})::BIGINT AS n FROM paras WHERE contains(lower(text), 'the') GROUP BY ALL""",
)
def match_pages(spark, sf):
    paras = paragraphs(load(spark, sf, "documents"))
    hits = paras.filter(F.lower("text").contains(WORD)).groupBy("doc_id", "page").agg(F.sum(S.occurrences("text", WORD)).alias("n"))
    return hits


@query(
    "t03_search_truncation",
    f"""WITH n AS (SELECT doc_id, coalesce({_N}, 0) AS total FROM documents)
    SELECT doc_id, least(total, 20) AS match_count, total AS total_match_count, total > 20 AS truncated FROM n""",
)
def search_truncation(spark, sf):
    docs = load(spark, sf, "documents")
    return S.search(docs, paragraphs(docs), WORD, 20)


@query(
    "t04_zero_matches",
    "SELECT doc_id, 0::BIGINT AS match_count, 0::BIGINT AS total_match_count, false AS truncated FROM documents WHERE NOT contains(text, 'zzzz')",
)
def zero_matches(spark, sf):
    docs = load(spark, sf, "documents")
    return S.search(docs, paragraphs(docs), "zzzz", 20, ignore_case=False).filter("total_match_count = 0")


@query(
    "t05_batch_search",
    """WITH n AS (SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS total FROM documents)
    SELECT doc_id, least(total, 1000) AS match_count, total AS total_match_count, total > 1000 AS truncated FROM n""",
)
def batch_search(spark, sf):
    docs = load(spark, sf, "documents")
    return S.search(docs, paragraphs(docs), WORD, 1000, ignore_case=False)


_HITS = f"""{PARAS_SQL}, p AS (SELECT *, string_split(lower(text), 'ing') AS l FROM paras WHERE contains(lower(text), 'ing')),
    m AS (SELECT doc_id, para, CAST(list_sum(list_transform(l[:k], lambda x: length(x))) + 3 * (k - 1) AS INTEGER) AS char_offset FROM (SELECT *, unnest(range(1, len(l))) AS k FROM p)),
    c AS (SELECT doc_id, CAST(doc_id % 7 AS INTEGER) AS c_para, 5 AS c_off FROM documents)"""


@query(
    "t06_next_match",
    f"""WITH {_HITS}, r AS (SELECT m.*, (para, char_offset) <= (c_para, c_off) AS wrapped FROM m JOIN c USING (doc_id))
    SELECT doc_id, para, char_offset, wrapped FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY wrapped, para, char_offset) AS k FROM r) WHERE k = 1""",
)
def next_match(spark, sf):
    docs = load(spark, sf, "documents")
    cursors = docs.select("doc_id", (F.col("doc_id") % 7).cast("int").alias("c_para"), F.lit(5).alias("c_off"))
    return S.cursor(S.grep(paragraphs(docs), "ing"), cursors)


@query(
    "t06_previous_match",
    f"""WITH {_HITS}, r AS (SELECT m.*, (para, char_offset) >= (c_para, c_off) AS wrapped FROM m JOIN c USING (doc_id))
    SELECT doc_id, para, char_offset, wrapped FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY wrapped, para DESC, char_offset DESC) AS k FROM r) WHERE k = 1""",
)
def previous_match(spark, sf):
    docs = load(spark, sf, "documents")
    cursors = docs.select("doc_id", (F.col("doc_id") % 7).cast("int").alias("c_para"), F.lit(5).alias("c_off"))
    return S.cursor(S.grep(paragraphs(docs), "ing"), cursors, forward=False)


@query("t07_first_positions", f"WITH {PARAS_SQL} SELECT doc_id, page, min(para) AS first_para, count(*) AS n_paras FROM paras GROUP BY ALL")
def first_positions(spark, sf):
    return paragraphs(load(spark, sf, "documents")).groupBy("doc_id", "page").agg(F.min("para").alias("first_para"), F.count("*").alias("n_paras"))


@query(
    "t23_changed_pages",
    f"""WITH {PARAS_SQL}, t AS (SELECT doc_id, unnest([0, CAST(doc_id % 30 AS INTEGER), 25]) AS para FROM documents),
    h AS (SELECT t.doc_id, p.page FROM t LEFT JOIN paras p ON p.doc_id = t.doc_id AND p.para = t.para)
    SELECT doc_id, CASE WHEN count(*) = count(page) THEN list_sort(list(DISTINCT page)) END AS pages FROM h GROUP BY doc_id""",
)
def changed_pages(spark, sf):
    docs = load(spark, sf, "documents")
    targets = docs.select("doc_id", F.lit(0).alias("section"), F.explode(F.array(F.lit(0), (F.col("doc_id") % 30).cast("int"), F.lit(25))).alias("para"))
    return S.changed_pages(targets, page_index(paragraphs(docs)))


@query(
    "p01_info",
    f"""WITH {PARAS_SQL} SELECT d.doc_id, any_value(d.lang) AS lang, any_value(length(d.text)) AS size_chars, count(DISTINCT section) AS sections, max(page) + 1 AS page_count, count(*) AS para_count
    FROM documents d JOIN paras p USING (doc_id) GROUP BY d.doc_id""",
)
def info(spark, sf):
    docs = load(spark, sf, "documents")
    per = paragraphs(docs).groupBy("doc_id").agg(F.countDistinct("section").alias("sections"), (F.max("page") + 1).alias("page_count"), F.count("*").alias("para_count"))
    return docs.select("doc_id", "lang", F.length("text").cast("long").alias("size_chars")).join(per, "doc_id")


@query(
    "p02_title",
    f"""WITH {PARAS_SQL}, f AS (SELECT doc_id, arg_min(trim(text), para) AS title FROM paras WHERE page < 3 AND trim(text) <> '' GROUP BY doc_id)
    SELECT d.doc_id, title FROM documents d LEFT JOIN f USING (doc_id)""",
)
def title(spark, sf):
    docs = load(spark, sf, "documents")
    lines = paragraphs(docs).filter("page < 3 AND trim(text) <> ''")
    first = lines.groupBy("doc_id").agg(F.min_by(F.trim("text"), "para").alias("title"))
    return docs.select("doc_id").join(first, "doc_id", "left")


@query(
    "p07_replace_dry_run",
    """WITH n AS (SELECT doc_id, CAST((length(text) - length(replace(text, 'of', ''))) / 2 AS BIGINT) AS n_replaced, sha256(replace(text, 'of', 'OFF')) AS after_sha FROM documents)
    SELECT * FROM n WHERE n_replaced > 0""",
)
def replace_dry_run(spark, sf):
    return S.replace_text(load(spark, sf, "documents"), "of", "OFF").select("doc_id", "n_replaced", F.sha2("text_after", 256).alias("after_sha"))


@query(
    "p08_replace_all_offsets",
    """SELECT doc_id, length(replace(text, 'ing', '')) AS chars_left FROM documents WHERE contains(text, 'ing')""",
)
def replace_all(spark, sf):
    return S.replace_text(load(spark, sf, "documents"), "ing", "").select("doc_id", F.length("text_after").cast("long").alias("chars_left"))


@query(
    "t27_chunk_plan",
    """SELECT doc_id, CAST(i AS INTEGER) AS chunk, CAST(i * 900 AS INTEGER) AS start_char, CAST(least(i * 900 + 1000, length(text)) AS INTEGER) AS end_char, sha256(substring(text, i * 900 + 1, 1000)) AS fingerprint
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 100) / 900) AS BIGINT)))) AS i FROM documents)""",
)
def chunk_plan(spark, sf):
    """Chunks of 1,000 characters that overlap by 100, with fingerprints."""
    docs = load(spark, sf, "documents")
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - 100) / 900)).cast("int")
    c = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    start = F.col("chunk") * 900
    return c.select("doc_id", "chunk", start.alias("start_char"), F.least(start + 1000, F.length("text")).alias("end_char"), F.sha2(F.substring(F.col("text"), start + 1, F.lit(1000)), 256).alias("fingerprint"))
