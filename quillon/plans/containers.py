"""Queries over containers that are built from whole texts."""

from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.shipping import cut_lineage
from quillon.sources import containers as C
from quillon.sources.tables import PAGE, PARAS_SQL, load


def _contained(spark, sf):
    return C.packed(load(spark, sf, "documents"), "doc_id", "text", "doc_id % 2 = 1")


@query(
    "s01_containers",
    f"""WITH {PARAS_SQL}, e AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'compound' ELSE 'zip' END AS format FROM documents)
    SELECT doc_id, format, CAST(2 * para + 1 AS INTEGER) AS ordinal, CAST(2 * para AS INTEGER) AS parent, text FROM paras JOIN e USING (doc_id)""",
)
def containers(spark, sf):
    """Every text as a compound file or an archive, opened again: its entries, the record tree of its body, and the lines."""
    body = C.entries(_contained(spark, sf), "doc_id", "content").filter(F.col("entry") == C.BODY)
    keyed = body.select(F.struct("doc_id", "format").alias("k"), "content")
    rows = C.record_trees(keyed, "k", "content", compressed=True).filter(F.col("tag") == C.PARA_TEXT)
    return rows.select("k.doc_id", "k.format", "ordinal", "parent", F.decode("payload", "UTF-16LE").alias("text"))


@query(
    "s01_damaged_containers",
    """SELECT doc_id, doc_id % 6 AS damage, CASE doc_id % 6 WHEN 0 THEN 'zip' WHEN 1 THEN 'compound' WHEN 2 THEN 'zip' WHEN 3 THEN 'unknown' WHEN 4 THEN 'zip' ELSE 'compound' END AS format,
      CASE doc_id % 6 WHEN 2 THEN 'no_directory' WHEN 3 THEN 'unknown_format' WHEN 4 THEN 'bad_checksum' WHEN 5 THEN 'bad_header' END AS error, CAST(CASE WHEN doc_id % 6 < 2 THEN 3 WHEN doc_id % 6 = 4 THEN 2 ELSE 0 END AS BIGINT) AS whole
    FROM documents""",
)
def damaged_containers(spark, sf):
    """Containers with their end cut off, their signature lost, a checksum or a header changed: typed errors, and the entries
    that are whole stay."""
    c, k, n = F.col("content"), F.col("doc_id") % 6, F.length("content")
    piece = lambda a, m=None: F.substr(c, F.lit(a) if isinstance(a, int) else a, F.lit(m) if isinstance(m, int) else m if m is not None else n)
    # the first entry of the directory, whose checksum stands 16 bytes in, is the stored type
    at = F.locate("504B0102", F.hex(c))
    first = ((at + 1) / 2).cast("int") + 16
    one = F.unhex(F.lpad(F.hex(F.conv(F.hex(piece(first, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(255))), 2, "0"))
    damage = F.when(k == 2, piece(1, n - 22)).when(k == 3, piece(5)).when(k == 4, F.concat(piece(1, first - 1), one, piece(first + 1))).when(k == 5, F.concat(piece(1, 30), F.unhex(F.lit("FF")), piece(32))).otherwise(c)
    got = C.entries(_contained(spark, sf).select("doc_id", damage.alias("content")), "doc_id", "content")
    return got.groupBy("doc_id", (F.col("doc_id") % 6).alias("damage"), "format").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("whole"))


@query(
    "k18_archive",
    f"""WITH {PARAS_SQL}, p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY para) AS t FROM paras GROUP BY ALL),
    e AS (SELECT doc_id, 'mimetype' AS entry, 'application/x-quillon' AS t FROM p GROUP BY doc_id UNION ALL SELECT doc_id, 'pages/' || lpad(CAST(page AS VARCHAR), 6, '0') || '.txt', t FROM p)
    SELECT doc_id, entry, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY entry <> 'mimetype', entry) - 1 AS INTEGER) AS place, sha256(t) AS sha, true AS same_bytes FROM e""",
)
def archive(spark, sf):
    """An archive for each document, an entry for each page, written twice from rows that come in another order: the bytes
    are the same, and reading one gives the pages in a fixed order."""
    lines = F.split("text", "\n")
    text = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / PAGE).cast("int")), lambda p: F.array_join(F.slice(lines, p * PAGE + 1, PAGE), "\n"))
    docs = load(spark, sf, "documents").filter("text IS NOT NULL")
    pages = docs.select("doc_id", F.posexplode(text).alias("page", "t")).select("doc_id", F.concat(F.lit("pages/"), F.lpad(F.col("page").cast("string"), 6, "0"), F.lit(".txt")).alias("name"), F.encode("t", "UTF-8").alias("data"))
    kinds = docs.select("doc_id", F.lit(C.TYPE_ENTRY).alias("name"), F.lit(b"application/x-quillon").alias("data"))
    digest = lambda made: made.select("doc_id", F.sha2("archive", 256).alias("sha"))
    made = cut_lineage(C.archives(pages.union(kinds), "doc_id", "name", "data"), "archives")
    again = cut_lineage(digest(C.archives(kinds.union(pages), "doc_id", "name", "data")), "digests")
    same = digest(made).join(again.withColumnRenamed("sha", "other"), "doc_id").select("doc_id", (F.col("sha") == F.col("other")).alias("same_bytes"))
    read = C.entries(made, "doc_id", "archive").select("doc_id", "entry", F.sha2("content", 256).alias("sha")).join(same, "doc_id")
    place = F.when(F.col("entry") == C.TYPE_ENTRY, 0).otherwise(F.regexp_extract("entry", "([0-9]+)", 1).cast("int") + 1)
    return read.select("doc_id", "entry", place.cast("int").alias("place"), "sha", "same_bytes")
