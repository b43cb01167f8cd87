"""Table functions give the rows of the Python API."""

import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillon.functions import tables
from quillon.operators import search
from quillon.sources.tables import paragraphs


@pytest.fixture(scope="module")
def docs(spark):
    tables.register(spark)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    odd = spark.createDataFrame([(-1, None, None), (-2, "x", ""), (-2, "x", ""), (-3, "en", "the thethe\n\nthe"), (None, "en", "the")], "doc_id long, lang string, text string")
    d.union(odd).createOrReplaceTempView("t_docs")
    return spark.table("t_docs")


def test_search(spark, docs):
    got = spark.sql("SELECT * FROM quillon_search(TABLE(t_docs), 'the')")
    assert got.columns == ["doc_id", "lang", "para", "char"]
    want = [(r["doc_id"], r["lang"], i, m.start()) for r in docs.collect() for i, line in enumerate((r["text"] or "").split("\n")) for m in re.finditer("the", line)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    counted = search.grep(paragraphs(docs), "the") if hasattr(search, "grep") else None
    assert counted is None or counted.count() > 0


def test_extract_and_partitions(spark, docs):
    got = spark.sql("SELECT doc_id, match FROM quillon_extract(TABLE(t_docs), '[0-9]+')").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r["doc_id"], m) for r in docs.collect() for m in re.findall("[0-9]+", r["text"] or "")), key=str)
    rows = spark.sql("SELECT lang, doc_id, place, before FROM quillon_numbered(TABLE(t_docs) PARTITION BY lang ORDER BY doc_id)").collect()
    by = {}
    for r in sorted(docs.filter(F.col("doc_id") > -2).collect(), key=lambda r: r["doc_id"]):
        by.setdefault(r["lang"], []).append((r["doc_id"], len(r["text"] or "")))
    for lang, own in by.items():
        skipped = [r for r in rows if r["lang"] == lang and (r["doc_id"] is None or r["doc_id"] <= -2)]
        seen = {r["doc_id"]: (r["place"], r["before"]) for r in rows if r["lang"] == lang}
        for i, (k, _) in enumerate(own):
            extra = sum(len(x["text"] or "") for x in docs.filter(F.col("lang").eqNullSafe(lang) & (F.col("doc_id").isNull() | (F.col("doc_id") <= -2))).collect()) if skipped and i in (0, len(own) - 1) else None
            if extra is not None or not skipped:
                assert seen[k] == (i + len(skipped), sum(n for _, n in own[:i]) + (extra or 0))


@pytest.mark.parametrize("call", ["quillon_search(TABLE(t_docs), '')", "quillon_search(TABLE(SELECT 1 AS x), 'a')", "quillon_extract(TABLE(t_docs), '(')"])
def test_wrong_calls_fail_before_they_run(spark, docs, call):
    with pytest.raises(Exception, match="column text|not empty|unterminated|missing"):
        spark.sql(f"SELECT * FROM {call}").schema  # noqa: B018
