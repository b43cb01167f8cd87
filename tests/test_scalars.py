"""Scalar functions on odd values."""

import math
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from quillon.functions import scalars as S


def test_entities(spark):
    want = {
        "a & b": "a & b", "&": "&", "": "", "&amp;amp;": "&amp;", "&amp;lt;&lt;": "&lt;<", "&#65;&#x42;&#X43;": "ABC", "&#128512;": "😀", "&#55296;&#0;&#1114112;&#9999999;": "&#55296;&#0;&#1114112;&#9999999;",
        "&nosuch;&AMP;": "&nosuch;&AMP;", "&lt": "&lt", "x&copy;y&middot;z&": "x©y·z&", "&&lt;;": "&<;",
    }
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", S.decode_entities(F.col("t")).alias("d")).collect()} == want | {None: None}


def test_entropies():
    texts = ["", "a", "aaaa", "ab", "abcd" * 9, "é😀é x", None, "the quick brown fox"]
    for t, got in zip(texts, S.entropies(pd.Series(texts)), strict=True):
        n = Counter(t or "")
        want = sum(-k / len(t) * math.log2(k / len(t)) for k in n.values()) if t else 0.0
        assert math.isnan(got) if t is None else abs(got - want) < 1e-12
    assert len(S.entropies(pd.Series([], dtype=object))) == 0
