"""Table functions for SQL users: search and extraction over any table, with its other columns."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quillon.shipping import ship


def _checked(table: AnalyzeArgument, *constants: AnalyzeArgument) -> list[StructField]:
    """The columns that a function passes on: all but text, which has to be there."""
    if not table.isTable:
        raise ValueError("the first argument is TABLE(...)")
    fields = table.dataType.fields
    if not any(f.name == "text" and isinstance(f.dataType, StringType) for f in fields):
        raise ValueError("the table needs a column text of type string")
    for c in constants:
        if c.isTable or not c.isConstantExpression or not c.value:
            raise ValueError("the word is a constant, and not empty")
    return [f for f in fields if f.name != "text"]


@udtf
class Search:
    """quillon_search(TABLE(t), word): the table's columns but text, para and char of each match, which don't overlap; the same
    rows as operators.search gives over paragraphs."""

    @staticmethod
    def analyze(table: AnalyzeArgument, word: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType([*_checked(table, word), StructField("para", IntegerType()), StructField("char", IntegerType())]))

    def eval(self, row, word: str):
        kept = [row[f] for f in row.__fields__ if f != "text"]
        for para, line in enumerate((row["text"] or "").split("\n") if row["text"] is not None else ()):
            at = line.find(word)
            while at >= 0:
                yield (*kept, para, at)
                at = line.find(word, at + len(word))


@udtf
class Extract:
    """quillon_extract(TABLE(t), pattern): the table's columns but text, para, char and match for each hit of a regular expression."""

    @staticmethod
    def analyze(table: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        kept = _checked(table, pattern)
        re.compile(pattern.value)
        return AnalyzeResult(StructType([*kept, StructField("para", IntegerType()), StructField("char", IntegerType()), StructField("match", StringType())]))

    def eval(self, row, pattern: str):
        kept = [row[f] for f in row.__fields__ if f != "text"]
        for para, line in enumerate(row["text"].split("\n") if row["text"] is not None else ()):
            for m in re.finditer(pattern, line):
                yield (*kept, para, m.start(), m.group())


@udtf
class Numbered:
    """quillon_numbered(TABLE(t) PARTITION BY ... ORDER BY ...): the table's columns but text, the row's place in its partition,
    and how many code points of text stand before it there. State lives as long as a partition."""

    def __init__(self):
        self.place, self.before = 0, 0

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(StructType([*_checked(table), StructField("place", IntegerType()), StructField("before", IntegerType())]))

    def eval(self, row):
        yield (*(row[f] for f in row.__fields__ if f != "text"), self.place, self.before)
        self.place, self.before = self.place + 1, self.before + len(row["text"] or "")


def register(spark: SparkSession) -> None:
    ship(spark)
    for name, f in (("quillon_search", Search), ("quillon_extract", Extract), ("quillon_numbered", Numbered)):
        spark.udtf.register(name, f)
