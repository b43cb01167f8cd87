"""Licence scans: one Aho-Corasick automaton finds notice phrases and identifier tags, and a
shunting-yard parser evaluates the and/or/with expressions of the tags.

A text is reduced to its lower-cased words with single spaces between, in a few byte operations;
the automaton's keys have a space at both ends, so phrases match whole words only.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.runtime import session, table

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices beyond the base ones.
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
TAG = "spdx license identifier"
#: Whole identifiers of tags, by family. Families with versions take one (GPL-2.0, GPLv2), and how later ones count.
_VERSION = r"(-?v?[0-9]+(\.[0-9]+)*)?(\+|-only|-or-later)?"
IDENTIFIERS = {
    "agpl": f"agpl{_VERSION}",
    "lgpl": f"lgpl{_VERSION}",
    "gpl": f"gpl{_VERSION}",
    "apache": f"apache{_VERSION}",
    "mpl": f"mpl{_VERSION}(-no-copyleft-exception)?",
    "epl": f"epl{_VERSION}",
    "mit": "mit(-0)?",
    "bsd": "0bsd|bsd(-[1-4]-clause)?",
    "isc": "isc",
    "bsl": "bsl-1\\.0",
    "zlib": "zlib",
    "unlicense": "unlicense",
    "cc0": "cc0(-1\\.0)?",
    "cc-by": "cc-by(-[0-9]\\.[0-9])?",
    "cc-by-sa": "cc-by-sa(-[0-9]\\.[0-9])?",
    "cc-by-nd": "cc-by-nd(-[0-9]\\.[0-9])?",
    "cc-by-nc": "cc-by-nc(-[0-9]\\.[0-9])?",
    "cc-by-nc-sa": "cc-by-nc-sa(-[0-9]\\.[0-9])?",
    "cc-by-nc-nd": "cc-by-nc-nd(-[0-9]\\.[0-9])?",
}
#: How free use is under each family, from 0 to 1.
FREE = {"gpl": 0.4, "agpl": 0.2, "lgpl": 0.6, "mpl": 0.7, "epl": 0.7, "cc-by": 0.9, "cc-by-sa": 0.6, "cc-by-nd": 0.3, "cc-by-nc": 0.3, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "apache": 1.0, "mit": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "zlib": 1.0, "cc0": 1.0, "unlicense": 1.0}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD_BYTES = _FOLD.tobytes()
#: A tag's expression goes on to the next line where a line ends with an operator; comment signs there are no part of it.
_TAG_AT = re.compile(r"spdx-license-identifier:[ \t]*((?:[^\r\n]*[ \t)](?:or|and|with)[ \t]*\r?\n[ \t/*#;-]*)*[^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrases, base in ((BASE, True), (MORE, False)):
        for p, label in phrases.items():
            a.add_word(f" {p} ", (len(p), label, base))
    a.add_word(f" {TAG} ", (len(TAG), None, False))
    a.make_automaton()
    return a


_IDENTIFIER = re.compile("|".join(f"(?P<{label.replace('-', '_')}>{pattern})" for label, pattern in IDENTIFIERS.items()))


@functools.lru_cache(maxsize=4096)
def family(identifier: str) -> str | None:
    """The family of a whole identifier; what only begins like one (MITRE, EPLUS) has none."""
    m = _IDENTIFIER.fullmatch(identifier.lower())
    return m.lastgroup.replace("_", "-") if m else None


def parse(expression: str) -> list[str] | None:
    """Postfix of the longest leading expression, by shunting-yard; None if there is none. What follows it is prose,
    an operator without what it asks for included; an identifier after an operator is part of it if its family is
    known or no other word follows."""
    tokens = _TOKEN.findall(expression)
    out: list[str] = []
    stack: list[str] = []
    operand = False
    done: list[str] | None = None  # the postfix of the longest expression so far
    for i, token in enumerate(tokens):
        low = token.lower()
        if low in _PRECEDENCE:
            if not operand:
                break
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break  # prose after the expression
            named = family(token) or stack and stack[-1] == "with"
            if done is not None and not named and i + 1 < len(tokens) and tokens[i + 1] != ")" and tokens[i + 1].lower() not in _PRECEDENCE:
                break  # 'MIT and more prose'
            out.append(token)
            operand = True
        if operand and "(" not in stack:
            done = out + stack[::-1]
    return done


def evaluate(postfix: list[str]) -> tuple[set[str], float] | None:
    """Labels and freedom of an expression: 'and' takes the smaller, 'or' the larger, and 'with'
    (an exception) lifts its licence half-way to 1. Unknown identifiers count 0 and have no label."""
    stack: list[tuple[set[str], float]] = []
    for t in postfix:
        if t in _PRECEDENCE:
            if len(stack) < 2:
                return None
            (lb, b), (la, a) = stack.pop(), stack.pop()
            stack.append((la, a + (1 - a) / 2) if t == "with" else (la | lb, min(a, b) if t == "and" else max(a, b)))
        else:
            label = family(t)
            stack.append(({label} if label else set(), FREE.get(label, 0.0)))
    return stack[0] if len(stack) == 1 else None


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float, str | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expression of one text."""
    words = text.encode().translate(_FOLD_BYTES).split()
    base, more, places, values = set(), set(), [], []
    expression = None
    joined = b" ".join(words).decode()
    line = f" {joined} "
    if "licen" in joined or " cc " in line or "creative" in joined or "redistribution" in joined or "unencumbered" in joined:
        tags = False
        for end, (size, label, is_base) in automaton().iter(line):
            if label is None:
                tags = True
            elif is_base:
                base.add(label)
                places.append(end - size - 1)
                values.append(FREE[label])
            else:
                more.add(label)
                values.append(FREE[label])
        if tags:
            found = []
            for m in _TAG_AT.finditer(text):
                post = parse(m.group(1))
                got = evaluate(post) if post else None
                if got:
                    found.append(" ".join(post))
                    more |= got[0]
                    values.append(got[1])
            expression = ";".join(found) or None
    starts, at, seen = [], 0, 0
    for p in sorted(places):
        seen += line.count(" ", at, p)
        at = p
        starts.append(seen)
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), min(values, default=0.0), expression


def _scan(batches):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
    for b in batches:
        rows = [scan(t or "") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expression"])


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, expression.

    score is the freedom of use that all notices and expressions of a text leave together (their
    smallest), and 0 without any. Null texts count as empty: no words and no places. Places of several phrases
    count each; labels are sorted. Long texts are scanned whole. Repeated rows
    and null ids are kept; an empty table gives no rows; other columns are ignored.
    """
    session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string").withColumnRenamed("doc_id", id_col)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all documents."""
    return find_licenses(table(spark, sf_dir, "documents"))
