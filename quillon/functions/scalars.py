"""Scalar functions as column expressions."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys whose strings are structure, not content.
KEPT_KEYS = ("planVersion", "action")
PUA = "[\ue000-\uf8ff]"


def commitment(value: Column, salt: Column) -> Column:
    return F.sha2(F.concat(value, salt), 256)


def normal_lines(text: Column) -> Column:
    """CRLF to LF, lines trimmed at the right, the end trimmed."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[ \t]+\n", "\n"))


def match_key(text: Column, size: int = 24) -> Column:
    return F.substring(F.replace(F.regexp_replace(text, PUA, ""), F.lit(" "), F.lit("")), 1, size)


def compare_class(a: Column, b: Column) -> Column:
    """How two texts differ: not, by figure spaces, by white space, by loss, or in content."""
    squeezed = lambda c: F.regexp_replace(c, "[ \t\r\n\u2007]+", "")
    figure = lambda c: F.replace(c, F.lit("\u2007"), F.lit(" "))
    return (
        F.when(a.isNull() | b.isNull(), "missing")
        .when(a == b, "same")
        .when(figure(a) == figure(b), "figure-space-only")
        .when(squeezed(a) == squeezed(b), "whitespace-only")
        .when(F.length(squeezed(b)) < F.length(squeezed(a)), "content-loss")
        .otherwise("content-diff")
    )


def int_or(text: Column, pattern: str, default: int = -1) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int"), F.lit(default))


#: What named character references stand for.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "deg": "°", "middot": "·", "hellip": "…", "ndash": "–", "mdash": "—", "laquo": "«", "raquo": "»", "euro": "€", "sect": "§", "times": "×"}


def decode_entities(text: Column) -> Column:
    """Character references, named (ENTITIES), decimal and hexadecimal, as characters, each once: '&amp;lt;' gives '&lt;'. Unknown names, and
    numbers that are no character, stay as they stand."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(part: Column, i: Column) -> Column:
        name = F.regexp_extract(part, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);", 1)
        code = F.when(name.rlike("^#[0-9]"), F.substr(name, F.lit(2))).when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).try_cast("int")
        fine = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(fine, F.decode(F.unhex(F.lpad(F.hex(F.when(fine, code)), 8, "0")), "UTF-32")).otherwise(F.try_element_at(names, name))
        return F.when((i > 0) & char.isNotNull(), F.concat(char, F.substr(part, F.length(name) + 2))).when(i > 0, F.concat(F.lit("&"), part)).otherwise(part)

    return F.array_join(F.transform(F.split(text, "&"), one), "")


def entropies(texts: pd.Series) -> pd.Series:
    """Bits of each text's characters: one histogram over (text, character) for all of them. Null stays null, nothing has 0."""
    some = texts.fillna("")
    n = some.str.len().to_numpy(np.int64)
    points = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    found, times = np.unique(np.repeat(np.arange(len(n)), n) << 21 | points, return_counts=True)
    at = found >> 21
    p = times / n[at]
    bits = 0.0 - np.bincount(at, p * np.log2(p), minlength=len(n))
    return pd.Series(bits + 0.0, index=texts.index).where(texts.notna())


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; Arrow batches, so the caller's package must be on the workers (tables.load ships it)."""
    return F.pandas_udf(entropies, "double")(text)


def pad_hex_name(number: Column, ext: Column) -> Column:
    """BIN and four hexadecimal digits of number + 1, a dot and the extension."""
    return F.format_string("BIN%04X.%s", (number + 1).cast("int"), ext)


def redact_json(text: str, salt: str) -> tuple[str, list[tuple[str, str, str]]]:
    """Every string leaf but those of KEPT_KEYS becomes its commitment; what was redacted is listed
    as (pointer, value, salt). Salts follow from the given one and the pointer, so runs agree."""
    leaves: list[tuple[str, str, str]] = []

    def walk(node, at):
        if isinstance(node, dict):
            return {k: v if k in KEPT_KEYS and isinstance(v, str) else walk(v, f"{at}/{k.replace('~', '~0').replace('/', '~1')}") for k, v in node.items()}
        if isinstance(node, list):
            return [walk(v, f"{at}/{i}") for i, v in enumerate(node)]
        if isinstance(node, str):
            s = hashlib.sha256(f"{salt}{at}".encode()).hexdigest()[:32]
            leaves.append((at, node, s))
            return hashlib.sha256((node + s).encode()).hexdigest()
        return node

    return json.dumps(walk(json.loads(text), ""), separators=(",", ":"), ensure_ascii=False), leaves
