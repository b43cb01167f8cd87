"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Scans are linear in the text: an e-mail is looked for around each '@', numbers are built from the
text's digit runs, and a phone number starts at a '+'.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.runtime import session, table, turn_to

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Scores before context, and the words within CONTEXT characters that raise them.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "server", "host", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "security number"),
}
#: Words that speak against personal data: examples, and numbers of other things.
AGAINST = {
    "email": ("example", "noreply", "no-reply"),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("order", "invoice", "tracking", "serial", "example", "test"),
    "phone": ("order", "invoice", "serial", "example"),
    "iban": ("example", "test"),
    "ssn": ("part", "order", "invoice", "serial", "example", "model"),
}
CONTEXT, RAISE, LOWER, LEAST = 48, 0.3, 0.2, 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"[0-9 ().-]*")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[str, int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in _LOCAL_CHARS:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", lo, m.end()))
            end = m.end()
            at = text.find("@", end)
        else:
            end = max(end, at + 1)  # no local part reaches over an '@'
            at = text.find("@", at + 1)
    return out


def _small(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) <= 2 or len(p) == 3 and p <= "255"


def _numbers(text: str, runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    out = []
    i, n = 0, len(runs)
    while i < n:  # four runs with one '.' between each two; a failing match is dropped whole
        if i + 3 < n and all(runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] == "." for j in (i, i + 1, i + 2)):
            if all(_small(text[a:b]) for a, b in runs[i : i + 4]):
                out.append(("ip", runs[i][0], runs[i + 3][1]))
            i += 4
        else:
            i += 1
    i = 0
    while i < n:  # as many runs as single spaces or hyphens join
        j, size = i, runs[i][1] - runs[i][0]
        while j + 1 < n and runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] in " -":
            j += 1
            size += runs[j][1] - runs[j][0]
        if 14 <= size <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            out.append(("card", runs[i][0], runs[j][1]))
        i = j + 1
    return out


def _phones(text: str) -> list[tuple[str, int, int]]:
    out = []
    at = text.find("+")
    while at >= 0:
        if text[at + 1 : at + 2] and text[at + 1] in "0123456789":
            end = _PHONE.match(text, at + 2).end()
            while end > at + 3 and text[end - 1] not in "0123456789":
                end -= 1
            if end > at + 3:
                if 10 <= sum(map(text.count, "0123456789", [at] * 10, [end] * 10)) <= 15:
                    out.append(("phone", at, end))
                at = text.find("+", end)
                continue
        at = text.find("+", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four fixed kinds, by start and then kind."""
    out = _emails(text)
    runs = [m.span() for m in _DIGITS.finditer(text)]
    if runs:
        out += _numbers(text, runs) + _phones(text)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_FOR, _NOT = ({k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ws)) + ")") for k, ws in words.items()} for words in (WORDS, AGAINST))


def scored(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : end + CONTEXT].lower()
    return min(1.0, SCORES[kind] + RAISE * bool(_FOR[kind].search(near)) - LOWER * bool(_NOT[kind].search(near)))


def spans(text: str, least: float = LEAST) -> list[tuple[str, int, int, float]]:
    """All spans with scores: the fixed kinds always, others if checksum and context give them least."""
    out = [(k, a, b, scored(text, k, a, b)) for k, a, b in base_spans(text)]
    more = [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m.group())] + [("ssn", *m.span()) for m in _SSN.finditer(text)]
    out += [(k, a, b, s) for k, a, b in more if (s := scored(text, k, a, b)) >= least]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str, found: list[tuple[str, int, int, float]]) -> str:
    """The text with each stretch that spans cover replaced by the first span's kind in brackets."""
    out, end = [], 0
    for k, a, b, _ in found:
        if a >= end:
            out += [text[end:a], f"[{k.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def _join(found) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in found)


def _scan(batches):
    for b in batches:
        cols: list[list] = [[] for _ in range(8)]
        for t in b.column(1).to_pylist():
            t = t or ""
            found = spans(t)
            base = [s for s in found if s[0] in KINDS[:4]]
            for c, k in zip(cols, KINDS[:4]):
                c.append(sum(s[0] == k for s in base))
            cols[4].append(hashlib.sha256(_join(base).encode()).hexdigest())
            cols[5].append(_join(found))
            cols[6].append(max((s[3] for s in found), default=0.0))
            cols[7].append(redacted(t, found) if found else t)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.float64()), pa.array(cols[7], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "top_score", "redacted"])


def _digest(batches):
    for b in _scan(batches):
        yield b.drop_columns(["redacted"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end), top_score and,
    with redact, the redacted text, for each row of docs.

    Null texts count as empty: no spans, and an empty redacted text. Spans that start together go in the order of
    their kinds. Long texts are scanned whole, in linear time. Repeated rows and null ids
    are kept; an empty table gives no rows; other columns are ignored.
    """
    session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, top_score double"
    return rows.mapInArrow(_scan if redact else _digest, schema + ", redacted string" * redact).withColumnRenamed("doc_id", id_col)


def _rewrite(text_at: int, chars_at: int | None):
    def run(batches):
        turn_to("pii")
        for b in batches:
            texts = [t if t is None else redacted(t, spans(t)) for t in b.column(text_at).to_pylist()]
            b = b.set_column(text_at, b.schema.field(text_at).name, pa.array(texts, b.schema.field(text_at).type))
            if chars_at is not None:
                f = b.schema.field(chars_at)
                b = b.set_column(chars_at, f.name, pa.array([None if t is None else len(t) for t in texts], f.type))
            yield b

    return run


def redact_rows(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with personal data in text_col replaced by its kind in brackets; nulls stay null."""
    session(docs.sparkSession)
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return docs.mapInArrow(_rewrite(docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col else None), docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_pii(table(spark, sf_dir, "documents"))
