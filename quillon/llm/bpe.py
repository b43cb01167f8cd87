"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word the tokens that end there come from one automaton over the vocabulary.
The greedy merges' encoding of a prefix has a unique last token: the one that is compatible with
the last token of what stands before it, where two tokens are compatible if merging their
characters by rank never joins across their border. Following these back gives the exact ids,
without carrying out merges.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.runtime import session, table, turn_to

#: Stands for the end of a word in the automaton's keys.
_STOP = "\x00"
#: White_Space as the tokenizer files' patterns mean it; Python's own adds \x1c to \x1f.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD_SPACES = re.compile("[\x1c-\x1f]")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}\p{White_Space}]+|[\x1c-\x1f]+")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Most texts have letters below U+0250 only: their classes as plain sets, which re matches faster.
_WIDE = re.compile("[^\x00-\u024f]")


def _latin_pieces() -> re.Pattern:
    of = lambda c: "".join(re.escape(x) for x in map(chr, range(0x250)) if regex.match(c, x))
    letters, numbers = of(r"\p{L}"), of(r"\p{N}")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}\t-\r \x85\xa0\x1c-\x1f]+|[\x1c-\x1f]+")


_LATIN_PIECES = _latin_pieces()
#: Bytes of memory that one Python worker may hold for stretches between white space, for the pieces
#: they consist of, and for pairs of tokens; and the longest key that is held.
CHUNK_BYTES, PIECE_BYTES, PAIRS, LONGEST_KEY = 80 << 20, 96 << 20, 500_000, 64


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from 256 on in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """An encoder of a word-end BPE file: NFC, lower case, white space dropped, byte-level, suffix on a word's last symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, made = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((i, j), r)
            self.parts.setdefault(made, (i, j, r))
        self.find = ahocorasick.Automaton()
        for t, i in vocab.items():
            whole = len(t) > len(self.suffix) and t.endswith(self.suffix)
            key = t[: -len(self.suffix)] + _STOP if whole else t
            if i in self.parts or len(key) - whole == 1:
                self.find.add_word(key, (len(key), i))
        self.find.make_automaton()
        self.letters = {chr(b): c for b, c in byte_letters().items()}
        self.table = str.maketrans(self.letters)
        self.joined: dict[int, bool] = {}
        self.pieces = _Cache(self._piece, PIECE_BYTES)
        self.cache = _Cache(self._chunk, CHUNK_BYTES)

    def _spine(self, t: int, side: int) -> list[tuple[int, float]]:
        """(token, rank at which it is joined to its parent) down one side of a token's merge tree."""
        out, up = [(t, float("inf"))], None
        while (up := self.parts.get(out[-1][0])) is not None:
            out.append((up[side], up[2]))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their characters are merged by rank, leftmost first."""
        key = a << 32 | b
        known = self.joined.get(key)
        if known is None:
            left = self._spine(b, 0)
            known = True
            for x, gone in self._spine(a, 1):
                for y, taken in left:
                    r = self.rank.get((x, y))
                    if r is not None and r < gone and r <= taken:
                        known = False
                        break
                if not known:
                    break
            if len(self.joined) > PAIRS:
                self.joined.clear()
            self.joined[key] = known
        return known

    def word(self, word: str) -> list[int]:
        """The ids of one piece of text, given as byte letters."""
        n = len(word)
        last: list[int | None] = [None] * (n + 1)
        size = [0] * (n + 1)
        joined, compatible = self.joined, self.compatible
        for end, (length, token) in self.find.iter(word + _STOP):
            whole = end == n  # the key's stop sign: this token ends the word
            if whole:
                at, length = n, length - 1
            else:
                at = end + 1
                if at == n:
                    continue  # a word's last symbol always has its suffix
            if last[at] is not None:
                continue
            lo = at - length
            if lo:
                before = last[lo]
                if before is None:
                    continue
                ok = joined.get(before << 32 | token)
                if not (compatible(before, token) if ok is None else ok):
                    continue
            last[at], size[at] = token, length
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _piece(self, piece: str) -> bytes:
        return np.array(self.word(piece.encode().decode("latin-1").translate(self.table)), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch without white space. Words with other marks around them share their pieces' ids."""
        low = chunk.lower()
        if low.isascii():
            pieces = (low,) if low.isalpha() else _ASCII_PIECES.findall(low)
        elif not _WIDE.search(low):
            pieces = _LATIN_PIECES.findall(low)
        else:
            pieces = _PIECES.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        parts = self.split.split(text) if self.split and any(s in text for s in self.special) else [text]
        ids: list[bytes] = []
        for p in parts:
            if p in self.special:
                ids.append(np.array([self.special[p]], "<u4").tobytes())
            else:
                ids += map(self.cache.__getitem__, _SPACES.split(p) if _ODD_SPACES.search(p) else p.split())
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """The tokens with spaces between them, as these files have no decoder of their own; unknown ids have none."""
        found = np.frombuffer(ids, "<u4").tolist()
        try:
            return " ".join(map(self.tokens.__getitem__, found))
        except KeyError:
            return " ".join([self.tokens[i] for i in found if i in self.tokens])

    def text(self, ids: bytes) -> str:
        """Readable text: byte letters turned back, a space after each word's end."""
        back = {c: b for b, c in byte_letters().items()}
        out = bytearray()
        for i in np.frombuffer(ids, "<u4").tolist():
            t = self.tokens[i]
            if i in self.special.values():
                out += t.encode() + b" "
                continue
            end = len(t) > len(self.suffix) and t.endswith(self.suffix)
            out += bytes(back[c] for c in (t[: -len(self.suffix)] if end else t)) + b" " * end
        return out.decode("utf-8", "replace").rstrip(" ")


class _Cache(dict):
    """Makes what is missing; two generations of half the bytes each, so what is still asked for stays."""

    #: What a string, a bytes object and their place in a dictionary take besides their content.
    EACH = 200

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old, self.held = make, most, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEY:
            if self.held >= self.most // 2:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[key] = value
            self.held += self.EACH + 2 * len(key) + len(value)
        return value


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Bpe:
    return Bpe(path)


def _encode(path: str, keep: bool):
    def run(batches):
        turn_to("bpe", encoder.cache_clear)
        bpe = encoder(path)
        for b in batches:
            n, ids_hex, text_hex, ids = [], [], [], []
            for t in b.column(1):
                raw = bpe.encode(t.as_py() or "")
                n.append(len(raw) // 4)
                ids_hex.append(hashlib.sha256(raw).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(raw).encode()).hexdigest())
                if keep:
                    ids.append(raw)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 and, with keep, the ids themselves; decode_texts() turns those
    back into text.

    Null texts count as empty: no tokens. Long texts are encoded whole. A prefix has one last token only, so there are
    no ties. Repeated rows and null ids are kept; an empty table
    gives no rows; other columns are ignored. path is a file on every executor. Characters that only a newer
    Unicode than the regex module's knows count as no letters.
    """
    session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep
    return rows.mapInArrow(_encode(path or tokenizer_path(), keep), schema).withColumnRenamed("doc_id", id_col)


def _decode(path: str):
    def run(batches):
        turn_to("bpe", encoder.cache_clear)
        bpe = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.text(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decode_texts(tokens: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and readable text of token ids; null ids are an empty text. Case and white space are not in the ids."""
    session(tokens.sparkSession)
    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col)).mapInArrow(_decode(path or tokenizer_path()), f"doc_id {kind}, text string").withColumnRenamed("doc_id", id_col)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the 49k word-end vocabulary."""
    return encode_texts(table(spark, sf_dir, "documents"))
