"""The byte kernels and the exact algorithms against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import bpe, ctw, decontam, htmlmain, langid, licenses, pii, vafile
from quillon.llm import textkernel as K
from quillon.llm.runtime import steps, text_parts

ODD = ["", None, " ", "a", "a b c d", "A B C D e", "\n\t x\x0by ", "é Ünï ß", "x" * 5000, "a\x00b c", "日本 語"]


def test_words_and_shingles():
    col = pa.array(ODD * 3)
    buf, offsets = text_parts(col)
    low = K.LOWER[buf]
    s, e, first = K.word_spans(low, offsets)
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    want = [re.findall(r"[^\x20\x09-\x0D]+", fold(t)) for t in ODD * 3]
    got = [[bytes(low[a:b]).decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]])] for i in range(len(col))]
    assert got == want
    h = K.word_hashes(low, s, e)
    seen = {}
    for w, x in zip((w for ws in want for w in ws), h, strict=True):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    sh, sf = K.shingles(h, first, 4, short=True)
    for i, ws in enumerate(want):
        n = len({tuple(ws[j : j + 4]) for j in range(max(1, len(ws) - 3))}) if ws else 0
        assert len(np.unique(sh[sf[i] : sf[i + 1]])) == n


def test_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(K, "SLICE", 16)
    monkeypatch.setattr(K, "_powers", [])
    buf = np.frombuffer(b"alpha beta alpha " * 20 + b"z" * 200 + b" alpha", np.uint8)
    s, e, _ = K.word_spans(buf, np.array([0, len(buf)]))
    h = K.word_hashes(buf, s, e)
    words = [bytes(buf[a:b]) for a, b in zip(s, e)]
    assert len(set(h.tolist())) == len(set(words)) and len({x for w, x in zip(words, h.tolist()) if w == b"alpha"}) == 1


def test_steps_cover_all_rows():
    assert [x for lo, hi in steps(pa.array(ODD)) for x in range(lo, hi)] == list(range(len(ODD)))
    assert list(steps(pa.array([], pa.string()))) == []


def test_bpe_is_exact():
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(bpe.tokenizer_path()), bpe.Bpe(bpe.tokenizer_path())
    rng = random.Random(1)
    texts = [x or "" for x in ODD] + ["It's they're I'LL ΣΑΣ Σ İx ½ ² Ⅷ", "<|startoftext|>Hi<|endoftext|> <|endoftext|>", "a\x1cb\x1d c\x85f", "العربية हिन्दी 👍🏽", "a" * 300, "</w> a</w>b", "éa ́x"]
    texts += ["".join(rng.choice("abcdehinorst  '.,!1Éß") for _ in range(rng.randrange(80))) for _ in range(400)]
    for text in texts:
        want = t.encode(text, add_special_tokens=False)
        raw = b.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == want.ids
        assert b.decode(raw) == t.decode(want.ids, skip_special_tokens=False)


def test_pii_is_what_the_patterns_say():
    e, i = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    c, p = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda s: "".join(x for x in s if x in "0123456789")

    def brute(t):
        out = [("email", *m.span()) for m in e.finditer(t)] + [("ip", *m.span()) for m in i.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        out += [("card", *m.span()) for m in c.finditer(t) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
        out += [("phone", *m.span()) for m in p.finditer(t) if 10 <= len(digits(m.group())) <= 15]
        return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    rng = random.Random(2)
    for alphabet in ("ab1 2.3+-@(49", "0123456789012345678. -+", "a.@b"):
        for _ in range(8000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(70)))
            assert pii.base_spans(t) == brute(t), t
    assert [s[0] for s in pii.spans("iban DE89 3704 0044 0532 0130 00 ok")] == ["iban"]
    assert not pii.spans("iban DE89 3704 0044 0532 0130 01 ok")
    assert [s[0] for s in pii.spans("my ssn is 123-45-6789")] == ["ssn"] and not pii.spans("part 123-45-6789")
    lower, raised = pii.scored("order 4111111111111111", "card", 6, 22), pii.scored("visa 4111111111111111", "card", 5, 21)
    assert lower < pii.SCORES["card"] < raised
    t = "write a@b.co or +1 (555) 123-4567"
    assert pii.redacted(t, pii.spans(t)) == "write [EMAIL] or [PHONE]"
    assert pii.base_spans("1" * 200_000 + "@" * 1000 + "+" * 1000) == []


def test_licence_expressions():
    value = lambda s: licenses.evaluate(licenses.parse(s))
    assert value("MIT OR GPL-2.0-only")[1] == 1.0 and value("MIT AND GPL-2.0-only")[1] == 0.4
    assert value("GPL-2.0-only WITH Classpath-exception-2.0")[1] == pytest.approx(0.7)
    assert value("MIT OR Apache-2.0 AND GPL-3.0")[1] == 1.0 and value("(MIT OR Apache-2.0) AND GPL-3.0")[1] == 0.4
    assert licenses.parse("AND MIT") is None and licenses.parse("(MIT") is None and licenses.parse("") is None
    assert licenses.parse("MIT OR") == licenses.parse("MIT OR (see LICENSE") == licenses.parse("MIT and more prose") == ["MIT"]
    assert licenses.parse("MIT OR Foo-1.0") == ["MIT", "Foo-1.0", "or"] and licenses.parse("(MIT OR X) AND Y") == ["MIT", "X", "or", "Y", "and"]
    assert licenses.scan("SPDX-License-Identifier: MIT OR Apache-2.0\n")[5] == "apache,mit"
    assert licenses.scan("// SPDX-License-Identifier: (MIT OR\n//   Apache-2.0) AND\n// BSD-3-Clause\n// more prose")[5:] == ("apache,bsd,mit", 1.0, "MIT Apache-2.0 or BSD-3-Clause and")
    assert licenses.scan("SPDX-License-Identifier: MIT\nApache-2.0")[5] == "mit"
    same = {"mit": ["MIT", "mit-0"], "gpl": ["GPL", "GPL-2.0-only", "GPLv3+", "gpl-3.0-or-later"], "bsd": ["BSD", "0BSD", "BSD-3-Clause"], "cc-by": ["CC-BY-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-nc-nd": ["cc-by-nc-nd-3.0"], "epl": ["EPL-2.0"], "cc0": ["CC0-1.0"], "mpl": ["MPL-2.0-no-copyleft-exception"]}
    assert all(licenses.family(i) == label for label, ids in same.items() for i in ids) and set(licenses.FREE) == set(licenses.IDENTIFIERS)
    assert not any(map(licenses.family, ["MITRE-internal", "mitigation", "EPLUS", "MPLAB-EULA", "ISCAS", "GPL-compatible", "CC-BY-ish", "BSD-5-Clause", ""]))
    assert licenses.scan("MIT license, MIT-License cc  by")[:4] == (6, 3, 0, 4)
    assert licenses.scan("")[:4] == (0, 0, None, None) and licenses.scan("permit licensed")[1] == 0


def test_bounds_hold_and_survivors_hold_the_best():
    rng = np.random.RandomState(3)
    for scale in (3, 1000, 40_000):
        v = rng.randint(-scale, scale, (300, 8))
        v[50:80] = v[50]
        v[7] *= 1000
        ids = rng.permutation(300).astype(np.int64)
        shift = np.array([max(0, int(np.abs(x).max()).bit_length() - 7) for x in v])
        cells = (v >> shift[:, None]).astype(np.int8)
        assert (cells == v >> shift[:, None]).all()
        q = np.arange(0, 300, 30)
        low, up = vafile.bounds(v[q], cells, shift)
        exact = v[q] @ v.T
        assert (low <= exact).all() and (exact <= up).all()
        i, j, lo, hi = vafile.survivors(ids[q], v[q], ids, cells, shift, 10)
        for n, at in enumerate(q):
            want = sorted((-int(exact[n, c]), int(ids[c])) for c in range(300) if c != at)[:10]
            assert {x for _, x in want} <= set(ids[j[i == n]])
        assert len(i) < 150 * len(q)
    assert len(vafile.survivors(ids[:1], v[:1], ids[:3], cells[:3], shift[:3], 10)[0]) == 2


def test_edit_search():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    rng = random.Random(4)
    for _ in range(400):
        a, b = (bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25))) for _ in "xy")
        want = brute(a, b)
        assert decontam.best_place(a, b)[0] == min(want, len(a))
    many = [bytes(rng.choice(b"ab c") for _ in range(n)) for n in (1, 63, 64, 65, 128, 129, 200, 300)]
    texts = [bytes(rng.choice(b"ab c") for _ in range(rng.randrange(0, 400))) for _ in range(40)] + [b"xx" + t[:-3] + b"y" for t in many]
    own = np.array([rng.randrange(8) for _ in range(40)] + list(range(8)))
    dist, end = decontam.best_places(many, own, texts)
    for k, (i, t) in enumerate(zip(own, texts)):
        assert dist[k] == min(brute(many[i], t), len(many[i])), (k, len(many[i]))
        if dist[k] < len(many[i]):
            assert brute(many[i], t[: end[k]]) == dist[k] and (brute(many[i], t[: end[k] - 1]) > dist[k])


def test_tree_is_a_distribution_and_matches_recursion():
    texts = [b"abab", b"abba", b"ab"]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    codes, first = ctw.gram_codes(buf, offsets)
    assert np.diff(first).tolist() == [5, 5, 3] and [hex(c) for c in codes[:2]] == ["0xffffff61", "0xffff6162"]
    u, n = np.unique(codes, return_counts=True)
    deep = ((u >> np.uint32(8)).astype(np.int64), (u & np.uint32(255)).astype(np.int64), n)
    below = [ctw._below(pa.table({"ctx": deep[0][at], "sym": deep[1][at], "n": deep[2][at]})) for m in np.unique(deep[0] & 0xFFFF) if len(at := np.flatnonzero(deep[0] & 0xFFFF == m))]
    paths = ctw.Paths(*(np.array([x for t in below for x in t[c].to_pylist()]) for c in ("ctx", "counts", "below")))
    ctx3, counts3 = ctw._dense(*deep)
    tree = ctw.Tree(paths, ctx3, paths.logs(ctx3, counts3), np.zeros(0, np.int64))
    for ctx in (0xFFFFFF, 0x616261, 0x7A7A7A, 0x7A7A61, 0x7A6261):
        p = tree.score(np.uint32(ctx << 8) | np.arange(256, dtype=np.uint32))[0]
        assert np.sum(10.0 ** p.astype(np.float64)) == pytest.approx(1, abs=1e-5)

    from math import exp, lgamma, log

    def kt(a, b):
        return lgamma(a + 0.5) + lgamma(b + 0.5) - 2 * lgamma(0.5) - lgamma(a + b + 1)

    grams = [(int(c) >> 8, int(c) & 255) for c in codes]

    def count(suffix, depth, node):
        j = node.bit_length() - 1
        out = [0, 0]
        for ctx, s in grams:
            if (ctx & (1 << 8 * depth) - 1) == suffix and (1 << j | s >> (8 - j)) == node:
                out[s >> (7 - j) & 1] += 1
        return out

    def weight(suffix, depth, node):
        own = kt(*count(suffix, depth, node))
        if depth == 3:
            return own
        below = sum(weight(x << 8 * depth | suffix, depth + 1, node) for x in {c >> 8 * depth & 255 for c, _ in grams if (c & (1 << 8 * depth) - 1) == suffix})
        m = max(own, below)
        return log(0.5) + m + log(exp(own - m) + exp(below - m))

    def predict(ctx, node, bit):
        p = None
        for depth in (3, 2, 1, 0):
            suffix = ctx & (1 << 8 * depth) - 1
            n = count(suffix, depth, node)
            est = (n[bit] + 0.5) / (sum(n) + 1)
            p = est if depth == 3 else (b := exp(log(0.5) + kt(*n) - weight(suffix, depth, node))) * est + (1 - b) * p
        return p

    for ctx, sym in ((0xFFFFFF, 0x61), (0xFF6162, 0x61), (0x616162, 0x62), (0x7A6162, 0x61), (0x7A7A61, 0x62)):
        want = 0.0
        for j in range(8):
            want += np.log10(predict(ctx, 1 << j | sym >> (8 - j), sym >> (7 - j) & 1))
        assert tree.score(np.array([ctx << 8 | sym], np.uint32))[0][0] == pytest.approx(want, abs=1e-4)


def test_language_vectors():
    c = langid.counts(*text_parts(pa.array(["the cat", "THE CAT", "", None])))
    assert (c[0] == c[1]).all() and c[2].sum() == 0 and c[3].sum() == 0
    alone = langid.counts(*text_parts(pa.array(["the cat"])))
    assert (alone[0] == c[0]).all()
    assert not langid.has_letter("12 ²³ !") and langid.has_letter("1é")


def test_main_text():
    w = htmlmain.learn(["<nav><a>x y</a></nav><article><p>a b c</p></article><footer>z</footer>"] * 5)
    page = '<body><nav><a>Home</a></nav><div class="ad">Buy</div><article><h1>T &amp; U</h1><p>One<br>two</p><aside>no</aside><p>Three &lt;x&gt;</p><form>f</form></article><div id="comments"><p>nice nice nice nice</p></div><script>var t="</p>";</script><footer>f</footer>'
    want = "T & U\nOne two\nThree <x>"
    assert htmlmain.extract(page, w) == want
    assert htmlmain.extract(page.replace("article", "div"), w) == want
    for odd in ("", "<", "<p", "<nav>only", "<article></article>", "<script>x", "<!-- x", "<!-->", "<a href='", "<p class=\"a"):
        assert "\n\n" not in htmlmain.extract(odd, w)
    assert htmlmain.extract("<p>a<!-- c -->b</p>", w) == "ab" and htmlmain.extract("<p>x &amp y &#65;&nbsp;z</p>", w) == "x & y A z"


def test_ngram_filter_comes_in_blocks(spark):
    """What the driver takes is the filter's own bytes, and its words are those of a filter made plainly."""
    from pyspark.sql import functions as F

    from quillon.llm import ngramjoin as N

    bits = 24
    keys = spark.range(20_000).select(F.xxhash64("id").alias("g"))
    g = np.array([r[0] for r in keys.collect()], np.int64)
    want = np.zeros(1 << bits >> 6, np.uint64)
    for p in N._gram_places(g, bits):
        np.bitwise_or.at(want, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
    places = N._gram_columns(F.col("g"), bits)
    assert (N._filter_of(keys, places, bits) == want).all()
    blocks = N._filter_blocks(keys, places, bits).toArrow()
    assert blocks.num_rows == (1 << bits >> 6) // N.BLOCK_WORDS and max(map(len, blocks["bits"].to_pylist())) == 8 * N.BLOCK_WORDS


def test_ngram_keys_packed():
    from quillon.llm import ngramjoin as N

    for width in (4, 5, 6):
        keys = np.unique(np.random.default_rng(width).integers(0, 1 << (8 * width), 5000, np.uint64))
        assert (N._unpacked(N._packed(keys, width), width) == keys).all()
    assert len(N._unpacked(b"", 4)) == 0
