"""The conversation trie, spelling variants and the epsilon grid order join against brute force, with limits small enough
that groups are divided, on odd rows and on hot groups."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from oracle import check
from pyspark.sql import functions as F

from quillon.llm import convtrie, egojoin, spelling
from quillon.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op11_conversation_trie", "op12_spelling_variants", "op13_embedding_dedup"])
def test_sql(name, spark, duck):
    assert check(QUERIES[name](spark, SF), ORACLES[name], duck) > 0


TURNS = "conv_id long, turn long, role string, text string, start string, top string, n string, parent string"


def brute_trie(rows, mix):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), r, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if mix and c % 20 else 0
        base = c - c % 20 if c >= 0 else c + -c % 20
        paths[c] = tuple(own.get(base, [])[:h] + v[h:]) if h else tuple(v)
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    words = lambda x: len([w for w in x.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (words(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if paths[c] == p))).encode()).hexdigest()) for p, m in members.items())


def spark_trie(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)
    got = convtrie.conversation_trie(df, **more).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *list(r)[3:]) for r in got)


def conversations(seed, n=60):
    """Few distinct turns, so that paths share and repeat; one in three has a common start; some are copies, one is long."""
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        length = 40 if c == 7 else rnd.randint(1, 6)
        stem = ["a b", "c", "d e f", "g"] if rnd.random() < 0.35 else []
        path = stem + [rnd.choice(["x", "y z", "", "w\tv"]) for _ in range(length)]
        if c % 11 == 0:
            path = ["copy", "copy two"]
        rows += [(c, t, rnd.choice(["u", "u", None]) if t > 4 else "u", x) for t, x in enumerate(path)]
    return rows


@pytest.mark.parametrize(("limit", "mix"), [(50_000, True), (12, True), (12, False), (1, False)])
def test_trie_of_conversations(spark, limit, mix):
    rows = conversations(limit + mix)
    assert spark_trie(spark, rows, limit=limit, mix=mix) == brute_trie(rows, mix)


def test_trie_on_odd_rows(spark):
    odd = [(1, None, None, None), (1, 0, "u", "x"), (1, 0, "u", "x"), (1, 0, "a", "z"), (None, 1, "u", "x"), (-3, 2, "u", "x " * 20_000), (21, 5, "u", "hi"), (22, 1, "u", "p"), (23, 1, "u", "q")]
    assert spark_trie(spark, odd, mix=True) == brute_trie(odd, True)
    assert spark_trie(spark, odd) == brute_trie(odd, False)
    assert convtrie.conversation_trie(spark.createDataFrame([], TURNS), mix=True).count() == 0


def test_trie_of_copies_is_dealt_out_once(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(9000) for t in range(3)] + [(9000 + c, 0, "u", f"turn {c % 2}") for c in range(40)]
    assert spark_trie(spark, rows, limit=2) == brute_trie(rows, False)


WORDS = "doc_id long, text string, word string, s string, n string"


def brute_words(rows, errors):
    n = Counter()
    for i, text in rows:
        for letter, run in itertools.groupby(text or "", key=lambda c: "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ"):
            if letter:
                w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if errors and h % 31 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = defaultdict(set)
    for a, b in itertools.combinations(n, 2):
        a, b = sorted((a, b), key=len)
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        if len(a) == len(b) and a[i + 1 :] == b[i + 1 :] or len(b) == len(a) + 1 and a[i:] == b[i + 1 :]:
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def spark_words(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], WORDS).repartition(4)
    return sorted(tuple(r) for r in spelling.variants(df, **more).collect())


def misspelt(seed):
    rnd = random.Random(seed)
    letters = "abcé×ÿ"
    stems = ["abcabca", "aaaaaaaa", "caébabÿ", "abcabcabc"] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(7, 12))) for _ in range(6)]
    rows = []
    for i in range(40):
        words = []
        for _ in range(60):
            w = list(rnd.choice(stems))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w) + 1)
                w[at : at + rnd.randrange(2)] = rnd.choice(["", "A", "b", "é", "c"])
            words.append("".join(w))
        rows.append((i, " ".join(words) + "."))
    return rows + [(100 + i, "aaaaaaaaa abcabcabca " * 60) for i in range(20)]


@pytest.mark.parametrize(("limit", "long"), [(10_000, 64), (6, 64), (1, 64), (40, 9), (10_000, 7)])
def test_spelling(spark, limit, long):
    rows = misspelt(limit)
    got = spark_words(spark, rows, errors=True, limit=limit, long=long)
    assert got == brute_words(rows, True) and sum(r[1] is not None for r in got) > 5


def test_trie_pairs_are_found_once():
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(3, 8))) for _ in range(250)})
    got = [tuple(sorted((words[i], words[j]))) for i, j in spelling.trie_pairs(words, 0)]
    near = lambda a, b: any(a[:i] + a[i + 1 :] == b or len(a) == len(b) and a[:i] + a[i + 1 :] == b[:i] + b[i + 1 :] for i in range(len(a)))
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in itertools.combinations(words, 2) if near(a, b) or near(b, a)}


def test_spelling_on_odd_rows(spark):
    long = "é" * 5000
    rows = [(1, None), (2, ""), (None, f"Straßen {long} {long}e"), (None, f"Straßen {long} {long}e"), (3, "12 345 _"), (4, "STRASSEN strassen ÀÉÎabcd àÉÎabcd"), (5, "Straßem " * 3)]
    for long_ in (64, 7):
        assert spark_words(spark, rows, long=long_) == brute_words(rows, False)
    assert spelling.variants(spark.createDataFrame([], WORDS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, id string, b string, o string"


def brute_links(rows, least):
    links, up = [0] * len(rows), list(range(len(rows)))
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    find = lambda i: i if up[i] == i else find(up[i])
    v = [np.array(r[1], np.float32).astype(float) if o else None for r, o in zip(rows, ok, strict=True)]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= least:
            links[i] += 1
            links[j] += 1
            up[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return sorted(map(str, ((r[0], links[i], low.get(find(i)), r[0] == low.get(find(i))) for i, r in enumerate(rows))))


def vectors(seed, n=400, d=12):
    """Clusters of copies and near copies, one of them a third of all."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(30, d))
    rows = []
    for i in range(n):
        c = centres[0 if i % 3 == 0 else rnd.integers(1, 30)]
        x = c if i % 7 == 0 else c + rnd.normal(size=d) * rnd.choice([0.05, 0.3, 0.5])
        rows.append((i, [float(np.float32(e)) for e in x * rnd.choice([1, 3])], int(i % 2)))
    return rows


def spark_links(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], VECTORS).repartition(3)
    return sorted(str(tuple(r)) for r in egojoin.near_duplicates(df, **more).collect())


@pytest.mark.parametrize(("block", "parts"), [(1024, 8), (16, 2), (8, 4)])
def test_grid_order_join(spark, monkeypatch, block, parts):
    monkeypatch.setattr(egojoin, "BLOCK", block)
    monkeypatch.setattr(egojoin, "PARTS", parts)
    rows = vectors(block)
    assert spark_links(spark, rows) == brute_links(rows, 0.93)


def test_grid_order_join_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (None, [1.0, 0.1], 0), (3, [1.0, 0.0], None), (4, [1.0, 0.0], 1), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0)]
    rows += [(8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [None, 1.0], 0), (11, [1.0, 0.0, 0.0], 0), (None, [0.0, 1.0], 0), (12, [1e-30, 0.0], 0), (13, [3e38, 1e38], 1)]
    assert spark_links(spark, rows) == brute_links(rows, 0.93)
    assert egojoin.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_distant_blocks_are_skipped_and_no_link_is():
    rnd = np.random.default_rng(3)
    x = egojoin.unit(np.concatenate([rnd.normal(size=(1, 8)) + 0.2 * rnd.normal(size=(100, 8)) for _ in range(12)]))
    p = x[np.lexsort(x.T[::-1])]
    side = float(np.sqrt(2 - 2 * 0.93))
    met = list(egojoin.near_intervals(p, None, side))
    leaves = sum(1 for lo1, _, lo2, _ in met if lo1 == lo2)
    every = leaves * (leaves + 1) / 2
    assert len(met) < 0.8 * every
    total, tree = egojoin.join_blocks(p, p, np.ones(len(p), np.int64), None, None, None, 0.93)
    assert (total == (p @ p.T >= 0.93).sum(axis=1) - 1).all() and len(tree) < len(p)
