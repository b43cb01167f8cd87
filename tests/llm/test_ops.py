"""Every operator through Spark: odd rows, empty tables, clashing columns, and results against brute force."""

import math
import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillon.llm import bpe, chat, ctw, decontam, htmlmain, langid, licenses, ngramjoin, pii, vafile

#: Nulls, empties, repeats, a long text, and columns whose names operators use inside.
ROWS = [(1, "A b c d e", "en", 9), (1, "A b c d e", "en", 9), (None, "a b c d E", None, 8), (2, None, None, 7), (3, "", "de", 6), (4, "   \n", "de", 5), (5, "x " * 30_000, "en", 4), (6, "é" * 1000, "fr", 3)]
SCHEMA = "doc_id long, text string, lang string, sig long"


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("n", "prefix", "rid", "held_out", "g", "comp", "html", "url", "id", "v"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def train(df):
    return langid.fit(df, F.lit(True))


OPS = {
    "pii": lambda df: pii.find_pii(df, redact=True),
    "bpe": lambda df: bpe.encode_texts(df, keep=True),
    "licenses": licenses.find_licenses,
    "langid": lambda df: langid.identify(df, train(df)),
    "lm": lambda df: ctw.lm_scores(df, F.col("doc_id") == 3),
    "ngrams": ngramjoin.ngram_components,
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_odd_rows(name, odd, none):
    rows = OPS[name](odd).collect()
    assert len(rows) == len(ROWS) and sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert OPS[name](none).count() == 0


def test_odd_values(odd):
    by = {}
    for r in ngramjoin.ngram_components(odd).collect():
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by[1] == [(2, 1), (2, 1)] and by[None] == [(2, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[5] == [(1, 5)]
    lang = {r["doc_id"]: r for r in langid.identify(odd, train(odd)).collect()}
    assert lang[2]["lang_pred"] == lang[3]["lang_pred"] == "und" and lang[2]["rejected"] and lang[6]["lang_pred"] == "fr"
    lm = {r["doc_id"]: r for r in ctw.lm_scores(odd, F.col("doc_id") == 3).collect()}
    assert lm[2]["n_tokens"] == 1 and lm[2]["n_known"] == 1 and lm[3]["held_out"] and all(r["score"] < 0 for r in lm.values())
    assert {r["n_words"] for r in licenses.find_licenses(odd).filter("doc_id = 5").collect()} == {30_000}


def brute_components(texts, k=4, percent=85):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in texts}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            o = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                ra, rb = sorted((root(a), root(b)))
                comp[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_ngram_join_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 6)  # make the order depend on frequency at this size
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 6, 60, 200)))] for _ in range(14)]
    common = [rng.choice(words) for _ in range(25)]
    texts = {}
    for i in range(420):
        w = list(base[rng.randrange(3) if i % 2 else rng.randrange(14)])
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 4, 8))):
            w[rng.randrange(len(w))] = rng.choice((rng.choice(words), f"new{i}"))
        if rng.random() < 0.2:
            w += common
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.ngram_components(df).collect()}
    assert got == brute_components(texts)
    assert len({c for _, c in got.values()}) < 400


def test_components_long_path(spark):
    from quillon.llm.graph import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["comp"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decontamination(spark):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    pages = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) between 300 and 900").orderBy("doc_id").limit(60).collect()]
    rng = random.Random(11)
    docs, want = [], set()
    for i, (item, text) in enumerate(bench):
        w = text.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] += rng.choice(("x", " of"))
        docs.append((i, pages[i % len(pages)] + "\n\n" + "  ".join(w).upper() + " " + pages[(i + 1) % len(pages)]))
        want.add((i, item))
    docs += [(1000 + i, p) for i, p in enumerate(pages)] + [(5000, None), (5001, "")]
    items = spark.createDataFrame([*bench, (9000, None), (9001, "two words"), (9002, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    brute = set()
    for d, t in docs:
        body = decontam.squeeze(t).encode()
        for item, text in bench:
            b = decontam.squeeze(text).encode()
            if decontam.best_place(b, body)[0] * 100 <= 20 * len(b):
                brute.add((d, item))
    assert set(got) <= brute and want <= brute
    assert len(set(got) & brute) >= 0.97 * len(brute)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.contaminated(spark.createDataFrame(docs[:3], "doc_id long, text string"), items.limit(0)).count() == 0


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "Be <|kind|>"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "x"), (2, 0, "system", "only"), (None, 300, "ann", "y"), (None, 5, "ann", "z")]
    got = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("c")).withColumn("speaker", F.lit("c"))).collect()}
    ann = got[1, "ann", 0]
    assert ann["rendered"] == "<|system|>\nBe < |kind|><|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n" and ann["n_turns"] == 3
    a, b = map(int, ann["masks"].split(":"))
    assert ann["rendered"][a:b] == "hi<|end|>"
    assert got[1, "bob", 0]["rendered"].count("<|assistant|>") == 1 and got[1, "unknown", -1]["masks"]
    assert (2, "system", 0) not in got and {p for c, _, p in got if c is None} == {0, 1}
    whole = {(r["conv_id"], r["speaker"]): r for r in chat.joined(chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    r = whole[None, "ann"]
    assert r["n_turns"] == 2 and [r["rendered"][slice(*map(int, m.split(":")))] for m in r["masks"].split(",")] == ["z<|end|>", "y<|end|>"]
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_top_k_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.5, 0.5]), (100, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [nan, 1.0]), (4, None), (5, [inf, 0.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (9, [-2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("score", "id", "v", "d", "b", "qb", "rid", "shift"):
        df = df.withColumn(name, F.lit("c"))
    got = [tuple(r) for r in vafile.top_k(df).orderBy("query_id", "rank").collect()]
    one = 1024 * 1024
    assert got == [(0, 1, 1, one), (0, 2, 1, one), (0, 3, 2, one), (0, 4, 100, one // 2), (0, 5, 100, one // 2), (0, 6, 9, -2 * one), (100, 1, 0, one // 2), (100, 2, 1, one // 2), (100, 3, 1, one // 2), (100, 4, 2, one // 2), (100, 5, 9, -one)]
    assert vafile.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_against_brute_force(spark, monkeypatch):
    """Several blocks of both sides, copies, ties, a huge vector, and more survivors than the first reads."""
    monkeypatch.setattr(vafile, "QUERIES", 4)
    rng = random.Random(6)
    vecs = [(i, [rng.choice((-1, 0, 1)) * rng.random() for _ in range(6)]) for i in range(900)]
    vecs = [(i, [0.5] * 6 if 300 <= i < 400 else [x * 1e6 for x in v] if i == 17 else v) for i, v in vecs]
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in vecs]
    want = []
    for i, q in ints:
        if i % 100 == 0:
            top = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in ints if j != i)[:10]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(top, 1)]
    got = vafile.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_main_text_rows(spark):
    rows = [(1, "u", "<article><p>a b</p></article>"), (1, "u", "<article><p>a b</p></article>"), (None, None, "<nav>x</nav>"), (2, "v", None), (3, "w", "")]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in htmlmain.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("c")).withColumn("h", F.lit(1))).collect()), key=str)
    assert got == sorted([(1, "a b", 3), (1, "a b", 3), (None, "", 0), (2, "", 0), (3, "", 0)], key=str)
    assert htmlmain.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_held_out_accuracy(spark):
    rows = langid.op7_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and sum(r["rejected"] for r in rows) == 0


def test_language_is_that_of_the_nearest_centroid(spark):
    """Cosines of all texts with all centroids, from counts by plain Python; and gibberish is rejected."""
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)
    rng = random.Random(5)
    noise = [(10_000 + i, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(400)), None) for i in range(20)] + [(20_000, "12 34 !?", None)]
    some = docs.select("doc_id", "text", "lang").limit(60).union(spark.createDataFrame(noise, "doc_id long, text string, lang string"))
    texts = {r["doc_id"]: r["text"] for r in some.collect()}

    def counted(text):
        b = [int(langid._FOLD[x]) for x in text.encode()]
        out = np.zeros(langid.DIMS)
        for k in (1, 2, 3):
            for i in range(len(b) - k + 1):
                if any(x != 32 for x in b[i : i + k]):
                    h = k * 0x9E3779B1 & 0xFFFFFFFF
                    for x in b[i : i + k]:
                        h = (h ^ x) * 0x85EBCA6B & 0xFFFFFFFF
                        h ^= h >> 13
                    out[h % langid.DIMS] += 1
        return out

    for r in langid.identify(some, model).collect():
        v = np.log1p(counted(texts[r["doc_id"]])) * model.idf
        cos = model.centres.astype(float) @ (v / max(np.linalg.norm(v), 1e-12))
        if r["doc_id"] < 10_000:
            assert r["lang_pred"] == model.langs[int(cos.argmax())] and r["score"] == pytest.approx(cos.max(), abs=1e-5) and not r["rejected"]
        else:
            assert r["rejected"]
    assert langid.accepted(some, model).filter("doc_id >= 10000").count() == 0


def test_licences_against_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["GNU", "general", "public", "license", "Apache", "cc", "by", "MIT", "x", "licensé", "CC-BY", "mit-license;", "the"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", "license " * 40_000 + "mit license"]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r["doc_id"]: r for r in licenses.find_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        ws = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        places = [(at, label) for p, label in licenses.BASE.items() for at in range(len(ws)) if ws[at : at + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(ws), len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_very_long_texts(spark):
    """Tens of megabytes in a few rows: batches end by bytes, texts are read whole."""
    long = "the cat sat on the mat. " * 400_000  # 9.6 MB
    df = spark.createDataFrame([(i, long + f"mail a{i}@b.org mit license") for i in range(3)], "doc_id long, text string").repartition(1)
    assert {(r["n_email"], r["spans"].split(":")[1]) for r in pii.find_pii(df).collect()} == {(1, str(len(long) + 5))}
    assert {(r["n_words"], r["n_base"]) for r in licenses.find_licenses(df).collect()} == {(400_000 * 6 + 6, 1)}
    assert {r["component_id"] for r in ngramjoin.ngram_components(df).collect()} <= {0, 1, 2}


def test_lm_prefers_what_it_has_seen(spark):
    text = "the cat sat on the mat and the dog sat on the rug " * 20
    df = spark.createDataFrame([(i, text) for i in range(5)] + [(90, text), (91, "".join(random.Random(3).choice("qzxjkvbw") for _ in range(len(text))))], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.lm_scores(df, F.col("doc_id") >= 90).collect()}
    assert got[90] > got[91] * 0.2


def test_lm_joins_give_what_the_tables_give(spark, monkeypatch):
    """Base columns against plain Python; the same scores whether words and contexts are sent or joined."""
    rng = random.Random(9)
    words = ["a", "bb", "the", "The", "é", "日本", "x1", "zq"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(60)] + [(100, None), (101, ""), (102, "unseen the"), (None, "the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 5 == 2
    whole = {str(r[0]): r for r in ctw.lm_scores(df, held).collect()}
    monkeypatch.setattr(ctw, "COMMON", 3)
    monkeypatch.setattr(ctw, "NODES", 4)
    joined = {str(r[0]): r for r in ctw.lm_scores(df, held).collect()}
    fold = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    count = {}
    for i, t in rows:
        if i is None or i % 5 != 2:
            for w in [*fold(t), "<end>"]:
                count[w] = count.get(w, 0) + 1
    total = sum(count.values())
    for i, t in rows:
        a, b, ws = whole[str(i)], joined[str(i)], [*fold(t), "<end>"]
        assert (a["n_tokens"], a["n_known"], a["train_tokens"]) == (b["n_tokens"], b["n_known"], b["train_tokens"]) == (len(ws), sum(w in count for w in ws), total)
        base = sum(math.log10((count.get(w, 0) + 1) / (total + len(count) + 1)) for w in ws)
        assert a["base_score"] == pytest.approx(base) and b["base_score"] == pytest.approx(base)
        assert a["score"] == pytest.approx(b["score"], abs=1e-4)
        assert a["bits_per_byte"] == pytest.approx(-a["score"] * math.log2(10) / (len((t or "").encode()) + 1))


@pytest.mark.parametrize("name", ["op3_chat_format", "op6_topk", "op10_ngram_join"])
def test_sql(name, spark, duck):
    from oracle import check

    from quillon.llm.registry import ORACLES, QUERIES

    assert check(QUERIES[name](spark, SF), ORACLES[name], duck) > 0


def test_pipeline(spark):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["language_id", "ngram_join", "decontamination", "pii", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = C.language(spark, docs, SF)
    assert first.columns == docs.columns and first.count() == len(texts)
    second = C.near_duplicates(spark, first, SF)
    comp = brute_components(texts)
    assert sorted(r["doc_id"] for r in second.select("doc_id").collect()) == sorted({c for _, c in comp.values()}) and set(second.columns) == set(docs.columns)
    third = C.decontaminated(spark, second, SF)
    bench = [decontam.squeeze(r["text"]).encode() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in second.collect() if any(b in decontam.squeeze(r["text"]).encode() for b in bench)}
    left = {r["doc_id"] for r in third.select("doc_id").collect()}
    assert not bad & left and left | bad == {r["doc_id"] for r in second.select("doc_id").collect()}
    fourth = C.without_pii(spark, third, SF)
    assert all(not pii.base_spans(r["text"]) and len(r["text"]) == r["n_chars"] for r in fourth.collect())
    out = C.run(spark, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == left and out.filter("n_tokens <> size(ids)").count() == 0
