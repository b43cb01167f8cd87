"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary choices; each choice has one context tree per choice prefix, whose nodes
are the 0 to DEPTH bytes before. A node holds a Krichevsky-Trofimov estimate of its own counts,
and its weighted probability is half its estimate and half the product of its children's. With
the counts of a whole corpus the weights are computed bottom-up at once, and the predictive
probability of a byte is the posterior mixture along its context path, over all depths.

Every context that occurs in training has its own node. The NODES most frequent deepest ones, whose byte
probabilities are ready in a table, and COMMON words are sent to every executor; those of all other contexts, and
the counts of all other words, are joined to the places that need them, so the bounds move work and
no result. A context that never occurred has an empty node below its parent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import textkernel as K
from quillon.llm.runtime import materialize, session, steps, table, text_parts, turn_to

DEPTH = 3
#: Deepest contexts whose byte probabilities are sent to every executor: at most 64 MB of float32. Others are joined.
NODES = 1 << 16
#: Words whose counts are sent to every executor: 2 MB.
COMMON = 1 << 17
#: Never a byte of UTF-8: stands before a text's start and ends it.
END = 0xFF


def gram_codes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: its DEPTH bytes before and itself as 32 bits; first[] of texts."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    size = lengths + DEPTH + 1
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(at[-1]), END, np.uint8)
    shift = np.repeat(at[:-1] + DEPTH - offsets[:-1], lengths)
    out[np.arange(len(buf)) + shift] = buf
    wide = out.astype(np.uint32)
    codes = wide[DEPTH:].copy()
    for j in range(1, DEPTH + 1):
        codes |= wide[DEPTH - j : len(wide) - j] << np.uint32(8 * j)
    keep = np.ones(len(codes), bool)
    if n > 1:
        drop = (at[1:-1, None] - DEPTH + np.arange(DEPTH)).ravel()
        keep[drop] = False
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    return codes[keep], first


def _fold(store: tuple[np.ndarray, np.ndarray], more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new = np.sort(np.concatenate(more))
    cut = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1]))) if len(new) else np.zeros(0, np.int64)
    keys, counts = np.concatenate([store[0], new[cut]]), np.concatenate([store[1], np.diff(np.append(cut, len(new)))])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(counts, cut) if len(cut) else counts


def _count(batches):
    """(kind, key, n): kind 0 words by hash, 1 byte grams, 2 texts; summed within the task."""
    empty = {0: (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 1: (np.zeros(0, np.uint32), np.zeros(0, np.int64))}
    store, held, size, texts = dict(empty), {0: [], 1: []}, 0, 0

    def rows(kind, keys, counts):
        for i in range(0, len(keys), 65536):
            k = keys[i : i + 65536].astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(counts[i : i + 65536])], ["kind", "key", "n"])

    for b in batches:
        texts += b.num_rows
        for lo, hi in steps(b.column(0)):
            buf, offsets = text_parts(b.column(0).slice(lo, hi - lo))
            buf = K.LOWER[buf]
            starts, ends, _ = K.word_spans(buf, offsets)
            held[0].append(K.word_hashes(buf, starts, ends))
            held[1].append(gram_codes(buf, offsets)[0])
            size += len(buf)
            if size > 1 << 21:
                for k in (0, 1):
                    store[k] = _fold(store[k], held[k])
                held, size = {0: [], 1: []}, 0
                for k in (0, 1):
                    if len(store[k][0]) > 500_000:
                        yield from rows(k, *store[k])
                        store[k] = empty[k]
    for k in (0, 1):
        if held[k]:
            store[k] = _fold(store[k], held[k])
        yield from rows(k, *store[k])
    if texts:
        yield from rows(2, np.zeros(1, np.uint64), np.array([texts]))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series from x + 8."""
    x = np.asarray(x, np.float64)
    low = np.zeros_like(x)
    for j in range(8):
        low += np.log(x + j)
    y = x + 8
    inv = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y - low


def _choices(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n0, n1 of the 255 binary choices (places 1 to 255) of rows of 256 byte counts."""
    n0, n1 = np.zeros(counts.shape), np.zeros(counts.shape)
    for j in range(8):
        halves = counts.reshape(len(counts), 1 << j, 2, 1 << (7 - j)).sum(-1)
        n0[:, 1 << j : 2 << j], n1[:, 1 << j : 2 << j] = halves[:, :, 0], halves[:, :, 1]
    return n0, n1


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - 2 * _lgamma(np.array(0.5)) - _lgamma(n0 + n1 + 1)


def _byte_logs(one: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from those of a 1 at each of the 255 choices."""
    out = np.zeros(one.shape, np.float64)
    sym = np.arange(256)
    for j in range(8):
        node, bit = (1 << j) | (sym >> (8 - j)), (sym >> (7 - j)) & 1
        p = one[:, node]
        out += np.log10(np.where(bit == 1, p, 1 - p))
    return out.astype(np.float32)


def _dense(ctx: np.ndarray, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct contexts in order, and their 256 byte counts as rows."""
    u, i = np.unique(ctx, return_inverse=True)
    c = np.zeros((len(u), 256))
    np.add.at(c, (i, sym), n)
    return u, c


def _below(group: pa.Table) -> pa.Table:
    """Of the deepest contexts below one of two bytes, the sum of their log estimates, and their counts in all."""
    ctx = group["ctx"].to_numpy()
    total, counts = np.zeros((1, 256)), np.zeros((1, 256))
    _, c = _dense(ctx, group["sym"].to_numpy(), group["n"].to_numpy())
    for lo in range(0, len(c), 64):
        total += _log_kt(*_choices(c[lo : lo + 64])).sum(0)
        counts += c[lo : lo + 64].sum(0)
    return pa.table({"ctx": [int(ctx[0]) & 0xFFFF], "below": pa.array([total[0].tolist()], pa.list_(pa.float64())), "counts": pa.array([counts[0].tolist()], pa.list_(pa.float64()))})


class Paths:
    """The contexts of two bytes: for each binary choice, what the path down to there gives, and the share
    that is left for the node below. One more row stands for contexts that lack one."""

    def __init__(self, ctx: np.ndarray, counts: np.ndarray, below: np.ndarray):
        half = np.log(0.5)

        def weigh(counts, children):
            n0, n1 = _choices(counts)
            own = _log_kt(n0, n1)
            total = half + np.logaddexp(own, children)
            return total, np.exp(half + own - total), (n1 + 0.5) / (n0 + n1 + 1)

        order = np.argsort(ctx)
        ctx2, c2 = np.asarray(ctx, np.int64)[order], counts.reshape(-1, 256)[order]
        l2, b2, k2 = weigh(c2, below.reshape(-1, 256)[order])
        ctx1, i1 = np.unique(ctx2 & 0xFF, return_inverse=True)
        c1, s1 = np.zeros((len(ctx1), 256)), np.zeros((len(ctx1), 256))
        np.add.at(c1, i1, c2)
        np.add.at(s1, i1, l2)
        l1, b1, k1 = weigh(c1, s1)
        _, b0, k0 = weigh(c1.sum(0, keepdims=True), l1.sum(0, keepdims=True))
        f0, r0 = b0 * k0, 1 - b0
        f1, r1 = f0 + r0 * b1 * k1, r0 * (1 - b1)
        self.first, self.left = f1[i1] + r1[i1] * b2 * k2, r1[i1] * (1 - b2)
        self.ctx1, self.ctx2 = ctx1, ctx2
        #: Where nothing stands below a path its node is empty and says 1/2.
        self.short = np.concatenate([_byte_logs(f0 + r0 * 0.5), _byte_logs(f1 + r1 * 0.5), _byte_logs(self.first + self.left * 0.5)])

    def logs(self, ctx: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 byte probabilities of deepest contexts (3 bytes as an int) with these counts."""
        out = []
        for lo in range(0, len(ctx), 1024):
            p = np.searchsorted(self.ctx2, ctx[lo : lo + 1024] & 0xFFFF)
            n0, n1 = _choices(counts[lo : lo + 1024])
            out.append(_byte_logs(self.first[p] + self.left[p] * (n1 + 0.5) / (n0 + n1 + 1)))
        return np.concatenate(out) if out else np.zeros((0, 256), np.float32)


class Tree:
    """The frozen model as executors have it: log10 byte probabilities of the kept deepest contexts, and of
    contexts that never occurred; rare ones are known by a bit each, and left to a join."""

    def __init__(self, paths: Paths, ctx3: np.ndarray, logs3: np.ndarray, rare: np.ndarray):
        self.logs = np.concatenate([paths.short, logs3])
        self.ctx1, self.ctx2, self.ctx3 = paths.ctx1, paths.ctx2, ctx3
        self.rare = np.packbits(np.bincount(rare, minlength=1 << 24).astype(bool)) if len(rare) else None

    def rows(self) -> np.ndarray:
        """The row of logs for each of the 2**24 contexts; -1 for rare ones."""
        if getattr(self, "_rows", None) is None:
            r1 = np.zeros(256, np.int32)
            r1[self.ctx1] = 1 + np.arange(len(self.ctx1))
            r2 = np.tile(r1, 256)
            r2[self.ctx2] = 1 + len(self.ctx1) + np.arange(len(self.ctx2))
            r3 = np.tile(r2, 256)
            r3[self.ctx3] = 1 + len(self.ctx1) + len(self.ctx2) + np.arange(len(self.ctx3))
            if self.rare is not None:
                r3[np.unpackbits(self.rare).astype(bool)] = -1
            self._rows = r3
        return self._rows

    def score(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each gram's last byte after the others (0 for rare contexts), and which are rare."""
        row = self.rows()[codes >> np.uint32(8)]
        rare = np.flatnonzero(row < 0) if self.rare is not None else np.zeros(0, np.int64)
        out = self.logs[row, codes & np.uint32(0xFF)]
        out[rare] = 0
        return out, rare

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_rows"}


def _rare_logs(paths_b):
    """(ctx, logs) of rare contexts, for the join."""

    def run(group: pa.Table) -> pa.Table:
        turn_to("ctw")
        ctx, c = _dense(group["ctx"].to_numpy(), group["sym"].to_numpy(), group["n"].to_numpy())
        return pa.table({"ctx": pa.array(ctx, pa.int64()), "logs": pa.array(paths_b.value.logs(ctx, c).tolist(), pa.list_(pa.float32()))})

    return run


def _score(tree_b, common_b):
    def run(batches):
        tree, (keys, logs) = tree_b.value, common_b.value
        turn_to("ctw", lambda: tree.__dict__.pop("_rows", None))
        at0, i = TaskContext.get().partitionId() << 36, 0
        for b in batches:
            n = b.num_rows
            tokens, known, base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            tails, lengths = [], [0]
            far, far_lengths, size = [], [0], np.zeros(n, np.int64)
            for lo, hi in steps(b.column(2)):
                buf, offsets = text_parts(b.column(2).slice(lo, hi - lo))
                buf = K.LOWER[buf]
                starts, ends, first = K.word_spans(buf, offsets)
                h = K.word_hashes(buf, starts, ends)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                text = np.repeat(np.arange(hi - lo), np.diff(first))
                hits = np.concatenate(([0], np.cumsum(hit)))
                tokens[lo:hi] = np.diff(first) + 1
                known[lo:hi] = np.diff(hits[first])
                base[lo:hi] = np.bincount(text[hit], weights=logs[at[hit]], minlength=hi - lo) if hit.any() else 0.0
                tails.append(h[~hit].view(np.int64))
                lengths += (lengths[-1] + np.cumsum(np.diff(first) - np.diff(hits[first]))).tolist()
                codes, cf = gram_codes(buf, offsets)
                got, rare = tree.score(codes)
                score[lo:hi] = np.add.reduceat(got.astype(np.float64), cf[:-1])
                size[lo:hi] = np.diff(cf)
                far.append(codes[rare].astype(np.int64))
                far_lengths += (far_lengths[-1] + np.searchsorted(rare, cf[1:])).tolist()
            tail = pa.ListArray.from_arrays(pa.array(np.array(lengths, np.int32)), pa.array(np.concatenate(tails) if tails else np.zeros(0, np.int64)))
            grams = pa.ListArray.from_arrays(pa.array(np.array(far_lengths, np.int32)), pa.array(np.concatenate(far) if far else np.zeros(0, np.int64)))
            rid = pa.array(at0 + np.arange(i, i + n))
            i += n
            yield pa.RecordBatch.from_arrays([rid, b.column(0), b.column(1), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), pa.array(size), tail, grams], ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "size", "tail", "grams"])

    return run


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    t = df.toArrow()
    return [t[c].to_numpy() for c in names]


def lm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every text with a model learnt from the rows where held_out (a column) isn't true.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram,
    log10), score (the tree's log10 probability of the text's lower-cased bytes and its end) and
    bits_per_byte (its code length, the end counted as a byte). Null texts are empty: one token, the end. No
    training rows: every estimate starts from no counts. Null ids and repeated rows are kept as they are; ties
    between equally frequent contexts or words only decide which are joined; an empty table gives
    no rows; other columns are ignored. Long texts are read whole, in steps. Words are counted by 64-bit hashes.
    """
    spark = session(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counted = rows.filter("NOT held_out").select("text").mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "lm-counts")
    words = counted.filter("kind = 0").select("key", "n")
    got = {r["kind"]: (r["n"], r["keys"]) for r in counted.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("keys")).collect()}
    texts = got.get(2, (0, 0))[0]
    total, distinct = got.get(0, (0, 0))[0] + texts, got.get(0, (0, 0))[1] + (texts > 0)

    common = words.orderBy(F.desc("n"), "key").limit(COMMON)
    keys, n = _columns(common, "key", "n")
    least = (int(n[-1]), int(keys[-1])) if len(n) == COMMON else None
    order = np.argsort(keys.astype(np.int64).view(np.uint64))
    common_b = spark.sparkContext.broadcast((keys.astype(np.int64).view(np.uint64)[order], np.log10(n[order] + 1.0)))

    grams = counted.filter("kind = 1").select(F.shiftright("key", 8).alias("ctx"), F.col("key").bitwiseAND(255).cast("int").alias("sym"), "n")
    # a group is what stands below two bytes: 65,536 rows at most, and as many groups
    mid = grams.groupBy(F.col("ctx").bitwiseAND(0xFFFF).alias("mid")).applyInArrow(_below, "ctx long, below array<double>, counts array<double>").toArrow()
    flat = lambda c: mid[c].combine_chunks().flatten().to_numpy() if mid.num_rows else np.zeros(0)
    paths = Paths(mid["ctx"].to_numpy(), flat("counts"), flat("below"))
    seen = grams.groupBy("ctx").agg(F.sum("n").alias("m"))
    kept = seen.orderBy(F.desc("m"), "ctx").limit(NODES).select("ctx")
    ctx3, counts3 = _dense(*_columns(grams.join(F.broadcast(kept), "ctx", "left_semi"), "ctx", "sym", "n"))
    # at most 2**24 contexts, one bit of each is sent
    rare = np.setdiff1d(_columns(seen.select("ctx"), "ctx")[0], ctx3) if len(ctx3) >= NODES else np.zeros(0, np.int64)
    tree_b = spark.sparkContext.broadcast(Tree(paths, ctx3, paths.logs(ctx3, counts3), rare))

    scored = materialize(rows.mapInArrow(_score(tree_b, common_b), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, size long, tail array<long>, grams array<long>"), "lm-scored")
    if least:
        less = words.filter((F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("key") > least[1])))
        tail = scored.select("rid", F.explode("tail").alias("key")).join(less, "key").groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("add"))
        scored = scored.drop("tail").join(tail, "rid", "left")
    else:
        scored = scored.withColumns({"more": F.lit(0).cast("long"), "add": F.lit(0.0)})
    if len(rare):
        far = grams.join(F.broadcast(kept), "ctx", "left_anti").groupBy(F.shiftright("ctx", 4).alias("part")).applyInArrow(_rare_logs(spark.sparkContext.broadcast(paths)), "ctx long, logs array<float>")
        asked = scored.select("rid", F.explode("grams").alias("gram")).groupBy("rid", "gram").agg(F.count("*").alias("c")).withColumn("ctx", F.shiftright("gram", 8))
        found = asked.join(far, "ctx").groupBy("rid").agg(F.sum(F.col("c") * F.element_at("logs", F.col("gram").bitwiseAND(255).cast("int") + 1).cast("double")).alias("rest"))
        scored = scored.drop("grams").join(found, "rid", "left").withColumn("score", F.col("score") + F.coalesce("rest", F.lit(0.0)))
    end = float(np.log10(texts + 1.0))
    return scored.select(
        F.col("doc_id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("add", F.lit(0.0)) + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1.0)))).alias("base_score"),
        F.col("score"),
        (F.col("score") * F.lit(-float(np.log2(10.0))) / F.col("size")).alias("bits_per_byte"),
    )


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of those whose crc32 of the id modulo 7 isn't 2."""
    docs = table(spark, sf_dir, "documents")
    return lm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
