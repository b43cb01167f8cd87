"""Exact Jaccard self-join of documents on word n-grams, by vertical partitioning.

All n-grams stand in one global order: rare ones by hash first, then those found to be
frequent. Two sets that are similar enough must share an n-gram within a short prefix of that
order, and its places in both bound what they can share, so candidate pairs come from prefixes
alone. A candidate's overlap is then counted vertically: the hash range is cut into fragments,
each fragment of the two sets is intersected on its own, and the parts are summed per pair.

Copies cost nothing: texts with one n-gram set are one class, and only classes are joined.
Large groups of near copies cost little: each prefix n-gram first links its members to one
leader, the member with the fewest rare n-grams; after components are known, only members
outside their leader's component are compared with the others of their n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import textkernel as K
from quillon.llm.graph import components
from quillon.llm.runtime import discard, materialize, planned_bytes, release, salted, session, steps, table, text_parts, turn_to

#: An n-gram that stands in FREQUENT texts or more is frequent; the KEPT most frequent are told to all
#: executors (8 MB), by the upper bits of their hash. Any choice gives the same links: it only moves
#: n-grams to the end of the global order.
FREQUENT, KEPT = 10, 1 << 20
#: Ranges of hashes by which texts per n-gram are counted, at least, and one for so many bytes of input, so
#: that what comes together in a range doesn't grow; and n-grams that a task holds at a time.
BUCKETS, BUCKET_BYTES, HELD = 1024, 64 << 20, 2_000_000
#: Bits of the filters by which executors pick n-grams that stand in more prefixes than one, and
#: texts that have candidates: 2 MB at least and 32 MB at most, by the size of the input. Beyond it more passes than
#: need to. Words of a block, in which they come to the driver.
FILTER_BITS = (24, 28)
BLOCK_WORDS = 1 << 12
#: Texts whose copies a task recognises before it shuffles them.
SEEN = 1 << 18
#: Members of one n-gram that are compared by one task.
CROWD = 2000
FRAGMENTS = 8
#: Bits of a hash that make up the ranges whose n-grams are counted for each set, below and from LARGE
#: n-grams: the sum of the smaller counts bounds an overlap.
RANGE_BITS, LARGE = (6, 10), 1500


def _sets(batch: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct n-gram hashes of each text)."""
    for lo, hi in steps(batch):
        buf, offsets = text_parts(batch.slice(lo, hi - lo))
        buf = K.LOWER[buf]
        starts, ends, first = K.word_spans(buf, offsets)
        sh, sf = K.shingles(K.word_hashes(buf, starts, ends), first, k, short=True)
        yield lo, [np.unique(sh[sf[i] : sf[i + 1]]) for i in range(hi - lo)]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(counts.astype(np.uint32), cut) if len(cut) else counts


def _ranges(size: int) -> int:
    """How many ranges of hashes input of so many bytes is counted by: a power of two."""
    return 1 << max(BUCKETS.bit_length() - 1, min(22, (size // BUCKET_BYTES).bit_length()))


def _width(size: int) -> int:
    """Bytes of a hash that n-grams are counted by: enough that few of those of so large an input agree in them."""
    return min(6, max(4, -(-(size.bit_length() + 2) // 8)))


def _upper(s: np.ndarray, width: int) -> np.ndarray:
    return s >> np.uint64(64 - 8 * width)


def _packed(keys: np.ndarray, width: int) -> bytes:
    """Sorted keys by their steps, all lowest bytes first: steps are small, so the upper bytes are zeros, which compress."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _count_texts(k: int, ranges: int, width: int):
    """(bucket, keys, counts): in how many of a task's texts each n-gram stands (255 at most), packed by range of hash."""

    def run(batches):
        turn_to("ngramjoin")
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        held: list[np.ndarray] = []
        size = 0

        def fold():
            new = np.concatenate(held) if held else np.zeros(0, np.uint64)
            u, c = _summed(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.uint8)]))
            return u, np.minimum(c, 255).astype(np.uint8)

        def rows():
            cut = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(2 ** (8 * width) // ranges))
            some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
            for lo in range(0, len(some), 4096):
                part = some[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([_packed(keys[cut[b] : cut[b + 1]], width) for b in part], pa.binary()), pa.array([counts[cut[b] : cut[b + 1]].tobytes() for b in part], pa.binary())], ["b", "keys", "counts"])

        for b in batches:
            for _, sets in _sets(b.column(0), k):
                held += [_upper(s, width) for s in sets]
                size += sum(map(len, sets))
                if size > HELD // 4:
                    keys, counts = fold()
                    held, size = [], 0
                    if len(keys) > HELD:
                        yield from rows()
                        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        keys, counts = fold()
        yield from rows()

    return run


def _frequent(width: int):
    """The frequent n-grams of one range of hashes."""

    def run(group: pa.Table) -> pa.Table:
        turn_to("ngramjoin")
        keys, n = _summed(np.concatenate([_unpacked(raw, width) for raw in group["keys"].to_pylist()]), np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint8))
        hot = n >= FREQUENT
        return pa.table({"g": pa.array(keys[hot].astype(np.int64)), "n": pa.array(n[hot].astype(np.int64))})

    return run


def _prefixes(k: int, percent: int, shared, width: int):
    def run(batches):
        turn_to("ngramjoin")
        frequent = shared.value
        for b in batches:
            n = b.num_rows
            size, cold = np.zeros(n, np.int64), np.zeros(n, np.int64)
            sig: list[bytes | None] = [None] * n
            values, lengths, cuts = [], np.zeros(n + 1, np.int64), [np.zeros(0, np.int32)] * n
            for lo, sets in _sets(b.column(1), k):
                for i, s in enumerate(sets, lo):
                    size[i] = len(s)
                    if not len(s):
                        continue
                    sig[i] = xxhash.xxh3_128_digest(s.tobytes())
                    upper = _upper(s, width)
                    at = np.minimum(np.searchsorted(frequent, upper), max(len(frequent) - 1, 0))
                    hot = frequent[at] == upper if len(frequent) else np.zeros(len(s), bool)
                    cold[i] = len(s) - int(hot.sum())
                    r = RANGE_BITS[len(s) >= LARGE]
                    cuts[i] = np.bincount((s >> np.uint64(64 - r)).astype(np.int64), minlength=1 << r).astype(np.int32)
                    least = -(-percent * len(s) // 100)
                    pre = np.concatenate([s[~hot], s[hot]])[: len(s) - least + 1]
                    values.append(pre.view(np.int64))
                    lengths[i + 1] = len(pre)
            grams = pa.array(np.concatenate(values) if values else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sig, pa.binary()), pa.array(size), pa.array(cold), pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), grams), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cuts)]).astype(np.int32)), pa.array(np.concatenate(cuts)))],
                ["doc_id", "sig", "n", "cold", "prefix", "cuts"],
            )

    return run


def _has(bits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether both places of each key are set in a filter of 64-bit words."""
    one = np.uint64(1)
    return (bits[x >> 6] >> (x & 63).astype(np.uint64) & bits[y >> 6] >> (y & 63).astype(np.uint64) & one).astype(bool)


def _bits(size: int) -> int:
    """Bits of a filter, as a power of two, for input of so many bytes."""
    return min(max(FILTER_BITS[0], (size >> 3).bit_length()), FILTER_BITS[1])


def _gram_places(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    # prefixes hold the lowest hashes of a set, so the uppermost bits tell little
    return g & ((1 << bits) - 1), (g.view(np.uint64) >> np.uint64(26)).astype(np.int64) & ((1 << bits) - 1)


def _gram_columns(g, bits: int):
    return g.bitwiseAND((1 << bits) - 1), F.shiftrightunsigned(g, 26).bitwiseAND((1 << bits) - 1)


def _sig_places(sig: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    keep = (1 << bits) - 1
    return np.array([int.from_bytes(sig[:4], "big") & keep]), np.array([int.from_bytes(sig[4:8], "big") & keep])


def _sig_columns(sig, bits: int):
    return tuple(F.conv(F.hex(F.substring(sig, at, 4)), 16, 10).cast("long").bitwiseAND((1 << bits) - 1) for at in (1, 5))


def _block(group: pa.Table) -> pa.Table:
    """One block of a filter as bytes."""
    out = np.zeros(BLOCK_WORDS, np.uint64)
    out[group["w"].to_numpy() & (BLOCK_WORDS - 1)] = group["bits"].to_numpy().view(np.uint64)
    return pa.table({"block": group["block"][:1], "bits": pa.array([out.tobytes()], pa.binary())})


def _filter_blocks(keys: DataFrame, places, bits: int) -> DataFrame:
    """(block, bits): the filter of the keys with these two places, in blocks of BLOCK_WORDS words; one shuffle."""
    at = keys.select(F.explode(F.array(*places)).alias("p"))
    at = at.select("p", F.shiftright("p", 6 + BLOCK_WORDS.bit_length() - 1).alias("block")).repartition("block")
    words = at.groupBy("block", F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    return words.groupBy("block").applyInArrow(_block, "block long, bits binary")


def _filter_of(keys: DataFrame, places, bits: int) -> np.ndarray:
    """The filter of the keys with these two places. Its words are put together on the executors, so that what comes to
    the driver is no more than the filter itself."""
    out = np.zeros(1 << bits >> 6, np.uint64)
    for batch in _filter_blocks(keys, places, bits).toArrow().to_batches():
        for block, raw in zip(batch["block"].to_pylist(), batch["bits"], strict=True):
            out[block * BLOCK_WORDS : (block + 1) * BLOCK_WORDS] = np.frombuffer(raw.as_buffer(), np.uint64)
    release(keys.sparkSession)
    return out


def _posts(shared):
    """(sig, n, cold, pos, g): the places of prefix n-grams that may stand in other prefixes too; of copies in a task
    those of one, as far as SEEN of its texts are remembered."""

    def run(batches):
        turn_to("ngramjoin")
        bits = shared.value
        seen: set[bytes] = set()
        for b in batches:
            sigs = b.column(0).to_pylist()
            new = []
            for i, sig in enumerate(sigs):
                if sig not in seen:
                    seen.add(sig)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            b = b.take(pa.array(new, pa.int64()))
            lists = b.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            g = lists.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), sizes)
            pos = np.arange(len(g)) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
            hit = np.flatnonzero(_has(bits, *_gram_places(g, len(bits).bit_length() + 5)))
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(pos[hit].astype(np.int32)), pa.array(g[hit])], ["sig", "n", "cold", "pos", "g"])

    return run


def _fragments(k: int, shared, count: int):
    """(sig, frag, grams) of texts whose class may have candidates; each fragment is a range of hashes."""

    def run(batches):
        turn_to("ngramjoin")
        bits = shared.value
        for b in batches:
            sigs, frags, values, lengths = [], [], [], [0]
            for _, sets in _sets(b.column(0), k):
                for s in sets:
                    if not len(s):
                        continue
                    sig = xxhash.xxh3_128_digest(s.tobytes())
                    if _has(bits, *_sig_places(sig, len(bits).bit_length() + 5))[0]:
                        cut = np.searchsorted(s >> np.uint64(61), np.arange(count + 1) * (8 // count)).tolist()
                        for f in range(count):
                            if cut[f + 1] > cut[f]:
                                sigs.append(sig)
                                frags.append(f)
                                values.append(s[cut[f] : cut[f + 1]].view(np.int64))
                                lengths.append(cut[f + 1] - cut[f])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs, pa.binary()), pa.array(frags, pa.int32()), pa.ListArray.from_arrays(pa.array(np.cumsum(lengths).astype(np.int32)), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))],
                ["sig", "frag", "grams"],
            )

    return run


def _needed(a, b, percent: int):
    """Least overlap of two sets of these sizes: 100 * o >= percent * (a + b - o)."""
    return F.ceil((F.lit(percent) * (a + b)).cast("decimal(20,0)") / F.lit(100 + percent))


def _fits(percent: int):
    """Whether the sizes and the places of a shared n-gram (from 0) in both prefixes allow a link, if it
    is the first that the two share: all others then stand after it in both. A pair that links passes
    with its first one, whatever becomes of its later ones."""
    least = _needed(F.col("x.n"), F.col("y.n"), percent)
    small, large = F.least(F.col("x.n"), F.col("y.n")), F.greatest(F.col("x.n"), F.col("y.n"))
    return (small * 100 >= large * percent) & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) >= least)


def _bounded(pairs: DataFrame, bounds: DataFrame, percent: int) -> DataFrame:
    """The pairs that the counts by range don't rule out."""
    pairs = materialize(pairs, "ngram-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    bounds = bounds.groupBy("sig").agg(F.max("cuts").alias("cuts")).join(ids, "sig", "left_semi")
    bounds = materialize(bounds, "ngram-bounds")
    most = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    fits = (F.size("ca") != F.size("cb")) | (most >= _needed(F.col("na"), F.col("nb"), percent))
    one = salted(pairs, bounds.select(F.col("sig").alias("a"), F.col("cuts").alias("ca")), ["a"], F.col("b"))
    two = one.join(bounds.select(F.col("sig").alias("b"), F.col("cuts").alias("cb")), "b")
    out = materialize(two.filter(fits).select("a", "b", "na", "nb"), "ngram-bounded")
    discard(pairs, bounds)
    return out


def _verified(spark: SparkSession, texts: DataFrame, pairs: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose whole sets are similar enough; overlaps are counted by fragment and summed."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sig"))
    known = spark.sparkContext.broadcast(_filter_of(ids, _sig_columns(F.col("sig"), bits), bits))
    frags = texts.mapInArrow(_fragments(k, known, FRAGMENTS), "sig binary, frag int, grams array<long>")
    once = materialize(frags.groupBy("sig", "frag").agg(F.max("grams").alias("grams")), "ngram-sets")
    each = F.array(*[F.lit(f) for f in range(FRAGMENTS)])
    left = once.select(F.col("sig").alias("a"), "frag", F.col("grams").alias("ga"))
    right = once.select(F.col("sig").alias("b"), "frag", F.col("grams").alias("gb"))
    part = salted(pairs.withColumn("frag", F.explode(each)), left, ["a", "frag"], F.col("b")).join(right, ["b", "frag"])
    total = part.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).cast("long").alias("o")).groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    out = materialize(total.filter(F.col("o") * 100 >= (F.col("na") + F.col("nb") - F.col("o")) * percent).select("a", "b"), "ngram-links")
    discard(once)
    known.destroy()
    return out


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """Links texts whose sets of distinct lower-cased (A-Z) k-word n-grams have a Jaccard
    similarity of percent / 100 or more, exactly, and gives each row its component.

    Returns id_col, n_shingles, component_id, class_id for each row of docs, repeated rows
    included. A text of fewer than k words has its whole sequence as one n-gram. Null or empty
    texts have no n-grams, no links and no class; their component is their own id. Null ids are
    kept; a component's id is its smallest non-null one. An empty table gives no rows; other
    columns of docs are ignored. n-grams are compared by 64-bit hashes, sets by 128-bit ones.
    """
    spark = session(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    size = planned_bytes(docs)
    bits, width = _bits(size), _width(size)
    sig_bits = _bits(size >> 5)  # texts are far fewer than n-grams
    frequent = texts.mapInArrow(_count_texts(k, _ranges(size), width), "b int, keys binary, counts binary").groupBy("b").applyInArrow(_frequent(width), "g long, n long")
    top = frequent.orderBy(F.desc("n"), "g").limit(KEPT).select("g").toArrow()["g"].to_numpy()
    shared = spark.sparkContext.broadcast(np.sort(top.astype(np.uint64)))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(rows.mapInArrow(_prefixes(k, percent, shared, width), f"doc_id {kind}, sig binary, n long, cold long, prefix array<long>, cuts array<int>"), "ngram-rows")
    shared.destroy()

    # an n-gram of one prefix links nothing: only those of several are shuffled with their texts
    several = rows.select(F.explode("prefix").alias("g")).groupBy("g").count().filter("count > 1").select("g")
    shared = spark.sparkContext.broadcast(_filter_of(several, _gram_columns(F.col("g"), bits), bits))
    posts = rows.filter("n > 0").select("sig", "n", "cold", "prefix").mapInArrow(_posts(shared), "sig binary, n long, cold long, pos int, g long")
    # one shuffle by n-gram serves to tell copies, to count members and to find the leader: rare n-grams of a set can't
    # link it, so that is the member with the fewest of them
    each = Window.partitionBy("g")
    posts = posts.repartition("g").distinct().withColumn("many", F.count("*").over(each)).withColumn("y", F.min(F.struct("cold", "sig", "n", "pos")).over(each))
    met = materialize(posts.filter("many > 1").select("g", "many", F.struct("sig", "n", "pos").alias("x"), "y"), "ngram-met")
    shared.destroy()
    star = met.filter(F.col("x.sig") != F.col("y.sig")).filter(_fits(percent))
    pairs = star.select(*_pair()).distinct()
    bounds = rows.filter("n > 0").select("sig", "cuts")
    maybe = _bounded(pairs, bounds, percent)
    links = _verified(spark, texts, maybe, k, percent, sig_bits)
    discard(maybe)
    comp = components(links, "ngram-cc")

    # members outside their leader's component against all others of the n-gram
    of = comp.select("node", "comp")
    heads = met.filter("many > 2").select("g", F.col("y.sig").alias("lead")).distinct().join(of.select(F.col("node").alias("lead"), F.col("comp").alias("lead_comp")), "lead", "left")
    heads = heads.select("g", "lead", F.coalesce("lead_comp", "lead").alias("lc"))
    crowd = met.filter("many > 2").select("g", "many", "x", F.col("x.sig").alias("sig")).join(of.withColumnRenamed("node", "sig"), "sig", "left").join(heads, "g")
    # sizes of a link differ by a factor of percent / 100 at most: only neighbouring bands of sizes meet; members of
    # a crowded n-gram are dealt over several tasks, and what they are compared with goes to each of these
    band = F.floor(F.log(F.col("x.n").cast("double")) / float(-np.log(percent / 100 - 1e-9))) if percent < 100 else F.col("x.n")
    crowd = crowd.select("g", "x", F.coalesce("comp", "sig").alias("c"), "lc", (F.col("sig") == F.col("lead")).alias("is_lead"), band.cast("long").alias("band"), F.ceil(F.col("many") / CROWD).alias("ways"))
    crowd = materialize(crowd, "ngram-crowd")
    near = F.sequence(F.col("band") - 1, F.col("band") + 1)
    minor = crowd.filter("c <> lc").select("g", "x", "c", "ways", F.explode(near).alias("band")).select("g", "x", "c", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ways") - 1)).alias("s")).alias("l")
    other = crowd.filter("NOT is_lead").select("g", F.col("x").alias("y"), F.col("c").alias("d"), (F.col("c") == F.col("lc")).alias("major"), "band", F.pmod(F.xxhash64("x.sig"), F.col("ways")).alias("s")).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("g", "band", "s")]
    rest = minor.join(other, same[0] & same[1] & same[2] & (F.col("c") != F.col("d")) & (F.col("major") | (F.col("x.sig") < F.col("y.sig"))) & _fits(percent))
    more = _bounded(rest.select(*_pair()).distinct().join(links, ["a", "b"], "left_anti"), bounds, percent)
    discard(met, crowd)
    if more.limit(1).count():
        first, links = links, materialize(links.union(_verified(spark, texts, more, k, percent, sig_bits)), "ngram-links")
        old, comp = comp, components(links, "ngram-cc")
        discard(first, old)
    discard(more, links)

    least = rows.filter("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least")).join(comp.withColumnRenamed("node", "sig"), "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    name = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = materialize(least.join(name, "comp").select("sig", "component_id"), "ngram-names")
    discard(comp)
    worded = rows.select("doc_id", "sig", F.col("n").alias("n_shingles"))
    out = salted(worded.filter("n_shingles > 0"), named, ["sig"], F.col("doc_id")).unionByName(worded.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.hex("sig").alias("class_id"))


def _pair():
    first = F.col("x.sig") < F.col("y.sig")
    return (F.least("x.sig", "y.sig").alias("a"), F.greatest("x.sig", "y.sig").alias("b"), F.when(first, F.col("x.n")).otherwise(F.col("y.n")).alias("na"), F.when(first, F.col("y.n")).otherwise(F.col("x.n")).alias("nb"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 4-word shingles at 85 percent."""
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
c AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY ALL),
p AS (SELECT rep, n, unnest(sh) AS g FROM c),
o AS (SELECT a.rep AS a, b.rep AS b, count(*) AS o, any_value(a.n) AS na, any_value(b.n) AS nb FROM p a JOIN p b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * o >= 85 * (na + nb - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, comp) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node WHERE r.comp < e.b),
m AS (SELECT node, min(comp) AS comp FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.sh) > 0 AND list_sort(s.sh) = c.sh LEFT JOIN m ON m.node = c.rep
"""
