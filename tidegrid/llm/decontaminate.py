"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

For an item of m words, every window of m words of a document that shares a word shingle with the item gets a
64-bit SimHash of its set of shingles (windows without one cannot be similar at all). A shingle weighs
``ln(1 + items / items that hold it)``; in the bit sums it counts by the square root of that weight, so that the angle
between two sums follows the weighted similarity: at a similarity of 0.8 a bit differs with probability 0.15 at most,
9.7 of 64 on average, whatever the weights are. Fingerprints are compared by multi-index blocks: 64 bits are cut into
radius + 1 blocks, so that two fingerprints within the radius agree on a whole block, which is an equi-join; then the
distance is counted. Pairs within the radius are verified by the exact weighted similarity of their shingle sets:
weight in common over weight in either. A pair right at 0.8 is beyond the radius of 18 in about one case of 1,000.

Windows that overlap are one stretch of a document. A stretch is read once, in order: each shingle enters the sums
where it stands and leaves them where its window or its next copy begins, so that running sums give the sets of all
windows, and work grows with the length of the stretch, not with its square.

A fixed-size bit array of the benchmark's shingles, a literal, passes the documents that can have windows at
all; its false positives only cost work. Work per document grows with its matches. Documents are known by id
and text hash, so repeated rows are judged once and share the result.

Nulls: a null or empty text has no windows; a null id is an id like any other. Null or wordless items match
nothing; items shorter than the shingle are compared as one shingle of their own length. Ties between windows:
highest similarity, then first. Empty tables give no rows. Other columns are not read and cannot clash.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, stage

#: Log2 of the bits of the literal: at most this many, about 64 to a shingle of the benchmark.
MOST_BITS = 23
#: Benchmark shingles up to this number are broadcast; more are joined by shuffles.
BROADCAST_SHINGLES = 1 << 18


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order; none for fewer words."""
    h = lambda i: [F.get(words, i + j) for j in range(k)]
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*h(i)))).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def document_shingles(text: Column, k: int) -> Column:
    return _let(words_of(text), lambda w: shingle_hashes(w, k))


def bit_words(hashes: np.ndarray) -> tuple[Column, int]:
    """(literal array of 64-bit words, log2 of its bits) with three bits set for every hash."""
    bits = min(MOST_BITS, max(10, (64 * max(1, len(hashes))).bit_length()))
    u = hashes.astype(np.int64).view(np.uint64)
    marks = np.zeros(1 << bits, np.uint8)
    for s in (0, 21, 42):
        marks[((u >> np.uint64(s)) & np.uint64((1 << bits) - 1)).astype(np.int64)] = 1
    words = np.packbits(marks, bitorder="little").view("<i8").tolist()
    return F.from_json(F.lit(json.dumps(words, separators=(",", ":"))), "array<bigint>"), bits


def _marked(words: Column, bits: int):
    """Whether a hash has all its three bits set."""

    def one(x: Column, s: int) -> Column:
        p = F.shiftrightunsigned(x, s).bitwiseAND(F.lit((1 << bits) - 1)) if s else x.bitwiseAND(F.lit((1 << bits) - 1))
        # a right shift takes its distance modulo 64
        return F.call_function("shiftrightunsigned", F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return lambda x: one(x, 0) & one(x, 21) & one(x, 42)


def _may_hold(hashes: Column, words: Column, bits: int) -> Column:
    return _let(words, lambda w: F.exists(hashes, _marked(w, bits)))


def _places(hashes: Column, words: Column, bits: int) -> Column:
    """(pos, h) of the hashes that have their bits set."""
    return _let(words, lambda w: F.filter(F.transform(hashes, lambda x, i: F.struct(i.alias("pos"), x.alias("h"))), lambda e: _marked(w, bits)(e["h"])))


def _force(weight: Column) -> Column:
    """What a shingle counts in the bit sums: the square root of its weight, in eighths."""
    return F.round(F.sqrt(weight) * 8).cast("long")


def _bit_sums(force: Column) -> list[Column]:
    """32 terms of which each adds force to two counts, 32 bits apart, where shingle h has the bits."""
    return [(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(0x0000000100000001)) * force).alias(f"c{b}") for b in range(32)]


def _majority() -> Column:
    """The fingerprint of the sums c0 to c31: bit b is set where more than half of the force n has it."""
    fp = F.lit(0).cast("long")
    for b in range(32):
        low, high = F.col(f"c{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"c{b}", 32)
        fp = fp.bitwiseOR(F.when(2 * low > F.col("n"), F.lit(1 << b)).otherwise(F.lit(0).cast("long")))
        top = (1 << (b + 32)) - (1 << 64 if b == 31 else 0)
        fp = fp.bitwiseOR(F.when(2 * high > F.col("n"), F.lit(top).cast("long")).otherwise(F.lit(0).cast("long")))
    return fp


def _stretches(seeds: DataFrame, key: list[str], k: int) -> DataFrame:
    """key, m, size, a, z: runs of window starts a to z around the shared shingles (key, size, pos, m)."""
    last = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("size") - (F.col("m") - k + 1)))  # the shingle inside, within the document
    first = F.least(last, F.greatest(F.lit(0), F.col("pos") - (F.col("m") - k)))
    by = Window.partitionBy(*key, "m").orderBy("pos")
    runs = seeds.withColumn("z", last).withColumn("a", first)
    runs = runs.withColumn("_new", F.coalesce((F.col("a") > F.lag("z").over(by) + 1).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(by))
    return runs.groupBy(*key, "m", "size", "_run").agg(F.min("a").alias("a"), F.max("z").alias("z")).drop("_run")


def _window_prints(stretches: DataFrame, held: DataFrame, weights: DataFrame, unseen: Column, key: list[str], k: int) -> DataFrame:
    """key, m, s, fp of every window of the stretches, by running sums."""
    reach = F.col("m") - k  # places from a window's first shingle to its last
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"d.{c}")) for c in key]
    end = F.least(F.col("z") + reach, F.col("size") - 1)
    read = stretches.alias("w").join(held.alias("d"), same).select("w.*", F.posexplode(F.slice("d.hashes", F.col("a") + 1, end - F.col("a") + 1)).alias("_p", "h"))
    read = read.withColumn("pos", F.col("a") + F.col("_p")).join(weights, "h", "left").withColumn("_force", _force(F.coalesce("weight", unseen)))
    copy = F.lead("pos").over(Window.partitionBy(*key, "m", "a", "h").orderBy("pos"))
    leaves = F.least(F.coalesce(copy, F.col("pos") + reach + 1), F.col("pos") + reach + 1)
    moves = read.withColumn("_out", leaves).select(
        *key, "m", "size", "a", "z", "h", F.explode(F.array(F.struct(F.col("pos").alias("t"), F.col("_force").alias("force")), F.struct(F.col("_out").alias("t"), (-F.col("_force")).alias("force")))).alias("_e")
    )
    moves = moves.select(*key, "m", "size", "a", "z", "h", "_e.t", "_e.force")
    so_far = Window.partitionBy(*key, "m", "a").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = moves.select(*key, "m", "size", "a", "z", "t", "force", F.sum("force").over(so_far).alias("n"), *[F.sum(c).over(so_far).alias(f"c{b}") for b, c in enumerate(_bit_sums(F.col("force")))])
    start = F.greatest(F.col("t") - reach, F.lit(0))
    whole = (F.col("t") - reach).between(F.col("a"), F.col("z")) | ((F.col("size") <= reach) & (F.col("t") == F.col("size") - 1))
    return sums.where((F.col("force") > 0) & whole).select(*key, "m", start.alias("s"), _majority().alias("fp"))


def _item_prints(own: DataFrame, weights: DataFrame) -> DataFrame:
    """_n, item_id, m, item_fp of each item's set of shingles."""
    forced = own.distinct().join(weights, "h").withColumn("force", _force(F.col("weight")))
    sums = forced.groupBy("_n", "item_id", "m").agg(F.sum("force").alias("n"), *[F.sum(c).alias(f"c{b}") for b, c in enumerate(_bit_sums(F.col("force")))])
    return sums.select("_n", "item_id", "m", _majority().alias("item_fp"))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks that cover 64 bits."""
    n = radius + 1
    edges = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _in_blocks(df: DataFrame, radius: int) -> DataFrame:
    """A row per block: its number and value."""
    parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1)).alias("value")) for k, (a, n) in enumerate(_blocks(radius))]
    return df.withColumn("_b", F.explode(F.array(*parts))).select("*", "_b.block", "_b.value").drop("_b")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8, radius: int = 18, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, text_hash, item_id, start_word, n_words, similarity, distance: the best window of each document for each item."""
    text = F.col(text_col).cast("string")
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col).cast("string")).alias("w")).where("size(w) > 0").distinct()
    items = stage(items.select("item_id", F.size("w").alias("m"), F.least(F.size("w"), F.lit(shingle)).alias("k"), "w"), "bench-items")
    total = items.count()
    found = None
    for k in sorted(r["k"] for r in items.select("k").distinct().collect()) or [shingle]:  # at most shingle values
        own = items.where(F.col("k") == k).withColumn("_n", F.monotonically_increasing_id())
        own = stage(own.select("_n", "item_id", "m", F.explode(shingle_hashes(F.col("w"), k)).alias("h")), "bench-shingles")
        weights = own.select("_n", "h").distinct().groupBy("h").agg(F.log1p(F.lit(float(total)) / F.count("*")).alias("weight"))
        n_shingles = own.count()
        near = F.broadcast if n_shingles <= BROADCAST_SHINGLES else (lambda d: d)
        words, bits = bit_words(own.select("h").distinct().toArrow().column("h").to_numpy())  # 8 bytes for each distinct shingle of the benchmark
        rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), document_shingles(text, k).alias("hashes"))
        key = ["doc_id", "text_hash"]
        held = stage(rows.where(_may_hold(F.col("hashes"), words, bits)).dropDuplicates(key), "leak-candidates")
        seeds = held.select(*key, F.size("hashes").alias("size"), F.explode(_places(F.col("hashes"), words, bits)).alias("_e")).select(*key, "size", "_e.*")
        seeds = seeds.join(near(own.select("h", "m").distinct()), "h").select(*key, "size", "pos", "m")
        unseen = F.log1p(F.lit(float(total)))
        same = [F.col(f"w.{c}").eqNullSafe(F.col(f"d.{c}")) for c in key]
        prints = _window_prints(_stretches(seeds, key, k), held, near(weights), unseen, key, k)
        item_prints = _item_prints(own, weights)
        blocks = _in_blocks(item_prints.withColumn("fp", F.col("item_fp")), radius).drop("fp")
        pairs = _in_blocks(prints, radius).join(near(blocks), ["m", "block", "value"])
        distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
        close = stage(pairs.where(distance <= radius).select(*key, "m", "s", "_n", "item_id", distance.alias("distance")).distinct(), "leak-pairs")
        # Exact weighted similarity of the shingle sets.
        rows_ = close.alias("w").join(held.alias("d"), same).select("w.*", F.explode(F.array_distinct(F.slice("d.hashes", F.col("s") + 1, F.col("m") - k + 1))).alias("h"))
        held_by = own.select("_n", "h").distinct().withColumn("both", F.lit(1))
        scored = rows_.join(near(weights), "h", "left").join(near(held_by), ["_n", "h"], "left").withColumn("x", F.coalesce("weight", unseen))
        sums = scored.groupBy(*key, "m", "s", "_n", "item_id", "distance").agg(F.sum("x").alias("window"), F.coalesce(F.sum(F.when(F.col("both") == 1, F.col("x"))), F.lit(0.0)).alias("shared"))
        item_weight = held_by.join(weights, "h").groupBy("_n").agg(F.sum("weight").alias("item_weight"))
        full = sums.join(near(item_weight), "_n").withColumn("similarity", F.round(F.col("shared") / (F.col("window") + F.col("item_weight") - F.col("shared")), 6))
        best = full.where(F.col("similarity") >= threshold).groupBy(*key, "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("neg"), "s", "m", "distance")).alias("b"))
        part = stage(best.select(*key, "item_id", F.col("b.s").alias("start_word"), F.col("b.m").alias("n_words"), (-F.col("b.neg")).alias("similarity"), F.col("b.distance").cast("int").alias("distance")), "leaks")
        discard(held, close, own)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no benchmark item was found."""
    leaks = find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options).select("doc_id", "text_hash").distinct()
    same = leaks["doc_id"].eqNullSafe(docs[id_col]) & (leaks["text_hash"] == F.xxhash64(docs[text_col].cast("string")))
    return docs.join(leaks, same, "left_anti")
