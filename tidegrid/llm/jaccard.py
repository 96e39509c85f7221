"""N-gram Jaccard join by vertical partitioning, exact, to connected components.

Sets are distinct word n-grams as 64-bit hashes; documents of equal sets are one class. The global n-gram order
is: rarer n-grams (document frequency below HEAVY) by hash, then the others by hash. It is cut into fragments
by hash range. In each fragment, which holds every posting of its n-grams, pairs of classes get a partial count
of the n-grams they share there; the sums over fragments decide which pairs go on to the exact check.

1. Frequencies: every task sends each fragment its sorted hashes with counts, as two binary columns. Fragments
   answer with two slices of fixed-size Bloom bits: n-grams in two documents or more, and heavy ones. Only these
   bits (a fixed number of MB) go through the driver. False positives cost work and never change results, since
   the order is a function of the n-gram alone.
2. Prefixes: a class with c = ceil(t n) needs c - h light n-grams in common with a partner (h of its n heavy). It
   posts its light n-grams up to the last c - h - l, so that a linked pair shares l or more posted ones; l is a
   tenth of the set, which pairs that merely share a passage do not reach. Light lists are shorter than HEAVY.
3. Classes that are mostly heavy (large groups of near copies) post a prefix of heavy n-grams, too. Their lists
   may be long; each is linked to one pivot at a time, and after two rounds of pivots all pairs that still lie in
   different components are counted and checked, so that no list is multiplied out and components are whole.
4. Verification intersects the sets of the pairs left; components come from star steps.
5. Numbers of links, where wanted: what 3 leaves out are links between mostly heavy classes of one component. These
   classes are dealt to stripes of bounded size, and every two stripes of a component are counted in one task, whose
   answer is a number per class; the pairs themselves are never rows.

Nulls: a null text is an empty set, which links with nothing; rows with a null id link with nothing and have a
null component. Repeated ids and rows: each row is a document; equal texts are one class. Empty tables give no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, fresh_name, lean, mix64, ship, stage
from .components import components

HEAVY = 32
#: Postings of a fragment that are paired at a time.
PIECE = 1 << 18
#: Log2 of the Bloom bits for n-grams of two documents or more, and for heavy ones.
SHARED_BITS, HEAVY_BITS = 26, 23
#: Log2 of the Bloom bits for classes whose sets are wanted.
WANTED_BITS = 24
#: Mean bytes and classes of a stripe, two of which are counted against each other in one task.
STRIPE_BYTES, STRIPE_SETS = 8 << 20, 1024


class Shingler:
    """Sorted distinct hashes of a text's word n-grams; remembers the hashes of about limit words."""

    def __init__(self, size: int, limit: int = 100_000):
        self.size, self.limit, self.known = size, limit, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # bytes: A-Z only, and the six ASCII blanks
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            h = [known[w] for w in words]
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            h = [known[w] for w in words]
        h = np.array(h, np.uint64)
        k = min(self.size, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - k + 1, k, np.uint64)
            for j in range(k):
                out = (out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(32)
        return np.unique(out)


def class_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes(), len(grams)) - (1 << 63)


class Bits:
    """Bloom bits in fragments: a fragment's n-grams set bits in its own slice only."""

    def __init__(self, bits: int, fragments: int, data: np.ndarray | None = None):
        self.slice, self.fragments = (1 << bits) // fragments, fragments
        self.shift = np.uint64(64 - fragments.bit_length() + 1)
        self.data = data if data is not None else np.zeros((1 << bits) // 8, np.uint8)

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = mix64(grams)
        base = (grams >> self.shift) * np.uint64(self.slice) if self.fragments > 1 else np.uint64(0)
        size = np.uint64(self.slice)
        return base + m % size, base + (m >> np.uint64(33)) % size

    def holds(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), bool)
        for p in self.places(grams):
            out &= (self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def slice_of(self, fragment: int, grams: np.ndarray) -> bytes:
        own = np.zeros(self.slice, np.uint8)
        for p in self.places(grams):
            own[p.astype(np.int64) - fragment * self.slice] = 1
        return np.packbits(own, bitorder="little").tobytes()


def fragments_for(spark: SparkSession) -> int:
    """A power of two, about twice the shuffle partitions that the cluster is set to."""
    return 1 << max(5, min(16, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))


def _by_fragment(values: np.ndarray, grams: np.ndarray, shift: np.uint64, fragments: int):
    """Sorted grams cut at fragment borders: (fragment, from, to)."""
    edges = np.searchsorted(grams >> shift, np.arange(fragments + 1, dtype=np.uint64))
    return [(f, int(edges[f]), int(edges[f + 1])) for f in range(fragments) if edges[f] < edges[f + 1]]


def _counts(size: int, fragments: int, flush_at: int = 1 << 20):
    shift = np.uint64(64 - fragments.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, n = Shingler(size), [], 0

        def flush():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = _by_fragment(None, grams, shift, fragments)
            return pa.RecordBatch.from_arrays(
                [pa.array([f for f, _, _ in cut], pa.int32()), pa.array([grams[i:j].tobytes() for _, i, j in cut], pa.binary()), pa.array([np.minimum(counts[i:j], 255).astype(np.uint8).tobytes() for _, i, j in cut], pa.binary())],
                names=["fragment", "grams", "counts"],
            )

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(g := shingles(t))
                n += len(g)
                if n >= flush_at:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    return lean(run)


def _grouped(batches: Iterator[pa.RecordBatch], columns: int):
    """(fragment, lists of values of the other columns) from batches sorted by fragment."""
    at, rows = None, [[] for _ in range(columns)]
    for b in batches:
        for f, *values in zip(*(b.column(k).to_pylist() for k in range(columns + 1)), strict=True):
            if f != at and at is not None:
                yield at, rows
                rows = [[] for _ in range(columns)]
            at = f
            for r, v in zip(rows, values, strict=True):
                r.append(v)
    if at is not None:
        yield at, rows


def _frequent(fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, heavy = Bits(SHARED_BITS, fragments, np.empty(0)), Bits(HEAVY_BITS, fragments, np.empty(0))
        for f, (grams, counts) in _grouped(batches, 2):
            g, c = np.frombuffer(b"".join(grams), np.uint64), np.frombuffer(b"".join(counts), np.uint8)
            order = np.argsort(g, kind="stable")
            g, c = g[order], c[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            df, g = np.add.reduceat(c, first), g[first]
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([shared.slice_of(f, g[df >= 2])], pa.binary()), pa.array([heavy.slice_of(f, g[df >= HEAVY])], pa.binary())], names=["fragment", "shared", "heavy"])

    return lean(run)


def gram_bits(docs: DataFrame, text_col: str, size: int, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bloom bytes of the n-grams in two or more documents, and of the heavy ones; counted over all documents."""
    parts = docs.select(text_col).mapInArrow(_counts(size, fragments), "fragment int, grams binary, counts binary")
    dealt = parts.repartition(fragments, "fragment").sortWithinPartitions("fragment")  # by range, Spark would make all parts twice to sample them
    got = dealt.mapInArrow(_frequent(fragments), "fragment int, shared binary, heavy binary").collect()  # fixed size in all
    shared, heavy = np.zeros((1 << SHARED_BITS) // 8, np.uint8), np.zeros((1 << HEAVY_BITS) // 8, np.uint8)
    for r in got:
        for bits, part in ((shared, r["shared"]), (heavy, r["heavy"])):
            bits[r["fragment"] * len(part) : (r["fragment"] + 1) * len(part)] = np.frombuffer(part, np.uint8)
    return shared, heavy


def prefix(grams: np.ndarray, is_shared: np.ndarray, is_heavy: np.ndarray, num: int, den: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(l, light n-grams in all, posted light, posted heavy); l is 0 for a set that is mostly heavy."""
    n, h = len(grams), int(is_heavy.sum())
    need, more = -(-num * n // den), 1 + n // 10
    light = ~is_heavy
    if need - h >= 1:
        ell = min(need - h, more)
        posted = np.flatnonzero(light)[: n - h - (need - h) + ell]
        return ell, n - h, grams[posted[is_shared[posted]]], grams[:0]
    posted = np.flatnonzero(light)
    heavies = np.flatnonzero(is_heavy)[: n - need + more - (n - h)]
    return 0, n - h, grams[posted[is_shared[posted]]], grams[heavies]


def _signatures(size: int, num: int, den: int, fragments: int, bits, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, heavy = bits.value
        shared, heavy, shingles = Bits(SHARED_BITS, fragments, shared), Bits(HEAVY_BITS, fragments, heavy), Shingler(size)
        for b in batches:
            rows = []
            for t in b.column(at).to_pylist():
                g = shingles(t)
                ell, light, posted, heavies = prefix(g, shared.holds(g), heavy.holds(g), num, den) if len(g) else (1, 0, g, g)
                rows.append((class_of(g), len(g), ell, light, posted.tobytes(), heavies.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            kept = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[*(b.schema.names[i] for i in kept), "cls", "n_shingles", "ell", "light", "posted", "heavies"])

    return lean(run)


_POST = np.dtype([("gram", "<u8"), ("cls", "<i8"), ("n", "<i4"), ("ell", "<i4")])


def _postings(fragments: int, flush_at: int = 1 << 19):
    shift = np.uint64(64 - fragments.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["gram"], kind="stable")]
            cut = _by_fragment(None, rows["gram"], shift, fragments)
            return pa.RecordBatch.from_arrays([pa.array([f for f, _, _ in cut], pa.int32()), pa.array([rows[i:j].tobytes() for _, i, j in cut], pa.binary())], names=["fragment", "posts"])

        for b in batches:
            for cls, size, ell, posted in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                g = np.frombuffer(posted, np.uint64)
                rows = np.empty(len(g), _POST)
                rows["gram"], rows["cls"], rows["n"], rows["ell"] = g, cls, size, ell
                held.append(rows)
                n += len(rows)
                if n >= flush_at:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return lean(run)


def _partial_overlaps(num: int, den: int):
    """Per fragment: pairs of classes with the number of posted n-grams that they share there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (posts,) in _grouped(batches, 1):
            rows = np.frombuffer(b"".join(posts), _POST)
            rows = rows[np.lexsort((rows["cls"], rows["gram"]))]
            borders = np.flatnonzero(np.append(True, rows["gram"][1:] != rows["gram"][:-1])) if len(rows) else np.empty(0, np.int64)
            marks = np.searchsorted(borders, np.arange(0, len(rows), PIECE))
            cuts = np.unique(np.append(borders[marks[marks < len(borders)]], len(rows)))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # whole lists, about PIECE rows at a time
                yield from pairs_of(rows[lo:hi])

    def pairs_of(p: np.ndarray) -> Iterator[pa.RecordBatch]:
        left, right, step = [], [], 1
        at = np.arange(len(p))
        while len(at):  # pairs that stand step rows apart in one list
            at = at[at + step < len(p)]
            at = at[p["gram"][at] == p["gram"][at + step]]
            x, y = p["n"][at].astype(np.int64), p["n"][at + step].astype(np.int64)
            fits = den * np.minimum(x, y) >= num * np.maximum(x, y)
            left.append(at[fits]), right.append(at[fits] + step)
            step += 1
        a, b = p[np.concatenate(left)] if left else p[:0], p[np.concatenate(right)] if right else p[:0]
        if not len(a):
            return
        far = np.int32(1 << 30)
        need = np.minimum(np.where(a["ell"] > 0, a["ell"], far), np.where(b["ell"] > 0, b["ell"], far))
        need = np.where(need == far, 1, need)
        order = np.lexsort((b["cls"], a["cls"]))
        a, b, need = a["cls"][order], b["cls"][order], need[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        counts = np.diff(np.append(first, len(a)))
        for k in range(0, len(first), 1 << 16):
            f, c = first[k : k + (1 << 16)], counts[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(a[f]), pa.array(b[f]), pa.array(c.astype(np.int32)), pa.array(need[f].astype(np.int32))], names=["a", "b", "part", "need"])

    return lean(run)


def _wanted_bits(classes: DataFrame) -> np.ndarray:
    """Bloom bytes of a column cls, made by aggregation; a fixed number of words reaches the driver."""
    size = 1 << WANTED_BITS
    place = lambda s: F.pmod(F.shiftrightunsigned("cls", s), F.lit(size).cast("long"))
    bits = classes.select(F.explode(F.array(place(0), place(30))).alias("p"))
    words = bits.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b")).collect()
    out = np.zeros(size // 32, np.uint32)
    for r in words:
        out[r["w"]] = r["b"]
    return out


def _sets(size: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shingles, mask = wanted.value, Shingler(size), (1 << WANTED_BITS) - 1
        for b in batches:
            cls, grams = [], []
            for t in b.column(0).to_pylist():
                g = shingles(t)
                c = class_of(g)
                u = c & ((1 << 64) - 1)
                if all(int(bits[(p := (u >> s) & mask) >> 5]) >> (p & 31) & 1 for s in (0, 30)):
                    cls.append(c), grams.append(g.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(grams, pa.binary())], names=["cls", "grams"])

    return lean(run)


def _linked(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lean(run)


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, staged."""
    x = pairs.join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("y")), "b")
    both = x.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), "a").select("a", "b", "x", "y")
    return stage(both.mapInArrow(_linked(num, den), "a long, b long"), "verified")


def _stripe_links(num: int, den: int, width: int = 4096):
    """Per two stripes (or one with itself): each class's number of links to classes of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (firsts, seconds, cls, grams) in _grouped(batches, 4):
            cls, sets = np.array(cls, np.int64), [np.frombuffer(x, np.uint64) for x in grams]
            size = np.array([len(x) for x in sets])
            a, b = np.flatnonzero(firsts), np.flatnonzero(seconds)
            if not len(a) or not len(b):
                continue
            owner, (_, column, held) = np.repeat(np.arange(len(sets)), size), np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            several = held >= 2
            owner, column = owner[several[column]], (np.cumsum(several) - 1)[column[several[column]]]
            order = np.argsort(column, kind="stable")
            owner, column = owner[order], column[order]
            both = np.zeros((len(a), len(b)), np.int64)
            for at in range(0, int(several.sum()), width):
                i, j = np.searchsorted(column, (at, at + width))
                has = np.zeros((len(sets), width), np.float32)
                has[owner[i:j], column[i:j] - at] = 1
                both += (has[a] @ has[b].T).astype(np.int64)
            linked = (den * both >= num * (size[a][:, None] + size[b][None, :] - both)) & (cls[a][:, None] != cls[b][None, :])
            own = all(x and y for x, y in zip(firsts, seconds, strict=True))
            found, n = (cls[a], linked.sum(1)) if own else (np.append(cls[a], cls[b]), np.append(linked.sum(1), linked.sum(0)))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["node", "n"])

    return lean(run)


def _degrees(links: DataFrame, roots: DataFrame, heavy: DataFrame, sets: DataFrame, num: int, den: int, fragments: int) -> DataFrame:
    """node, n_links: exact; links between two of the classes heavy are counted by stripes of their components, all others are in links."""
    mark = heavy.select(F.col("cls").alias("_cls"), F.lit(True).alias("_heavy"))
    flagged = links.join(mark.withColumnsRenamed({"_cls": "a", "_heavy": "_x"}), "a", "left").join(mark.withColumnsRenamed({"_cls": "b", "_heavy": "_y"}), "b", "left")
    listed = flagged.where("_x IS NULL OR _y IS NULL").select(F.explode(F.array("a", "b")).alias("node"), F.lit(1).cast("long").alias("n"))
    members = heavy.join(roots.withColumnsRenamed({"node": "cls"}), "cls").join(sets, "cls")
    dealt = members.groupBy("root").agg(F.greatest(F.ceil(F.sum(F.octet_length("grams")) / STRIPE_BYTES), F.ceil(F.count("*") / STRIPE_SETS)).alias("stripes"), F.count("*").alias("k")).where("k > 1")
    own = members.join(dealt, "root").withColumn("own", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("stripes")))
    pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)))
    keyed = pairs.select(F.concat_ws(":", "root", F.least("own", "other"), F.greatest("own", "other")).alias("key"), (F.col("own") <= F.col("other")).alias("first"), (F.col("own") >= F.col("other")).alias("second"), "cls", "grams")
    counted = keyed.repartition(fragments, "key").sortWithinPartitions("key").mapInArrow(_stripe_links(num, den), "node long, n long")
    return stage(listed.unionByName(counted).groupBy("node").agg(F.sum("n").alias("n_links")), "link-counts")


def _heavy_links(lists: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The links that join components among lists (gram, cls, n, ell, light): two rounds of pivots, then every pair of different components.

    Pairs with a light n-gram in common are verified before this; the others can share heavy n-grams at most, so
    their light ones all count as differences. Both bounds that follow are exact and stand in the join. A pivot is the
    class with the fewest light n-grams: the middle of a group of near copies.
    """

    def may_link(n_a, light_a, n_b, light_b):
        most = F.least(n_a - light_a, n_b - light_b)
        return (den * most >= num * (n_a + n_b - most)) & ((light_a + light_b) * (den + num) <= (den - num) * (n_a + n_b))

    for round_ in (1, 2, 3):
        roots = components(links).withColumnsRenamed({"node": "cls", "root": "comp"})
        posts = lists.join(roots, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        mixed = posts.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("light", F.xxhash64("cls", F.lit(round_)).alias("h"), "cls", "n", "comp")).alias("p")).where("lo <> hi")
        if round_ < 3:
            pairs = posts.join(mixed.select("gram", "p"), "gram").where((F.col("comp") != F.col("p.comp")) & may_link(F.col("n"), F.col("light"), F.col("p.n"), F.col("p.light")))
            pairs = pairs.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()
        else:
            # The second bound is that two excesses of light n-grams sum to 0 at most: whoever exceeds the list's least one too far has no partner.
            excess = (F.col("light") * (den + num) - F.col("n") * (den - num)).cast("long")
            least = posts.join(mixed.select("gram"), "gram", "left_semi").groupBy("gram").agg(F.min(excess).alias("least"))
            rest = stage(posts.join(least, "gram").where(excess + F.col("least") <= 0).drop("least"), "heavy-lists")
            x, y = (rest.select(*[F.col(c).alias(f"{c}_{s}") for c in ("gram", "cls", "n", "light", "comp")]) for s in "ab")
            pairs = x.join(y, (F.col("gram_a") == F.col("gram_b")) & (F.col("cls_a") < F.col("cls_b")) & (F.col("comp_a") != F.col("comp_b")) & may_link(F.col("n_a"), F.col("light_a"), F.col("n_b"), F.col("light_b")))
            need = F.greatest(F.lit(1), 1 + F.least("n_a", "n_b").cast("int") / 10 - F.least("light_a", "light_b") - 1)
            pairs = pairs.groupBy(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).agg(F.count("*").alias("shared"), F.min(need).alias("need")).where("shared >= floor(need)").select("a", "b")
        links = stage(links.unionByName(verified(pairs, sets, num, den)), f"links-{round_}")
    return links


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, cls, n_links: den * intersection >= num * union links two documents.

    cls is the class of equal sets; n_links is the exact number of other classes that it links with. Without
    count_links there is no such column, and links that connect no components are not searched for.
    """
    spark = docs.sparkSession
    ship(spark)  # rows hold whole sets, or a task's share of a fragment
    fragments = fragments_for(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    bits = gram_bits(rows, "text", size, fragments)
    signed = rows.mapInArrow(_signatures(size, num, den, fragments, spark.sparkContext.broadcast(bits), 2), "doc_id long, text_hash long, cls long, n_shingles long, ell int, light int, posted binary, heavies binary")
    signed = stage(signed, "signatures")
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = known.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n_shingles", "ell", "light", "posted", "heavies")])
    classes = stage(classes.where("octet_length(posted) > 0 OR octet_length(heavies) > 0"), "classes")

    posts = classes.select("cls", "n_shingles", "ell", "posted").mapInArrow(_postings(fragments), "fragment int, posts binary")
    partial = posts.repartition(fragments, "fragment").sortWithinPartitions("fragment").mapInArrow(_partial_overlaps(num, den), "a long, b long, part int, need int")
    light = stage(partial.groupBy("a", "b").agg(F.sum("part").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b"), "light-pairs")

    def grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = [np.frombuffer(x, np.int64) for x in b.column(4).to_pylist()]
            n = np.array([len(x) for x in g])
            if n.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g)), *(pa.array(np.repeat(b.column(k).to_numpy(zero_copy_only=False), n)) for k in range(4))], names=["gram", "cls", "n", "ell", "light"])

    lists = classes.where("octet_length(heavies) > 0").select("cls", "n_shingles", "ell", "light", "heavies").mapInArrow(grams_of, "gram long, cls long, n long, ell int, light int")
    lists = stage(lists, "heavy-postings")
    several = lists.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1")
    lists_ = stage(lists.join(several, "gram", "left_semi"), "heavy-postings")
    wanted = light.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(lists_.select("cls")).distinct()
    sets = rows.where("doc_id IS NOT NULL").select("text").mapInArrow(_sets(size, spark.sparkContext.broadcast(_wanted_bits(wanted))), "cls long, grams binary")
    sets = stage(sets.groupBy("cls").agg(F.first("grams").alias("grams")), "sets")

    links = verified(light, sets, num, den)
    links = _heavy_links(lists_, links, sets, num, den)
    roots = components(links)
    if count_links:
        degree = _degrees(links, roots, lists_.select("cls").distinct(), sets, num, den, fragments)
    discard(lists, lists_, light, sets, classes)
    lowest = known.groupBy("cls").agg(F.min("doc_id").alias("low"))
    linked = roots.join(lowest, roots.node == lowest.cls).groupBy("root").agg(F.min("low").alias("component"))
    by_class = roots.join(linked, "root").select(F.col("node").alias("cls"), "component")
    by_class = lowest.join(by_class, "cls", "left").select("cls", F.coalesce("component", "low").alias("component"))
    if count_links:
        by_class = by_class.join(degree.withColumnRenamed("node", "cls"), "cls", "left")
    by_class = stage(by_class, "class-components")
    out = signed.select("doc_id", "text_hash", "n_shingles", "cls").join(by_class, "cls", "left")
    alone = F.col("n_shingles") == 0
    n_links = [F.when(alone, 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNull(), None).when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "cls", *n_links)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs without near copies: of each component the lowest (id, text hash) stays, once.

    Rows with an empty set, or a null id, are copies of nothing and all stay. All columns stay, whatever their names.
    """
    groups = jaccard_components(docs, id_col=id_col, text_col=text_col, count_links=False, **options)
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    kept = groups.where(~alone).groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.*")
    kept = stage(kept.withColumn("_once", F.lit(True)).unionByName(groups.where(alone).select("doc_id", "text_hash").distinct().withColumn("_once", F.lit(False))), "kept-documents")
    once, digest = fresh_name(docs, "once"), fresh_name(docs, "digest")
    keyed = docs.withColumn(digest, F.xxhash64(F.col(text_col).cast("string")))
    marks = kept.toDF(*(fresh_name(keyed, c) for c in ("kept_id", "kept_hash")), once)
    same = keyed[id_col].eqNullSafe(marks[marks.columns[0]]) & (keyed[digest] == marks[marks.columns[1]])
    found = keyed.join(marks, same).drop(*marks.columns[:2])
    return found.where(F.col(once)).dropDuplicates([id_col, digest]).unionByName(found.where(~F.col(once))).select(*[f"`{c}`" for c in docs.columns])
