"""Jaccard components and benchmark leaks against brute force; the classifier on held-out rows; the pipeline."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import decontaminate, jaccard, quality
from tidegrid.llm.components import components

WORDS = [f"w{i}" for i in range(400)]


def corpus():
    rng = random.Random(5)
    base = [[rng.choice(WORDS) for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(25)]
    passage = [rng.choice(WORDS) for _ in range(60)]
    rows = []
    for b in base:
        for _ in range(rng.choice([1, 1, 2, 6])):
            c = list(b)
            for _ in range(rng.choice([0, 1, 2])):
                c[rng.randrange(len(c))] = rng.choice(WORDS)
            rows.append(" ".join(c).replace("w1", rng.choice(["w1", "W1"])))
    for _ in range(40):  # a common passage in unlike documents
        rows.append(" ".join([*passage, *(rng.choice(WORDS) for _ in range(30))]))
    big = [rng.choice(WORDS) for _ in range(150)]
    for _ in range(60):  # a large group of near copies, each with own edits
        c = list(big)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            c[rng.randrange(150)] = rng.choice(WORDS)
        rows.append("\t".join(c) + "\n")
    rows += [None, "", "  \n", "one", "One", "ONE two", "\u00a0", "É é", "é é", rows[3], rows[3]]
    return [(i * 3, t, "x", i) for i, t in enumerate(rows)]


def brute(rows, k, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,num,heavy", [(4, 85, 32), (4, 85, 4), (5, 80, 3)])
def test_components_are_brute_force(spark, monkeypatch, k, num, heavy):
    rows = corpus()
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, n_shingles int").repartition(6)
    monkeypatch.setattr(jaccard, "_frequent", _with_heavy(jaccard._frequent, heavy))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, k, num, 100).collect()}
    assert got == brute(rows, k, num, 100)


def _with_heavy(make, heavy):
    """The executors' copy of the module takes the test's bound, too."""

    def made(fragments):
        run = make(fragments)

        def on_executor(batches):
            from tidegrid.llm import jaccard as there

            there.HEAVY = heavy
            yield from run(batches)

        return on_executor

    return made


def test_one_of_each_and_odd_rows(spark):
    rows = [(1, "a b c d e f g", "p"), (2, "a b c d e f g", "q"), (2, "something else entirely in here now", "r"), (None, "a b c d e f g", "n"), (3, None, "s"), (3, None, "s"), (4, "", "t"), (5, "x y z u v w", "u"), (5, "x y z u v w", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    kept = sorted((str(r["doc_id"]), str(r["text"])[:9]) for r in jaccard.one_of_each(df).collect())
    assert kept == sorted([("1", "a b c d e"), ("2", "something"), ("None", "a b c d e"), ("3", "None"), ("3", "None"), ("4", ""), ("5", "x y z u v")])
    assert jaccard.jaccard_components(df.limit(0)).count() == 0 and jaccard.one_of_each(df.limit(0)).columns == df.columns


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 300: 100}


def leaks_by_brute_force(docs, items, radius_free=True, k=5, threshold=0.8):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w, k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    parts = {i: (cut(t), min(k, len(cut(t)))) for i, t in items if cut(t)}
    held = Counter(g for w, kk in parts.values() for g in set(grams(w, kk)))
    weight = lambda g: math.log1p(len(parts) / held[g] if g in held else len(parts))
    out = set()
    for d, t in docs:
        w = cut(t)
        for i, (own, kk) in parts.items():
            a, m = set(grams(own, kk)), len(own)
            if a.isdisjoint(grams(w, kk)):
                continue
            for s in range(max(1, len(w) - m + 1)):
                b = set(grams(w[s : s + m], kk))
                both = sum(map(weight, a & b))
                if both and round(both / (sum(map(weight, a | b))), 6) >= threshold:
                    out.add((d, i))
    return out


def test_leaks(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((30, 45, 16, 60, 8))] + [(5, "only three words"), (6, None), (7, ""), (8, "?!")]
    changed = items[3][1].split()
    changed[59] = "zzz"
    docs = [(1, f"{text(40)} {items[0][1]} {text(10)}"), (2, items[1][1].upper().replace(" ", ",  ")), (3, " ".join(changed)), (4, text(200)), (5, " ".join(items[3][1].split()[:30])), (6, None), (7, ""), (8, "it is only three words long"), (9, "only three")]
    docs += [(1, docs[0][1]), (None, f"{items[2][1]} {items[4][1]}")]
    df = spark.createDataFrame([(d, t, "h") for d, t in docs], "doc_id long, text string, text_hash string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == leaks_by_brute_force(docs, items) and (1, 0) in got and (3, 3) in got and (8, 5) in got and (5, 3) not in got
    assert sorted(str(r["doc_id"]) for r in decontaminate.without_leaks(df, bench).collect()) == sorted(["4", "5", "6", "7", "9"])
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(4)
    blocks = decontaminate._blocks(16)
    assert sum(n for _, n in blocks) == 64 and len(blocks) == 17
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 16):
            y ^= 1 << b
        assert any((x >> a) & ((1 << n) - 1) == (y >> a) & ((1 << n) - 1) for a, n in blocks)


def test_leaks_of_shared_templates(spark):
    """Items that share two templates, asked under the other one: all exact similarities are near 0.8 or above."""
    rng = random.Random(11)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    templates = [text(60), text(60)]
    items, docs = [], []
    for i in range(120):
        own = text(240)
        items.append((i, " ".join([*templates[i % 2], *own])))
        docs.append((i, " ".join([*templates[1 - i % 2], *own])))
    light = text(100)  # an item of light shingles only, with heavy changes
    items += [(1000 + j, " ".join([*light, *text(j)])) for j in range(40)]
    for j in range(60):
        c = list(light)
        for _ in range(rng.choice([0, 1, 2])):
            c[rng.randrange(100)] = "changed"
        docs.append((1000 + j, " ".join([*text(30), *c, *text(30)])))
    want = leaks_by_brute_force(docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 150 and len(got) >= 0.99 * len(want)


def test_quality(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["the", "river", "flows", "slowly", "toward", "green", "hills", "and", "rests"]) for _ in range(60))
    bad = lambda: " ".join([w for w in rng.sample(WORDS, 5) for _ in range(12)])
    rows = [(i, good() if i % 3 else bad(), 0.5, i) for i in range(600)] + [(1000, None, 0.1, 1), (1001, "", 0.1, 1), (None, good(), 0.1, 1), (1, rows_text := good(), 0.1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, n int")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(2, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score_quality(docs, model)
    assert got.columns == ["doc_id", "text", "n", "score", "predicted"] and got.count() == len(rows) and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    held = got.where((F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & (F.col("doc_id") < 600)).select((F.col("predicted") == (F.col("doc_id") % 3 > 0).cast("int")).cast("int").alias("ok"))
    assert held.agg(F.avg("ok")).first()[0] > 0.97
    again = quality.fit(docs.repartition(5), labels)
    assert again.bias == model.bias
    alone = quality.fit(docs, labels.where("quality = 1"))
    assert alone.bias > 0 and not alone.value.any()
    assert quality.score_quality(docs.limit(0), model).count() == 0 and rows_text
    assert quality.fit(docs, labels.limit(0)).bias == 0.0


def test_scores_are_those_of_a_plain_forward_pass(spark):
    """Word by word in plain Python: mean of each kind of feature's numbers, then the logistic."""
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    base, pair = int(quality.BASE), int(quality.PAIR)
    word_hash = lambda w: mix(sum(ord(c) * pow(base, i, 1 << 64) for i, c in enumerate(f"<{w}>")) & mask)

    def gram(g):
        h = ord(g[0])
        for c in g[1:]:
            h = (h * base + ord(c)) & mask
        return mix((h + len(g) * pair) & mask) >> 46

    def two(a, b):
        return 0 if a == b else (((((a * pair) & mask) ^ ((b + pair) & mask)) * pair) & mask) >> 46

    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(0, 2, quality.BUCKETS).astype(np.float32), 0.25)
    value = model.value.astype(float)

    def plain(text):
        words = (text or "").split()
        if not words:
            return 1 / (1 + math.exp(-0.25))
        hashes = [word_hash(w) for w in words]
        grams = [gram(f"<{w}>"[i : i + n]) for w in words for n in (3, 4, 5) for i in range(len(w) + 3 - n)]
        kinds = [np.mean([value[mix((h + 1) & mask) >> 46] for h in hashes]), np.mean(value[grams])]
        if len(words) > 1:
            kinds.append(np.mean([value[two(a, b)] for a, b in zip(hashes, hashes[1:], strict=False)]))
        return 1 / (1 + math.exp(-(sum(kinds) / len(kinds) + 0.25)))

    texts = [None, "", " \n ", "a", "one two", "two  two\ttwo\n", "\u00e9t\u00e9 \u4e2d\u6587 \U0001f600 end", "word " * 3000, "x" * 50_000, "The river, the hills; and THE river.", "one two"]
    got = model.score(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain(t) for t in texts], rtol=0, atol=1e-9) and got[4] == got[-1]
    df = spark.createDataFrame([(i, t, 1.5, "p") for i, t in enumerate(texts)], "doc_id long, text string, score double, predicted string")
    assert {r["doc_id"]: r["score"] for r in quality.score_quality(df, model).collect()} == dict(enumerate(got.tolist()))
    kept = quality.keep_quality(df, model, threshold=0.5)
    assert kept.schema == df.schema and {(r["doc_id"], r["score"], r["predicted"]) for r in kept.collect()} == {(i, 1.5, "p") for i, g in enumerate(got) if g >= 0.5}
    for t in texts:  # training sees the same features
        buckets, weights = quality.document_features(t)
        logit = float((value[buckets] * weights).sum()) + 0.25
        assert abs(1 / (1 + math.exp(-logit)) - plain(t)) < 1e-4


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, f in p.STAGES:
        out = p.stage(f(spark, docs, sf_dir), "test")
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        seen[name] = out.count()
        if name == "near copies":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            groups = defaultdict(list)
            for i, (n, c) in brute(rows, 5, 80, 100).items():
                groups[c if n else ("empty", i)].append(i)
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(min(g) for g in groups.values())
        if name == "decontamination":
            bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            shared = {w for _, t in bench for w in zip(*(re.findall(r"[^\W_]+", t.lower())[j:] for j in range(5)), strict=False)}
            near = [(r["doc_id"], r["text"]) for r in docs.collect() if shared & set(zip(*(re.findall(r"[^\W_]+", (r["text"] or "").lower())[j:] for j in range(5)), strict=False))]
            gone = {d for d, _ in leaks_by_brute_force(near, bench)}
            assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in out.collect()} == gone
        docs = out
    assert seen["quality"] > seen["near copies"] >= seen["decontamination"] == seen["tokens"] > 0


def test_pipeline_keeps_one_of_many_copies(spark):
    """Copies on ten sources or more: the lowest keeps the whole text, the near-copy stage sees no blank documents."""
    import corpus_pipeline as p

    whole = "\n".join(f"line {k} of a text that stands on a dozen sources" for k in range(4))
    common = "a notice that every source puts below its pages"
    rows = [(i, whole, f"s{i % 12}") for i in range(10, 30)] + [(i, f"{common}\nown words of document number {i}, not shared", f"s{i % 12}") for i in range(40, 60)]
    rows += [(60, f"{common}\nthe last one\n{common}", "s0"), (70, "", "s1"), (71, None, "s2"), (72, "\n", "s3")]
    df = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, n_chars int")
    cleaned = p.stage(p.line_dedup(spark, df, ""), "test")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()}
    want = {10: whole, 40: rows[20][1], **{i: t.split("\n")[1] for i, t, _ in rows[21:40]}, 60: "the last one", 70: "", 71: None, 72: "\n"}
    assert got == {i: (t, len(t or "")) for i, t in want.items()}
    assert sorted(r["doc_id"] for r in p.near_copies(spark, cleaned, "").collect()) == sorted(want)


@pytest.mark.parametrize("stripe", [1024, 7])
def test_link_counts_are_brute_force(spark, monkeypatch, stripe):
    """Links between different sets, those inside a large group of mostly common n-grams included."""
    rows = corpus()
    monkeypatch.setattr(jaccard, "STRIPE_SETS", stripe, raising=False)
    monkeypatch.setattr(jaccard, "_frequent", _with_heavy(jaccard._frequent, 4))
    cut = lambda t: (t or "").encode().lower().split()
    sets = {i: frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if (w := cut(t)) else frozenset() for i, t, *_ in rows}
    kinds = {s for s in sets.values() if s}
    links = {s: sum(s != o and 100 * len(s & o) >= 85 * len(s | o) for o in kinds) for s in kinds}
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, n int").repartition(6)
    got = {r["doc_id"]: r["n_links"] for r in jaccard.jaccard_components(df, 4, 85, 100).collect()}
    assert got == {i: links.get(s, 0) for i, s in sets.items()} and max(got.values()) > 20
