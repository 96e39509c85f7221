"""rANS blocks and byte-level BPE against the libraries."""

import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import bpe, queries, rans

TEXTS = [
    None, "", " ", "a", "a  b", " a b", "x\n \nfoo bar", "it's  we'll\t x WE'LL", "<|endoftext|> a<|endoftext|>b", "\n\n a\r\n b ", "a\u3000b \u200b c\u00a0 ", "12345 \u00bd\u00b2 \U0001f600 中文字", "word " * 3000, "a" * 400 + " " + "é" * 200,
    "中文" * 30_000, "ACGTTGCA" * 12_500 + "x" * 100_000, "a,b, c. d.\ne,\nf..g ,h 3.14,15.\n", "\0 a \0b", "é,è. ß,",
    "the same text", "the same text",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "null id", "x", "y"), (3, "a", "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, known string")


def test_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1023, 1024, 1025, 70_000, 150_000):
        ids = rng.zipf(1.3, n) % 5000
        coder = rans.Coder(rans.scaled(np.bincount(ids, minlength=5001)))
        block = coder.encode(ids)
        assert (coder.decode(block) == ids).all()
        if n == 150_000:
            assert (coder.decode(block, 0) == ids[64 * 1024 :]).all() and (coder.decode(block, 1) == ids[128 * 1024 :]).all()
            entropy = -np.log2(np.bincount(ids)[ids] / n).sum() / 8
            assert len(block) < entropy * 1.02 + 40_000
            broken = bytearray(block)
            broken[-3] ^= 1
            with pytest.raises(ValueError, match="damaged"):
                coder.decode(bytes(broken))


def test_scaled_frequencies():
    for counts in ([1, 0, 10**9], [5], [1] * 3000, [0, 0, 1]):
        f = rans.scaled(np.array(counts))
        assert f.sum() == 1 << rans.SCALE_BITS and ((f > 0) == (np.array(counts) > 0)).all()


@pytest.mark.parametrize("block_ids", [rans.BLOCK_IDS, 50])
def test_blocks_match_the_tokenizers_library(spark, docs, block_ids):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    blocks, freq = rans.write_token_blocks(docs, path, 0, block_ids=block_ids)
    got = rans.read_token_blocks(blocks, freq).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).collect()
    t = Tokenizer.from_file(path)
    enc = lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
    order = sorted(got, key=lambda r: r["start"])
    assert order[0]["doc_id"] is None and [r["doc_id"] for r in order[1:]] == sorted([*range(len(TEXTS)), 3])
    at = 0
    for r in order:
        ids = enc("null id" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        assert (r["start"], r["n_tokens"], r["c"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    empty = rans.write_token_blocks(docs.limit(0), path, 0)
    assert rans.read_token_blocks(*empty).count() == 0


@pytest.mark.parametrize("words", [1 << 18, 3])
def test_bpe_matches_tiktoken(spark, docs, words):
    import tiktoken

    ranks = bpe.read_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken"))
    ref = tiktoken.Encoding("own", pat_str=queries.token_pattern(), mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode(docs, ranks, queries.token_pattern(), dictionary_words=words)
    assert out.columns == ["doc_id", "known", "ids"]
    again = bpe.encode(docs, ranks, queries.token_pattern(), dictionary_words=words, digests=True)
    key = lambda r: (str(r["doc_id"]), r["ids_sha256"])
    got = bpe.decode(bpe.with_digests(out, ranks), ranks).collect()
    assert sorted(again.collect(), key=key) == sorted((r[:-1] for r in got), key=lambda r: (str(r[0]), r[4]))
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "null id" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        ids = ref.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(docs.limit(0), ranks, queries.token_pattern()).count() == 0


def test_known_units_cost_less_than_arrow_scalars():
    words = [f"{i * 7919 % 1_000_003:x}" for i in range(40_000)]
    texts, units = pa.array([" ".join(words)]), pa.array([f" {w}" for w in words])
    encoder = rans.UnitEncoder(queries.tokenizer_file("byte_bpe_50k.json"))
    first = encoder.encode(texts, 0)

    def seconds(f):
        spent = []
        for _ in range(7):
            began = time.thread_time()
            f()
            spent.append(time.thread_time() - began)
        return min(spent)

    assert (encoder.encode(texts, 0)[0] == first[0]).all()
    assert seconds(lambda: encoder.encode(texts, 0)) < seconds(units.to_pylist)
