"""Token ids by a tokenizer file, and a binary format for them: static range asymmetric numeral system.

Format. A frequency table (token, scaled frequency; sum 2**SCALE_BITS) is shared by all blocks. A block holds
the ids of whole consecutive documents: header, the coder's lane states, checkpoints and 32-bit words, all
little-endian. ``lanes`` interleaved coders take ids in turn, so that one numpy step codes a whole row of ids.
Every CHECK_STEPS rows a checkpoint stores the lane states and the word offset, so that decoding can start
there; a crc32 of the ids as unsigned 32-bit integers guards each block. Blocks are rows of a Parquet table in
the shared folder, each with the global position of its first id, so that they decode in parallel and a lost
task is simply run again.

Nulls: a null text is empty (only the end id); null document ids come first. Ids of documents are read as long (one that
is no number is an error under ANSI rules, else null). Rows of one doc_id are ordered by a hash of their ids, then by
these. A text of any length stays in one block. Empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import discard, lean, ship, stage
from .units import binary_array, cut_units, fine_pattern, flat_binary, slices, spread

MAGIC, SCALE_BITS, LOW = b"TGR1", 20, np.uint64(1 << 31)
BLOCK_IDS, LANES, CHECK_STEPS = 1 << 17, 1024, 64


class UnitEncoder:
    """Encodes texts with the tokenizers library, each distinct unit of a batch once, remembering the first limit units.

    Byte-level pre-tokenization never looks across a space or newline between two visible characters, so the ids of a
    text are those of its units in turn. Texts that may hold a special token's string are encoded in one piece.
    """

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # an executor's cores have a task each
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.fine = fine_pattern(lambda t: [t[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(t)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.store, self.used = np.empty(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.empty(limit, np.int64), np.empty(limit, np.int64)

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Appends the ids of new units to the store; (first position, ids) of each. Those that are remembered come first."""
        found = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        ids = [e.ids for e in found]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(lengths.sum())
        if self.used + total > len(self.store):
            self.store = np.concatenate([self.store, np.empty(max(total, len(self.store)), np.uint32)])
        self.store[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.uint32, total)
        starts = self.used + np.cumsum(lengths) - lengths
        room = min(len(units), self.limit - len(self.known))
        if room and self.used < 1 << 23:
            base = len(self.known)
            self.known.update(zip(units[:room], range(base, base + room), strict=True))
            self.starts[base : base + room], self.lengths[base : base + room] = starts[:room], lengths[:room]
            self.used = int(starts[room - 1] + lengths[room - 1])
        return starts, lengths

    def encode(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, ids of each text), with the end id after each text unless it is None."""
        whole = None
        for s in self.special:
            holds = pc.match_substring(pc.fill_null(texts, ""), s)
            whole = holds if whole is None else pc.or_(whole, holds)
        codes, distinct, counts = cut_units(texts, self.fine, whole)
        units = distinct.to_numpy(zero_copy_only=False).tolist()  # strings at once, a tenth of to_pylist's time
        at = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        starts, lengths = self.starts[at], self.lengths[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            long = pc.greater_equal(pc.binary_length(distinct), 64).to_numpy(zero_copy_only=False)[new]
            new = np.concatenate([new[~long], new[long]])  # long ones are the last to be remembered
            starts[new], lengths[new] = self._learn([units[i] for i in new.tolist()])
        ids = self.store[spread(starts[codes], lengths[codes])]
        per_text = np.diff(np.concatenate([[0], np.cumsum(lengths[codes])])[np.concatenate([[0], np.cumsum(counts)])])
        if end is not None:
            ids, per_text = np.insert(ids, np.cumsum(per_text), end), per_text + 1
        return ids, per_text


_encoders: dict[str, UnitEncoder] = {}


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of a sum that is a power of two, at least 1 where the count is; the commonest symbols take the rounding.

    The sum is 2**SCALE_BITS, or more where there are so many symbols that a quarter of it would not hold them.
    """
    total, symbols = int(counts.sum()), int(np.count_nonzero(counts))
    if not total:
        return counts.astype(np.int64)
    goal = 1 << max(SCALE_BITS, (symbols - 1).bit_length() + 2)
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * goal / total).astype(np.int64), 0)
    order = np.argsort(-f, kind="stable")
    off, k = goal - int(f.sum()), 0
    while off:
        s = order[k % symbols]
        step = off if off > 0 else max(off, -(int(f[s]) // 2))
        if step:
            f[s] += step
            off -= step
        k += 1
    return f


class Coder:
    def __init__(self, freq: np.ndarray):
        self.bits = max(0, int(freq.sum()).bit_length() - 1)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = max(1, min(LANES, n))
        x, out, words, checks = np.full(lanes, LOW, np.uint64), [], 0, []
        steps = -(-n // lanes)
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            f, v = self.freq[s], x[: len(s)]
            full = v >= f << np.uint64(63 - self.bits)
            w = v[full].astype(np.uint32)
            out.append(w)
            words += len(w)
            v = np.where(full, v >> np.uint64(32), v)
            q = v // f
            x[: len(s)] = (q << np.uint64(self.bits)) + (v - q * f) + self.start[s]
            if t and t % CHECK_STEPS == 0:
                checks.append((t, words, x.copy()))
        head = struct.pack("<4sIIIII", MAGIC, n, lanes, words, len(checks), zlib.crc32(ids.astype("<u4").tobytes()))
        marks = b"".join(struct.pack("<II", t, words - w) + v.astype("<u8").tobytes() for t, w, v in reversed(checks))
        return head + x.astype("<u8").tobytes() + marks + b"".join(w.astype("<u4").tobytes() for w in reversed(out))

    def decode(self, block: bytes, checkpoint: int | None = None) -> np.ndarray:
        """All ids of a block, or those from its k-th checkpoint on (which the checksum then does not cover)."""
        magic, n, lanes, words, n_checks, crc = struct.unpack_from("<4sIIIII", block)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at = struct.calcsize("<4sIIIII")
        first, word = 0, 0
        x = np.frombuffer(block, "<u8", lanes, at).copy()
        if checkpoint is not None:
            mark = at + 8 * lanes + checkpoint * (8 + 8 * lanes)
            first, word = struct.unpack_from("<II", block, mark)
            x = np.frombuffer(block, "<u8", lanes, mark + 8).copy()
        data = np.frombuffer(block, "<u4", words, at + 8 * lanes + n_checks * (8 + 8 * lanes)).astype(np.uint64)
        ids, mask, bits = np.empty(n, np.uint32), np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        for t in range(first, -(-n // lanes)):
            k = min(lanes, n - t * lanes)
            v = x[:k]
            slot = v & mask
            s = self.symbol[slot]
            ids[t * lanes : t * lanes + k] = s
            v = self.freq[s] * (v >> bits) + slot - self.start[s]
            low = np.flatnonzero(v < LOW)
            if word + len(low) > words:
                raise ValueError("block of token ids is damaged")
            v[low] = (v[low] << np.uint64(32)) | data[word : word + len(low)]
            word += len(low)
            x[:k] = v
        if checkpoint is not None:
            return ids[first * lanes :]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("block of token ids is damaged")
        return ids


def _tokenized(path: str, end: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoders.get(path) or _encoders.setdefault(path, UnitEncoder(path))
        for whole in batches:
            for b in slices(whole, 1, 6 << 20):
                ids, counts = coder.encode(b.column(1), end)
                yield pa.RecordBatch.from_arrays([b.column(0), binary_array(ids.astype(width), counts)], names=["doc_id", "ids"])

    return lean(run)


def _placed(width: str):
    """Adds the partition, and the position in it of each row's first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, done = TaskContext.get().partitionId(), 0
        for b in batches:
            counts = flat_binary(b.column(1), width)[1]
            ends = done + np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(counts), pid, np.int32)), pa.array(ends - counts), pa.array(counts), b.column(1)], names=["doc_id", "pid", "first", "n", "ids"])
            done = int(ends[-1]) if len(ends) else done

    return lean(run)


def _histogram(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            counts = np.bincount(flat_binary(b.column(0), width)[0], minlength=len(total))
            total = np.pad(total, (0, len(counts) - len(total))) + counts
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], names=["token", "n"])

    return lean(run)


def _blocks(freq, bases: dict[int, int], block_ids: int, width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        docs, ids, held, at = [], [], 0, None  # at: the partition and position that would continue this block

        def flush():
            lens = np.array([len(x) for x in ids], np.int64)
            payload = coder.encode(np.concatenate(ids).astype(np.int64))
            start = bases[at[0]] + at[1] - int(lens.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array([start]), pa.array([docs], pa.list_(pa.int64())), pa.array([lens.tolist()], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["start", "doc_ids", "lens", "payload"],
            )

        for b in batches:
            flat, counts = flat_binary(b.column(3), width)
            ends = np.cumsum(counts)
            for doc, pid, first, n, e in zip(*(b.column(k).to_pylist() for k in range(3)), counts.tolist(), ends.tolist(), strict=True):
                if ids and (held >= block_ids or (pid, first) != at):
                    yield flush()
                    docs, ids, held = [], [], 0
                docs.append(doc), ids.append(flat[e - n : e])
                held += n
                at = (pid, first + n)
        if ids:
            yield flush()

    return lean(run)


def write_token_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """(blocks, frequencies): the staged tables of a token file, with blocks in ascending id order by start."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    width = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(True) - 1, end_id) < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = stage(rows.mapInArrow(_tokenized(tokenizer_path, end_id, width), "doc_id long, ids binary"), "token-ids")  # texts stay where they are
    counted = found.select("ids").mapInArrow(_histogram(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # a row per vocabulary entry at most
    counts = np.zeros(max([r["token"] for r in counted], default=0) + 1, np.int64)
    for r in counted:
        counts[r["token"]] = r["n"]
    freq = scaled(counts)
    shared = stage(spark.createDataFrame([(int(t), int(freq[t])) for t in np.flatnonzero(freq)], "token long, frequency long").coalesce(1), "token-frequencies")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), "ids"]  # the hash lets the rows of one id lie in several partitions
    ranged = found.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    placed = stage(ranged.mapInArrow(_placed(width), "doc_id long, pid int, first long, n long, ids binary"), "token-places")
    discard(found)
    lasts = placed.groupBy("pid").agg(F.max(F.col("first") + F.col("n")).alias("n")).orderBy("pid").collect()
    bases, total = {}, 0
    for r in lasts:  # one row per partition
        bases[r["pid"]] = total
        total += r["n"]
    schema = "start long, doc_ids array<long>, lens array<long>, payload binary"
    held = spark.sparkContext.broadcast(freq)
    blocks = stage(placed.select("doc_id", "pid", "first", "ids").mapInArrow(_blocks(held, bases, block_ids, width), schema), "token-blocks")
    discard(placed)
    return blocks, shared


def read_token_blocks(blocks: DataFrame, frequencies: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, unsigned 32-bit little-endian) of every document in the blocks."""
    spark = blocks.sparkSession
    rows = frequencies.collect()
    freq = np.zeros(max([r["token"] for r in rows], default=0) + 1, np.int64)
    for r in rows:
        freq[r["token"]] = r["frequency"]
    shared = spark.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for b in batches:
            for start, docs, lens, payload in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                ids, n = coder.decode(payload).astype("<u4").tobytes(), np.array(lens, np.int64)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array([ids[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lens, strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
