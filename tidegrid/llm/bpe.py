"""Byte-level BPE by Spark higher-order functions, and its inverse.

Encoding a word is a fold over its byte array: each step merges the leftmost adjacent pair of lowest rank, until
no pair has a rank. The ranks are one literal: buckets by crc32, each a small map, so a look-up reads a few keys.
The fold runs once for each of the commonest distinct words (at most dictionary_words, a bound on what is
broadcast), and, by the same expression, in place for every other word of a document; no word is left out. A fold's
work grows with the square of the word's length, so words of more than LONG_WORD bytes are merged in the Arrow task by
a heap over the same ranks, which gives the same ids. Otherwise Arrow tasks only cut texts by the pattern, put the ids
of known words in their places (a staged table), and weave in those of the others.

Decoding looks each id up in the array of binary pieces and concatenates them.

Nulls: a null text is empty: no ids, and no decoded bytes. Texts of any length are cut whole; the pattern must not
join text across a space between two visible characters, so units between such spaces are cut once each.
Repeated rows are encoded row by row. Empty tables give no rows. A column named ids is replaced; other columns stay
as they are, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import discard, fresh_name, lean, ship, stage
from .units import LATIN, binary_array, cut_units, fine_pattern, flat_binary, slices, spread

BUCKETS = 1 << 14
#: Bytes of a word up to which it is folded.
LONG_WORD = 256
#: Letters on which all Unicode versions agree.
LONE = "^ ?[" + LATIN.removeprefix("0-9") + "]+$"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the piece, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _literal(value, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), schema)  # folded to a literal when planned


def rank_buckets(ranks: dict[bytes, int]) -> Column:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        key = piece.hex().upper()
        buckets[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return _literal(buckets, "array<map<string,int>>")


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_ids(word: Column, buckets: Column) -> Column:
    """Ids of one word (array<int>), by the fold. The literal is bound once, so that plans hold one copy of it."""
    return _let(buckets, lambda held: _folded_ids(word, held))


def _folded_ids(word: Column, buckets: Column) -> Column:
    def rank(piece: Column) -> Column:
        return F.element_at(F.get(buckets, (F.crc32(piece) % BUCKETS).cast("int")), piece)

    def rank_of(piece: Column) -> Column:
        return _let(piece, rank)

    def merged(state: Column) -> Column:
        p, r = state["p"], state["r"]

        def at(j: Column) -> Column:
            def put(piece: Column) -> Column:  # in place of pieces j and j + 1; only the pairs with its neighbours change
                left, right = rank_of(F.concat(F.get(p, j - 1), piece)), rank_of(F.concat(piece, F.get(p, j + 2)))
                pieces = F.transform(F.slice(p, 2, F.size(p)), lambda x, k: F.when(k > j, x).when(k == j, piece).otherwise(F.get(p, k)))
                pairs = F.transform(F.slice(r, 2, F.size(r)), lambda x, k: F.when(k > j, x).when(k < j - 1, F.get(r, k)).when(k == j, right).otherwise(left))
                return F.struct(pieces.alias("p"), pairs.alias("r"))

            return _let(F.concat(F.get(p, j), F.get(p, j + 1)), put)

        return F.coalesce(_let(F.array_position(r, F.array_min(r)).cast("int") - 1, lambda j: F.when(j >= 0, at(j))), state)

    def folded(code: Column) -> Column:
        n = (F.length(code) / 2).cast("int")
        bytes_ = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(code, i * 2 + 1, F.lit(2)))
        pairs = F.transform(F.sequence(F.lit(0), n - 2), lambda i: rank_of(F.substring(code, i * 2 + 1, F.lit(4))))
        last = F.aggregate(F.sequence(F.lit(2), n), F.struct(bytes_.alias("p"), pairs.alias("r")), lambda s, _: merged(s), lambda s: F.transform(s["p"], rank))
        whole = rank(code)
        return F.when(n == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(F.when(n > 1, last))

    return _let(F.hex(F.encode(word, "UTF-8")), folded)


def merged_ids(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: the same merges by a heap of pairs, in n log n steps."""
    n = len(data)
    end, after, before = list(range(1, n + 1)), [*range(1, n), -1], list(range(-1, n - 1))  # of the piece that starts at a place; 0 as its end: merged away

    def pair(i: int):
        j = after[i]
        return (ranks[piece], i, end[j]) if j >= 0 and (piece := data[i : end[j]]) in ranks else None

    heap = [x for x in map(pair, range(n - 1)) if x]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = after[i]
        if not end[i] or j < 0 or end[j] != e:  # one of the two was merged since
            continue
        end[i], after[i], end[j] = e, after[j], 0
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and (x := pair(k)):
                heapq.heappush(heap, x)
    out, i = [], 0
    while i >= 0:
        out.append(ranks[data[i : end[i]]])
        i = after[i]
    return out


def _lone_words(cut):
    """A vectorised test that units are single pieces: Latin letters, with a space in front or none; false for all where the pattern cuts such."""
    if any(cut(x) != [x] for x in ("a", " a", "Zb", " \u00dfQ", "\u00e9", " \u024f")):
        return lambda units: pa.array(np.zeros(len(units), bool))
    return lambda units: pc.match_substring_regex(units, LONE)


def _counter(pattern: str, limit: int = 1 << 19):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut = regex.compile(pattern).findall
        fine, lone = fine_pattern(cut), _lone_words(cut)
        held, size = [], 0

        def flush():
            units = pa.concat_tables(held).group_by("unit", use_threads=False).aggregate([("n", "sum")]).combine_chunks()
            held.clear()
            unit = units.column("unit").combine_chunks() if units.num_rows else pa.array([], pa.string())
            counts, single = units.column("n_sum"), lone(unit)
            words: Counter = Counter()
            rest = pc.invert(single)
            for u, n in zip(unit.filter(rest).to_pylist(), counts.filter(rest).to_pylist(), strict=True):
                for w in cut(u):
                    words[w] += n
            for names, numbers in ((unit.filter(single), counts.filter(single)), (pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()))):
                numbers = numbers.combine_chunks() if isinstance(numbers, pa.ChunkedArray) else numbers
                yield pa.RecordBatch.from_arrays([names, numbers.cast(pa.int64())], names=["word", "n"])

        for whole in batches:
            for b in slices(whole, 0):
                codes, distinct, _ = cut_units(b.column(0), fine)
                held.append(pa.table({"unit": distinct, "n": np.bincount(codes, minlength=len(distinct)).astype(np.int64)}))
                size += len(distinct)
                if size > 2 * limit:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return lean(run)


def word_dictionary(docs: DataFrame, text_col: str, buckets: Column, pattern: str, dictionary_words: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the commonest words, at most dictionary_words; their ids in turn; ids of each); counted over all documents, without a sort."""
    words = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counter(pattern), "word string, n long")
    words = words.where(F.octet_length("word") <= LONG_WORD)
    counted = stage(words.groupBy("word").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")), "word-counts")
    # The lowest level of frequency from which on the words fit; levels are a sixteenth of a doubling, so they are few.
    cut, held = None, 0
    for r in sorted(counted.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > dictionary_words:
            break
        cut = r["level"]
    if cut is None:
        discard(counted)
        return pa.array([], pa.string()), np.empty(0, np.int32), np.empty(0, np.int64)
    common = counted.where(F.col("level") >= cut)
    spread_over = max(8, common.sparkSession.sparkContext.defaultParallelism * 4)
    found = common.select("word").repartition(spread_over, "word").select("word", word_ids(F.col("word"), buckets).alias("ids"))
    got = found.toArrow()
    discard(counted)
    ids = pa.concat_arrays([c.cast(pa.list_(pa.int32())) for c in got.column("ids").chunks]) if got.num_rows else pa.array([], pa.list_(pa.int32()))
    words = pa.concat_arrays([c.cast(pa.string()) for c in got.column("word").chunks]) if got.num_rows else pa.array([], pa.string())
    return words, ids.flatten().to_numpy().astype(np.int32), np.diff(ids.offsets.to_numpy().astype(np.int64))


class _Arranger:
    """Ids of units in one worker: the common words' from the dictionary, RARE for each word that has to be folded."""

    RARE = -1

    def __init__(self, shared, pattern: str):
        import regex

        self.words, flat, counts, self.ranks = shared
        self.store = np.concatenate([[self.RARE], flat]).astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.cut = regex.compile(pattern).findall
        self.fine, self.lone = fine_pattern(self.cut), _lone_words(self.cut)

    def arrange(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids of each text as 32-bit integers, RARE where a word has to be folded; these words of each text)."""
        codes, distinct, counts = cut_units(texts, self.fine)
        # Distinct units to words: most are one word.
        single = self.lone(distinct).to_numpy(zero_copy_only=False)
        parts = [self.cut(u) for u in distinct.filter(pa.array(~single)).to_pylist()]
        of_unit = np.ones(len(distinct), np.int64)
        of_unit[~single] = np.fromiter(map(len, parts), np.int64, len(parts))
        others = pa.array([w for p in parts for w in p], pa.string())
        first = np.empty(len(distinct), np.int64)  # places in words: single units, then the parts of the others
        first[single] = np.arange(int(single.sum()))
        first[~single] = int(single.sum()) + np.cumsum(of_unit[~single]) - of_unit[~single]
        both = pa.concat_arrays([distinct.filter(pa.array(single)), others]).dictionary_encode()
        words, of_place = both.dictionary, both.indices.to_numpy()
        # Words to ids: in the dictionary, or too long to fold, or rare.
        hit = pc.fill_null(pc.index_in(self.words, value_set=words), -1).to_numpy()  # the smaller side is hashed
        known = np.flatnonzero(hit >= 0)
        rare = np.ones(len(words), bool)
        rare[hit[known]] = False
        starts, lengths = np.zeros(len(words), np.int64), np.ones(len(words), np.int64)  # RARE
        starts[hit[known]], lengths[hit[known]] = self.ends[known] + 1, self.ends[known + 1] - self.ends[known]
        extra = []
        long = np.flatnonzero(rare & (pc.binary_length(words).to_numpy(zero_copy_only=False) > LONG_WORD))
        for k in long.tolist():
            ids = merged_ids(words[k].as_py().encode(), self.ranks)
            starts[k], lengths[k] = len(self.store) + sum(map(len, extra)), len(ids)
            extra.append(np.array(ids, np.int32))
        rare[long] = False
        store = np.concatenate([self.store, *extra]) if extra else self.store
        # Units of texts to words, words to ids.
        per_text = lambda n, ends: np.diff(np.concatenate([[0], np.cumsum(n)])[ends], prepend=0)
        run = of_place[spread(first[codes], of_unit[codes])]
        run_ends = np.cumsum(per_text(of_unit[codes], np.cumsum(counts)))
        ids = store[spread(starts[run], lengths[run])]
        folded = words.take(pa.array(run[rare[run]]))
        offsets = np.concatenate([[0], np.cumsum(per_text(rare[run].astype(np.int64), run_ends))]).astype(np.int32)
        return binary_array(ids, per_text(lengths[run], run_ends)), pa.ListArray.from_arrays(pa.array(offsets), folded)


def _arranged(shared, pattern: str, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arranger = _Arranger(shared.value, pattern)
        for whole in batches:
            for b in slices(whole, at):
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), *arranger.arrange(b.column(at))], names=names)

    return lean(run)


def _woven(names: list[str], pieces):
    """Puts the ids of folded words in their places; with pieces, adds the digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts = flat_binary(b.column(b.num_columns - 2), "<i4")
            folded = b.column(b.num_columns - 1).flatten()  # of all texts: a list of ids for each rare word
            where = np.flatnonzero(ids < 0)
            own = pc.list_value_length(folded).to_numpy(zero_copy_only=False).astype(np.int64)
            starts, lengths = np.arange(len(ids)), np.ones(len(ids), np.int64)
            starts[where], lengths[where] = len(ids) + np.cumsum(own) - own, own
            out = np.concatenate([ids, folded.flatten().to_numpy(zero_copy_only=False).astype(np.int32)])[spread(starts, lengths)]
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
            made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], made, *(_digests(made, pieces.value) if pieces is not None else ())], names=names)

    return lean(run)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", dictionary_words: int = 1 << 20, digests: bool = False) -> DataFrame:
    """The columns of docs but the text, plus ids: the token ids of the whole text as array<int>; and those of with_digests, if digests."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    docs = docs.drop(*{"ids", *(n for n, _ in DIGESTS if digests)} - {text_col})
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    buckets = rank_buckets(ranks)
    words = word_dictionary(docs, text_col, buckets, pattern, dictionary_words)
    at = docs.columns.index(text_col)
    fields = [f for f in docs.schema.fields if f.name != text_col]
    names = [f.name for f in fields]
    parts, rare = fresh_name(docs, "parts"), fresh_name(docs, "rare")
    shared = spark.sparkContext.broadcast((*words, ranks))  # at most dictionary_words words
    schema = T.StructType([*fields, T.StructField(parts, T.BinaryType()), T.StructField(rare, T.ArrayType(T.StringType()))])
    arranged = docs.mapInArrow(_arranged(shared, pattern, at, [*names, parts, rare]), schema)
    arranged = stage(arranged, "token-parts")  # one Python worker a core at a time
    folded = arranged.withColumn(rare, F.transform(rare, lambda w: word_ids(w, buckets)))
    added = [("ids", T.ArrayType(T.IntegerType())), *(DIGESTS if digests else ())]
    pieces = spark.sparkContext.broadcast(pieces_of(ranks)) if digests else None
    return folded.mapInArrow(_woven([*names, *(n for n, _ in added)], pieces), T.StructType([*fields, *(T.StructField(n, t) for n, t in added)]))


def _gathered(ids: pa.Array, pieces: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(where each row ends, the bytes) of the rows' pieces put together."""
    taken = pieces.take(ids.flatten())
    offsets = np.frombuffer(taken.buffers()[1], "<i4")[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, "<i4")
    rows = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
    data = taken.buffers()[2]
    return offsets[rows], memoryview(data) if data is not None else memoryview(b"")


def pieces_of(ranks: dict[bytes, int]) -> pa.Array:
    found = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        found[rank] = piece
    return pa.array(found, pa.binary())


@functools.cache
def decimals(n: int) -> pa.Array:
    return pa.array([f"{i} ".encode() for i in range(n)], pa.binary())


#: What with_digests adds: the number of ids, the digest of the decimal ids joined by one space, that of the decoded bytes.
DIGESTS = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]


def _digests(ids: pa.Array, pieces: pa.Array) -> list[pa.Array]:
    sha = lambda e, d, less: pa.array([hashlib.sha256(d[a : max(a, b - less)]).hexdigest() for a, b in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)], pa.string())
    counts = pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64())
    return [counts, sha(*_gathered(ids, decimals(len(pieces))), 1), sha(*_gathered(ids, pieces), 0)]


def _decoded(ids: pa.Array, pieces: pa.Array) -> list[pa.Array]:
    ends, data = _gathered(ids, pieces)
    return [pa.array([bytes(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())]


def _with_pieces(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str, added: list[tuple[str, T.DataType]], work) -> DataFrame:
    ship(tokens.sparkSession)
    kept = [f for f in tokens.schema.fields if f.name not in {n for n, _ in added}]
    rows = tokens.select(*[f"`{f.name}`" for f in kept])
    at = rows.columns.index(ids_col)
    shared = tokens.sparkSession.sparkContext.broadcast(pieces_of(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *work(b.column(at), shared.value)], names=[*b.schema.names, *(n for n, _ in added)])

    return rows.mapInArrow(lean(run), T.StructType([*kept, *(T.StructField(n, t) for n, t in added)]))


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """The columns of tokens, plus decoded: the bytes of the ids' pieces, concatenated (none for null ids)."""
    return _with_pieces(tokens, ranks, ids_col, [("decoded", T.BinaryType())], _decoded)


def with_digests(tokens: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """The columns of tokens, plus n_tokens, ids_sha256 and decoded_sha256 of their ids."""
    return _with_pieces(tokens, ranks, ids_col, DIGESTS, _digests)
