"""Texts cut into units by Arrow kernels, for functions that work on words.

A unit starts at a space that stands between two characters that are not white space, and holds that space itself, so
that the units of a text, one after another, are the text. Byte-level pre-tokenizers never join across such a place. A
fine cut also starts units at such newlines, and at commas and full stops that stand alone after a Latin letter or a
digit; it suits patterns by which fine_pattern holds. Each batch is cut and its units are numbered by Arrow; Python sees every distinct unit once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What standard white space there is besides the space and the newline.
OTHER_SPACE = "".join(map(chr, [9, 11, 12, 13, *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Texts with two neighbouring white spaces, or other ones, are cut by Python's look-around.
ODD = f"[ \n][ \n]|[{OTHER_SPACE}]"
#: A comma or full stop that may belong to a run of other marks.
LATIN = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
DENSE = f"[^{LATIN}][.,]|[.,][^{LATIN} \n]"
SPACES, LINES = re.compile(r"(?<=\S)(?= \S)"), re.compile(r"(?<=\S)(?=[ \n]\S)")


def slices(batch: pa.RecordBatch, at: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about most bytes of column at (one row at least), so that memory has a bound."""
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, most + (int(ends[first - 1]) if first else 0), "right")))
        yield batch.slice(first, last - first)
        first = last


def _mark(texts: pa.Array) -> str:
    """A character that no text holds."""
    for c in map(chr, [0, *range(0xE000, 0xF900), *range(1, 0xD800)]):
        if not pc.any(pc.match_substring(texts, c)).as_py():
            return c
    raise ValueError("every character occurs")


def fine_pattern(cut) -> bool:
    """Whether cut (text -> its pieces) keeps newlines between visible characters, and lone commas and full stops, by themselves."""
    return all(cut(f"{a}{m}{b}") == [a, m, b] for a in ("a", "Z", "7", "\u00e9") for b in ("b", "Q", "3", "\u00df") for m in (",", ".", "\n")) and cut("a,\nb") == ["a", ",", "\n", "b"] and cut("a(\n(") == ["a", "(", "\n", "("] and cut("a. b") == ["a", ".", " b"]


def cut_units(texts: pa.Array, fine: bool = True, whole: pa.Array | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(number of each unit in turn, the distinct units, units of each text); null texts are empty.

    Texts for which whole holds are one unit each.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    mark = _mark(texts)
    marked = pc.replace_substring(texts, " ", f"{mark} ")
    if fine:
        marked = pc.replace_substring(marked, "\n", f"{mark}\n")
        finer = pc.replace_substring(pc.replace_substring(marked, ",", f"{mark},"), ".", f"{mark}.")
        marked = pc.if_else(pc.match_substring_regex(texts, DENSE), marked, finer)
    odd = pc.match_substring_regex(texts, ODD)
    if whole is not None:
        odd = pc.or_(odd, whole)
    if pc.any(odd).as_py():
        cut = (LINES if fine else SPACES).split
        kept = [False] * len(texts) if whole is None else whole.to_pylist()
        own = [t if k else mark.join(cut(t)) for t, o, k in zip(texts.to_pylist(), odd.to_pylist(), kept, strict=True) if o]
        marked = pc.replace_with_mask(marked, odd, pa.array(own, pa.string()))
    found = pc.split_pattern(marked, mark)
    numbered = found.flatten().dictionary_encode()
    return numbered.indices.to_numpy().astype(np.int64), numbered.dictionary, np.diff(found.offsets.to_numpy().astype(np.int64))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of lengths[i] each, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def flat_binary(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a binary column in turn, how many each row has), without a copy; nulls have none."""
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "<i4")
    data = column.buffers()[2]
    width = np.dtype(dtype).itemsize
    raw = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(dtype), np.diff(offsets.astype(np.int64)) // width


def binary_array(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows hold counts[i] values of flat each, in turn."""
    ends = np.concatenate([[0], np.cumsum(counts)]) * flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(np.ascontiguousarray(flat))])
