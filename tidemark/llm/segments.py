"""Cutting texts where a byte-level tokenizer must start a new token, so that equal segments are encoded once.

A cut lies before a space or line feed whose two neighbours are not white space. The pre-tokenizer pattern can only
have white space at the start of a match or in a match of nothing else, so a match starts exactly there, and nothing
left of it has any influence on what follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in the widest sense any of the libraries uses; a text with two in a row, or one at an end, takes the slow way.
_UNEVEN = r"\x00|^[\x09-\x0d\x1c-\x20\x{85}\p{Z}]|[\x09-\x0d\x1c-\x20\x{85}\p{Z}]$|[\x09-\x0d\x1c-\x20\x{85}\p{Z}]{2}"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def cut(text: str) -> list[str]:
    return _CUT.split(text)


def groups(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.DictionaryArray]]:
    """Yield (rows, offsets, segments): segments[offsets[i]:offsets[i + 1]] concatenate to the text of row rows[i]."""
    uneven = np.asarray(pc.match_substring_regex(texts, _UNEVEN))
    plain = np.flatnonzero(~uneven)
    if len(plain):
        marked = pc.replace_substring(pc.replace_substring(texts.take(pa.array(plain)), " ", "\0 "), "\n", "\0\n")
        parts = pc.split_pattern(marked, "\0")
        yield plain, np.asarray(parts.offsets).astype(np.int64), parts.flatten().dictionary_encode()
    if uneven.any():
        rows = np.flatnonzero(uneven)
        parts = [cut(t) for t in texts.take(pa.array(rows)).to_pylist()]
        offsets = np.zeros(len(parts) + 1, np.int64)
        offsets[1:] = np.cumsum([len(p) for p in parts])
        yield rows, offsets, pa.array([s for p in parts for s in p], pa.string()).dictionary_encode()


def chunks(items: list[str], sizes: np.ndarray, most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of about equally many bytes, each at most ``most`` unless a single item is longer; ``sizes``: bytes of each."""
    ends = np.cumsum(sizes)
    start, n = 0, len(items)
    while start < n:
        before = ends[start - 1] if start else 0
        end = max(int(np.searchsorted(ends, before + most, "right")), start + 1)
        yield items[start:end]
        start = end


def sizes_of(items: list[str]) -> np.ndarray:
    return np.asarray(pc.binary_length(pa.array(items, pa.string())))
