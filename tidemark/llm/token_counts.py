"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at boundaries no token crosses (see :mod:`.segments`), equal segments of a slice are encoded once, and
encoding batches are balanced by their bytes. Nothing is shuffled; memory is bounded by the slice (8 MB of text).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import base, segments

_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer at ``path``, once a process: tokenizers for .json, sentencepiece for .model."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _loaded[path] = t
        elif path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            raise ValueError(f"a .json or .model file is expected, not {path}")
    return _loaded[path]


def lengths(path: str, texts: pa.Array, byte_level: bool) -> np.ndarray:
    """Tokens of each text; ``byte_level``: the tokenizer's pre-tokens are those :mod:`.segments` relies on."""
    tok, out = load(path), np.zeros(len(texts), np.int64)
    if path.endswith(".model"):
        for i, t in enumerate(texts.to_pylist()):
            out[i] = len(tok.encode(t, num_threads=1))
        return out
    encode = lambda items: [len(e) for c in segments.chunks(items, segments.sizes_of(items)) for e in tok.encode_batch_fast(c, add_special_tokens=False)]
    if not byte_level:
        out[:] = encode(texts.to_pylist())
        return out
    for rows, offsets, parts in segments.groups(texts):
        sizes = np.array(encode(parts.dictionary.to_pylist()), np.int64)[np.asarray(parts.indices)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        out[rows] = total[offsets[1:]] - total[offsets[:-1]]
    return out


def splits_safely(path: str) -> bool:
    """Whether the tokenizer file is plain byte-level BPE, for which cutting before lone spaces changes nothing."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    tokens = spec.get("added_tokens") or []
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in tokens)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens), a row for each input row.

    A null text counts as empty (0 bytes, 0 tokens); a null id is kept; repeated rows each give a row; other columns
    are not read. An empty table gives an empty result. No begin, end or added special token is counted, special
    strings inside a text are handled as the library does by default, and nothing is truncated or padded.
    """
    base.ship(docs.sparkSession)
    byte_level = splits_safely(path)
    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.slices(batches):
            texts = base.text_of(batch)
            n = lengths(path, texts, byte_level)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return picked.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("doc_id", id_column)
