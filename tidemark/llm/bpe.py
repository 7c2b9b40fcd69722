"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens of a batch share one queue. Their bytes stand one after the other in a linked list with gaps between
pre-tokens; every adjacent pair whose joined bytes have a rank waits in the bucket of that rank, as the position of
its left part. A two-level bitmap marks the buckets in use and find-first-set picks the lowest rank. Its positions are
merged from left to right; entries whose parts have meanwhile merged are skipped; a merge whose new pairs have a lower
rank still sends the rest of its bucket back. So each pre-token sees its merges in the order of rank and place,
whatever the others do. A merge costs a constant number of steps, however long the pre-token is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import base, segments

#: Bits of a word of the lower bitmap level.
FAN = 8
#: Bits of a token id in the key of a pair.
ID_BITS = 20
#: Pre-tokens in each of the two generations a worker remembers; a full one replaces the older (results don't depend on it).
REMEMBERED = 400_000
#: Bytes of pre-tokens that share a queue.
QUEUED = 1 << 19
_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    """Ranks and pattern of a byte-level vocabulary."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        #: Rank of the joined bytes of any two tokens that have one.
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << ID_BITS | b] = rank
        self.byte_pairs = np.full(1 << 16, -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.byte_pairs[a << 8 | b] = self.ranks.get(bytes([a, b]), -1)
        self.table = pa.array(self.tokens, pa.binary())
        #: Packed ids of pre-tokens, the younger and the older generation.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each pre-token, all through one rank queue."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces], np.int64)
        starts = np.cumsum(size) - size
        follow, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        follow[starts + size - 1] = -1
        before[starts] = -1
        first = np.flatnonzero(follow >= 0)
        rank_of = self.byte_pairs[data[first].astype(np.int64) << 8 | data[first + 1]]
        joint = np.full(len(data), -1, np.int64)
        joint[first] = rank_of
        first, rank_of = first[rank_of >= 0], rank_of[rank_of >= 0]
        order = np.argsort(rank_of, kind="stable")
        first, rank_of = first[order].tolist(), rank_of[order]
        cuts = np.flatnonzero(np.concatenate([[True], rank_of[1:] != rank_of[:-1]])) if len(first) else np.zeros(0, int)
        buckets = {r: first[a:b] for r, a, b in zip(rank_of[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(first)], strict=False)}
        mask, top, words = (1 << FAN) - 1, 0, [0] * ((len(self.tokens) >> FAN) + 1)
        for r in buckets:
            words[r >> FAN] |= 1 << (r & mask)
            top |= 1 << (r >> FAN)
        # The part at i has the id ids[i] (-1: part of another by now), the next part follow[i] (-1: the last), and with
        # it the joint rank joint[i] (-1: none); an entry of a bucket whose rank isn't joint[i] any more is stale.
        ids, follow, before, rank_of = self.of_byte[data].tolist(), follow.tolist(), before.tolist(), self.pairs.get
        joint = joint.tolist()
        while top:
            w = (top & -top).bit_length() - 1
            bits = words[w]
            low = bits & -bits
            rank = w << FAN | low.bit_length() - 1
            words[w] = bits ^ low
            if bits == low:
                top ^= 1 << w
            bucket = buckets.pop(rank)
            if len(bucket) > 1:
                bucket.sort()
            left_key = rank << ID_BITS
            for k, i in enumerate(bucket):
                if joint[i] != rank:
                    continue  # stale
                j = follow[i]
                ids[i], ids[j], joint[j] = rank, -1, -1
                after = follow[i] = follow[j]
                least = rank
                if after >= 0:
                    before[after] = i
                    r = joint[i] = rank_of(left_key | ids[after], -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            buckets[r] = [i]
                            words[r >> FAN] |= 1 << (r & mask)
                            top |= 1 << (r >> FAN)
                        if r < least:
                            least = r
                else:
                    joint[i] = -1
                b = before[i]
                if b >= 0:
                    r = joint[b] = rank_of(ids[b] << ID_BITS | rank, -1)
                    if r >= 0:
                        if r in buckets:
                            buckets[r].append(b)
                        else:
                            buckets[r] = [b]
                            words[r >> FAN] |= 1 << (r & mask)
                            top |= 1 << (r >> FAN)
                        if r < least:
                            least = r
                if least < rank and k + 1 < len(bucket):
                    buckets[rank] = bucket[k + 1 :]
                    words[rank >> FAN] |= 1 << (rank & mask)
                    top |= 1 << (rank >> FAN)
                    break
        left = np.array(ids, np.int64)
        live = left >= 0
        n = np.add.reduceat(live, starts).tolist() if len(starts) else []
        packed, out, at = left[live].astype("<u4").tobytes(), [], 0
        for c in n:
            out.append(packed[at : at + 4 * c])
            at += 4 * c
        return out

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of different pre-tokens."""
        out, wait, held = {}, [], 0
        for i, piece in enumerate(pieces):
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            else:
                wait.append((piece, data))
                held += len(data)
            if wait and (held >= QUEUED or i + 1 == len(pieces)):
                out |= zip([p for p, _ in wait], self.merge_all([d for _, d in wait]), strict=True)
                wait, held = [], 0
        return out

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        known = self.learn(list(dict.fromkeys(pieces)))
        return np.frombuffer(b"".join(known[p] for p in pieces), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_batch(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of the packed ids of each text."""
        at = np.cumsum([0, *(len(p) // 4 for p in packed)])
        return joined(self.table.take(pa.array(np.frombuffer(b"".join(packed), "<u4"))), at)

    def packed(self, segs: list[str]) -> list[bytes]:
        """The packed ids of each of these different segments."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out, wait, wanted = list(map(young.get, segs)), [], set()
        for k, known in enumerate(out):
            if known is None:
                s = segs[k]
                known = old.get(s)
                if known is not None:
                    out[k] = young[s] = known
                else:
                    pieces = self.split(s)
                    wait.append((k, pieces))
                    wanted.update(pieces)
        fresh, missing = {}, []
        for piece in wanted:
            known = young.get(piece) or old.get(piece)
            if known:
                fresh[piece] = known
            else:
                missing.append(piece)
        fresh |= self.learn(missing)
        for k, pieces in wait:
            out[k] = fresh[pieces[0]] if len(pieces) == 1 else b"".join([fresh[p] for p in pieces])
        young.update((p, x) for p, x in fresh.items() if len(p) < 64)
        return out

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, packed as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        for rows, offsets, parts in segments.groups(texts):
            ids = pa.array(self.packed(parts.dictionary.to_pylist()), pa.binary())
            for row, x in zip(rows.tolist(), joined(ids.take(parts.indices), offsets), strict=True):
                out[row] = x
        return out


def joined(values: pa.Array, at: np.ndarray) -> list[bytes]:
    """values[at[i]:at[i + 1]] joined, for each i; the values lie one after the other in one buffer."""
    _, ends, data = values.buffers()
    ends = np.frombuffer(ends, np.int32)[values.offset : values.offset + len(values) + 1] if ends else np.zeros(1, np.int32)
    view = memoryview(data) if data else memoryview(b"")
    cuts = ends[at].tolist()
    return [bytes(view[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _picked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    base.ship(docs.sparkSession)
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return id and ``ids array<int>`` of each text, without special tokens.

    A null text is encoded as an empty one (no ids); null ids and repeated rows are kept; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in base.slices(batches):
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in c.encode_batch(base.text_of(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _picked(docs, id_column, text_column).mapInArrow(run, "doc_id long, ids array<int>").withColumnRenamed("doc_id", id_column)


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Return id and ``bytes``, the concatenated bytes of the ids; null ids give empty bytes, an unknown id an error."""
    base.ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "bytes"])

    picked = encoded.select(encoded[id_column].cast("long").alias("doc_id"), encoded[ids_column].alias("ids"))
    return picked.mapInArrow(run, "doc_id long, bytes binary").withColumnRenamed("doc_id", id_column)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids again, and return digests of both.

    Columns: id, ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers), ``decoded_sha256``.
    Null texts count as empty; null ids and repeated rows are kept; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in base.slices(batches):
            packed = c.encode_batch(base.text_of(batch))
            decoded = c.decode_batch(packed)
            columns = [batch.column("doc_id"), pa.array([len(b) // 4 for b in packed], pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in side]) for side in (packed, decoded))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _picked(docs, id_column, text_column).mapInArrow(run, out).withColumnRenamed("doc_id", id_column)
