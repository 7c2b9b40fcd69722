"""Suffix-array deduplication: bytes covered by a long string that starts anywhere else in the corpus.

A corpus has no suffix array of its own here; only strings that could repeat are sorted. Every window of ``length``
bytes is assigned to its *anchor*, the smallest hash among the ``gram``-byte strings inside it (the leftmost of equal
ones). Equal windows have equal anchors at the same place, so a window whose anchor occurs once in the corpus is
unique. Consecutive windows with one anchor occurrence form a *piece*; each window lies in exactly one. Then:

1. anchors are counted over the whole corpus; pieces of anchors that occur once are done (nothing repeats in them);
2. equal pieces are merged and counted: all windows of a piece that occurs twice or more repeat;
3. the different pieces under a shared anchor go to one shard. There the windows that could still repeat are told by a
   deeper anchor (below), and external induced sorting (:mod:`.induced_sort`) orders the suffixes of these with
   common-prefix lengths; a window repeats if a neighbour in that order shares ``length`` bytes with it;
4. repeated windows come back to all occurrences of their piece, are merged into spans, and removed.

The deeper anchor loses no pair: equal windows hold their anchor at the same place, so a piece's windows are cut into
blocks of ``SPLIT`` such places, and what all windows of a block have in common (``length`` - ``SPLIT`` + 1 bytes) is
theirs. A block whose deeper anchor no other piece has holds nothing that repeats.

Shards are as many as the stored bytes need. An anchor with more bytes of different pieces than ``HOT_BYTES`` is split by
deeper anchors before it is dealt. Where even one of those is too large, its windows are counted by their own 128-bit hash.

Pieces are merged by 128 bits of hash beside the anchor's 64; everything else is exact.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import shared
from ..plans.shared import delete
from . import base, induced_sort

LENGTH = 400
GRAM = 128
#: Bytes of pieces a shard is meant to hold, and of different pieces under one anchor before it is split.
SHARD_BYTES = 8 << 20
HOT_BYTES = 1 << 20
#: Bytes of a shard that are sorted together: their names fit what the sort holds in memory, where it is fastest.
SORTED_BYTES = 1 << 19
#: Places of the anchor in a window that make a block.
SPLIT = 32
#: Window starts of a text that are handled at a time, pieces that are hashed at a time, and that are passed on at a time.
BLOCK = 1 << 20
DIGESTED = 1 << 12
EMITTED = 1 << 18
#: Parts a shard's text: no byte of UTF-8.
SEPARATOR = 0xFF
_POSITION_BITS = 24
_NO_ID = -(1 << 63)
_LONGS = struct.Struct("<2q")

_rng = np.random.default_rng(20240229)
#: A random number for each byte value, and the odd base of the rolling hash.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 17)
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each ``gram``-byte string, from prefix sums of a polynomial."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    n = len(data) - gram + 1
    h = (sums[gram:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` numbers: prefix and suffix minima of blocks of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, 1).reshape(-1)
    from_right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(from_right[:n], from_left[width - 1 : width - 1 + n])


def digests(parts: list[bytes]) -> np.ndarray:
    """128 bits of hash of each, as two signed numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.int64).reshape(-1, 2)


def pieces(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[np.ndarray]:
    """Of each block of a text's windows its pieces, a column each: start, windows, place of the anchor, anchor, the two
    halves of the piece's hash, and how often the piece follows itself at once; none of a text shorter than a window.

    In a text that repeats itself every few bytes, equal pieces follow each other; such a run is one column. Memory is
    bounded by the block.
    """
    for begin in range(0, max(len(data) - length + 1, 0), BLOCK):
        block = data[begin : begin + BLOCK + length - 1]
        h = gram_hashes(np.frombuffer(block, np.uint8), gram)
        place = np.arange(len(h), dtype=np.uint64)
        low = sliding_minimum(h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS) | place, length - gram + 1)
        at = (low & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        windows = np.diff(np.append(starts, len(at)))
        anchor = h[at[starts]].view(np.int64)
        del low, place, h
        hashes = np.zeros((len(starts), 2), np.int64)
        for k in range(0, len(starts), DIGESTED):
            part = slice(k, k + DIGESTED)
            hashes[part] = digests([block[a : a + w + length - 1] for a, w in zip(starts[part].tolist(), windows[part].tolist(), strict=True)])
        columns = np.stack([starts + begin, windows, at[starts] - starts, anchor, hashes[:, 0], hashes[:, 1]])
        fresh = np.flatnonzero(np.concatenate([[True], (columns[1:, 1:] != columns[1:, :-1]).any(0)]))
        yield np.concatenate([columns[:, fresh], np.diff(np.append(fresh, columns.shape[1]))[None, :]])


def keyed(docs: DataFrame, carry: tuple[str, ...], id_column: str, text_column: str) -> DataFrame:
    """``carry`` as one struct (its names can't clash), the text, and a key: id and hash of the text.

    Rows with equal keys have equal results.
    """
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    rows = docs.select(base.packed(carry, docs).alias("row"), F.coalesce(docs[id_column].cast("long"), F.lit(_NO_ID)).alias("k1"), text.alias("text"))
    return rows.withColumn("k2", F.xxhash64("text"))


def occurrences(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """All pieces of all texts: k1, k2, start, windows, lead (place of the anchor), anchor, p1, p2 (hash of the piece), times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.slices(batches):
            held, n = [], 0
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), base.text_of(batch).to_pylist(), strict=True):
                for own in pieces(text.encode(), length, gram):
                    held.append(np.concatenate([np.array([[k1], [k2]], np.int64).repeat(own.shape[1], 1), own]))
                    n += own.shape[1]
                    if n >= EMITTED:
                        yield emitted(held)
                        held, n = [], 0
            if held:
                yield emitted(held)

    def emitted(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(held, 1)], names)

    names = ["k1", "k2", "start", "windows", "lead", "anchor", "p1", "p2", "times"]
    return rows.select("k1", "k2", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def covered(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans that the windows at the given ascending starts cover together."""
    first = np.flatnonzero(np.concatenate([[True], np.diff(starts) > length]))
    return starts[first], starts[np.append(first[1:] - 1, len(starts) - 1)] + length


#: What identifies a piece.
PIECE = ("anchor", "p1", "p2")


def blocks_of(anchors: list[int], windows: list[int], leads: list[int], data: list[bytes], length: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' windows in blocks of ``block`` places of the anchor: (piece, first window, windows), and 128 bits of
    hash of the anchor and what a block's windows share.

    A window's place is that of its anchor in it, which falls by one from a window of the piece to the next.
    """
    rows, cores = [], []
    for i, (anchor, n_windows, lead, text) in enumerate(zip(anchors, windows, leads, data, strict=True)):
        first = 0
        while first < n_windows:
            place = lead - first
            n = min(n_windows - first, place % block + 1)
            lowest = place - place % block
            # From the start of the window with the lowest place to the end of that with the highest.
            cores.append(xxhash.xxh3_128_digest(_LONGS.pack(anchor, lowest) + text[lead - lowest : lead - lowest - block + 1 + length]))
            rows.append((i, first, n))
            first += n
    return np.array(rows, np.int64).reshape(-1, 3), np.frombuffer(b"".join(cores), np.int64).reshape(-1, 2)


def block_of(length: int) -> int:
    return max(1, min(SPLIT, length // 4))


def shared_blocks(hashes: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Which blocks have their hash in common with another one, one of them ``single``: what occurs twice needs no proof."""
    order = np.lexsort(hashes.T)
    own = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(1)]))
    size = np.diff(np.append(starts, len(own)))
    out = np.zeros(len(own), bool)
    out[order] = np.repeat((size > 1) & np.logical_or.reduceat(single[order], starts), size)
    return out


def together(anchors: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Runs of strings, ordered by anchor, of about SORTED_BYTES; one anchor's strings are never parted, whatever they hold."""
    last = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors))
    ends, start = np.cumsum(sizes)[last - 1], 0
    while start < len(anchors):
        before = ends[np.searchsorted(last, start)] if start else 0
        end = int(last[max(np.searchsorted(ends, before + SORTED_BYTES, "right") - 1, np.searchsorted(last, start, "right"))])
        yield slice(start, end)
        start = end


def sort_shards(shared: DataFrame, length: int) -> DataFrame:
    """Repeated spans (PIECE, begins, ends) of pieces that occur once, found shard by shard: a partition is a shard.

    ``shared``: PIECE, copies, first (window of the piece), windows, lead (place of the anchor in that window), data. A
    shard's pieces, the text of what is sorted of them, and all that its sorts hold beyond a bounded part lie in a
    temporary folder of the task, removed at its end; a lost task starts afresh.
    """
    block, kinds = block_of(length), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = tempfile.mkdtemp(prefix="tidemark-suffixes-")
        try:
            keys, sizes, parts, hashes, n = [], [], [], [], 0
            path, seen = os.path.join(folder, "pieces"), set()
            with open(path, "wb") as out:
                for batch in batches:
                    own = np.array([batch.column(c).to_numpy() for c in (*PIECE, "copies", "first", "windows", "lead")])
                    data = batch.column("data").to_pylist()
                    fresh = []
                    for i, k in enumerate(map(bytes, own[[0, 1, 2, 4]].T.copy())):  # repeated rows bring a piece again
                        if k not in seen:
                            seen.add(k)
                            fresh.append(i)
                    own, data = own[:, fresh], [data[i] for i in fresh]
                    cut, core = blocks_of(*own[[0, 5, 6]].tolist(), data, length, block)
                    cut[:, 0] += n
                    n += len(data)
                    keys.append(own[:5])
                    sizes.append(np.array([len(d) for d in data], np.int64))
                    parts.append(cut)
                    hashes.append(core)
                    out.write(b"".join(data))
            del seen
            if not n:
                return
            own, size, cut = np.concatenate(keys, 1), np.concatenate(sizes), np.concatenate(parts)
            cut = cut[shared_blocks(np.concatenate(hashes), own[3, cut[:, 0]] == 1)]
            del keys, sizes, parts, hashes
            if not len(cut):
                return
            # Blocks that follow each other in a piece are one string of the text; strings of one anchor are sorted together.
            head = np.flatnonzero(np.concatenate([[True], (cut[1:, 0] != cut[:-1, 0]) | (cut[1:, 1] != cut[:-1, 1] + cut[:-1, 2])]))
            strings = np.stack([cut[head, 0], cut[head, 1], np.add.reduceat(cut[:, 2], head)], 1)
            strings = strings[np.argsort(own[0, strings[:, 0]], kind="stable")]
            begin, stored = np.cumsum(size) - size, np.memmap(path, np.uint8, "r")
            for k, some in enumerate(together(own[0, strings[:, 0]], strings[:, 2] + length)):
                piece, first, windows = strings[some].T
                text = os.path.join(folder, f"text{k}")
                with open(text, "wb") as out:
                    for a, w in zip((begin[piece] + first).tolist(), windows.tolist(), strict=True):
                        out.write(stored[a : a + w + length - 1].tobytes() + bytes([SEPARATOR]))
                flags = induced_sort.repeated(np.memmap(text, np.uint8, "r"), length, folder)
                os.remove(text)
                hits: dict[int, list[np.ndarray]] = {}
                at = np.cumsum(windows + length) - windows - length
                for i, f, a, w in zip(piece.tolist(), first.tolist(), at.tolist(), windows.tolist(), strict=True):
                    found = np.flatnonzero(flags[a : a + w]) if own[3, i] == 1 else ()
                    if len(found):
                        hits.setdefault(i, []).append(found + f)
                rows: list[list] = [[], [], [], [], []]
                for i, found in hits.items():
                    for column, value in zip(rows, (*own[:3, i].tolist(), *covered(np.concatenate(found) + own[4, i], length)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], [*PIECE, "begins", "ends"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    schema = "anchor long, p1 long, p2 long, begins array<long>, ends array<long>"
    return shared.select(*PIECE, "copies", "first", "windows", "lead", "data").mapInArrow(run, schema)


def with_data(rows: DataFrame, keys: tuple[str, ...], cuts: DataFrame, length: int, at: str) -> DataFrame:
    """``cuts`` (keys, windows, a place ``at`` and more) with ``data``, the bytes of their windows, read from ``rows`` (keys, bytes).

    Here and where texts meet their spans both sides grow with the texts: a merge join whatever their size, for no
    plan that a small table allows tells what a large one takes.
    """
    names = [c for c in cuts.columns if c not in keys]
    wanted = cuts.groupBy(*keys).agg(F.collect_set(F.struct(*names)).alias("cuts"))  # a set: repeated rows bring a cut again
    met = rows.select(*keys, "bytes").join(wanted.hint("merge"), list(keys))
    data = lambda c: F.substring("bytes", (c[at] + 1).cast("int"), (c["windows"] + length - 1).cast("int"))
    return met.select(*keys, F.explode(F.transform("cuts", lambda c: F.struct(*[c[n].alias(n) for n in names], data(c).alias("data")))).alias("c")).select(*keys, "c.*")


def split_cuts(cuts: DataFrame, length: int) -> DataFrame:
    """The cuts of ``with_data`` in blocks; s1, s2: their deeper anchor."""
    block = block_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, hashes = blocks_of(*(batch.column(c).to_pylist() for c in ("anchor", "windows", "lead", "data")), length, block)
            at, first, n = cut.T
            same = [batch.column(c).take(pa.array(at)) for c in (*PIECE, "copies")]
            lead = batch.column("lead").to_numpy()[at] - first
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(x, pa.int64()) for x in (first, n, lead, hashes[:, 0], hashes[:, 1]))], names)

    names = [*PIECE, "copies", "first", "windows", "lead", "s1", "s2"]
    return cuts.select(*PIECE, "copies", "windows", "lead", "data").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def shared_cuts(rows: DataFrame, different: DataFrame, length: int, hot_bytes: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(cuts to be sorted, with their data and shard key; spans found without sorting; bytes to be sorted).

    Texts are read once, for all pieces; what hot anchors are split into is cut from their pieces, never from the texts
    again: what moves does not depend on how many anchors are hot.
    """
    size = F.sum(F.col("windows") + (length - 1))
    variants = base.stored(different.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).where("n > 1").select("anchor", "bytes"), "variants")
    texts = rows.select("k1", "k2", F.encode("text", "UTF-8").alias("bytes"))
    cuts = base.stored(with_data(texts, ("k1", "k2"), different.join(variants.withColumnRenamed("bytes", "held"), "anchor"), length, "start").drop("k1", "k2", "start"), "cut-pieces")
    cool = cuts.where(f"held <= {hot_bytes}").select(*PIECE, "copies", F.lit(0).cast("long").alias("first"), "windows", "lead", F.col("anchor").alias("shard"), "data")
    total, hot = variants.agg(F.coalesce(F.sum(F.when(F.col("bytes") <= hot_bytes, F.col("bytes"))), F.lit(0)), F.count(F.when(F.col("bytes") > hot_bytes, 1))).first()
    if not hot:
        return cool, None, total
    split_up = cuts.where(f"held > {hot_bytes}")
    blocks = base.stored(split_cuts(split_up, length), "blocks")
    sizes = base.stored(blocks.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).where("n > 1").select("s1", "s2", "bytes"), "block-sizes")
    again, whole = blocks.join(sizes, ["s1", "s2"]), split_up.select(*PIECE, F.col("data").alias("bytes"))
    taken = lambda some: with_data(whole, PIECE, some.select(*PIECE, "copies", "first", "windows", "lead", F.col("s1").alias("shard")), length, "first")
    more, hot = sizes.agg(F.coalesce(F.sum(F.when(F.col("bytes") <= hot_bytes, F.col("bytes"))), F.lit(0)), F.count(F.when(F.col("bytes") > hot_bytes, 1))).first()
    sorted_ = cool.unionByName(taken(again.where(f"bytes <= {hot_bytes}"))) if more else cool
    if not hot:
        return sorted_, None, total + more
    # What is left over is counted window by window; nothing has to be ordered.
    single = taken(again.where(f"bytes > {hot_bytes}"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("first", "windows", "data")]
            n = columns[1]
            hashes = digests([d[j : j + length] for _, w, d in zip(*columns, strict=True) for j in range(w)])
            first = np.concatenate([f + np.arange(w) for f, w in zip(columns[0], n, strict=True)] or [np.zeros(0, np.int64)])
            same = [np.repeat(batch.column(c).to_numpy(), n) for c in (*PIECE, "copies")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*same, first, hashes[:, 0], hashes[:, 1])], names)

    names = [*PIECE, "copies", "first", "w1", "w2"]
    counted = base.stored(single.select(*PIECE, "copies", "first", "windows", "data").mapInArrow(windows, ", ".join(f"{n} long" for n in names)).distinct(), "windows")
    often = base.stored(counted.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"), "repeated-windows")
    array = lambda c: F.array(c.cast("bigint"))
    found = counted.where("copies = 1").join(often, ["w1", "w2"]).select(*PIECE, array(F.col("first")).alias("begins"), array(F.col("first") + length).alias("ends"))
    return sorted_, found, total + more


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Stored (k1, k2, spans array<struct<begin, end>>) of the keyed texts with repeats; spans may overlap.

    Texts without repeats have no row; an empty table gives none.
    """
    spark = rows.sparkSession
    found = base.stored(occurrences(rows, length, gram), "pieces")
    often = base.stored(found.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "anchors")
    again = base.stored(found.join(often, "anchor"), "repeated-pieces")
    for done in (found, often):
        delete(spark, done.scratch_path)
    counted = again.groupBy(*PIECE).agg(F.sum("times").alias("copies"), F.min(F.struct("k1", "k2", "start", "windows", "lead")).alias("at"))
    different = base.stored(counted.select(*PIECE, "copies", "at.*"), "different-pieces")
    with shared.recorded() as made:
        cuts, more, total = shared_cuts(rows, different, length, hot_bytes)
        least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20)
        shards = max(-(-total // shard_bytes), least, 1)
        compared = base.stored(sort_shards(cuts.repartition(shards, "shard"), length), "compared-pieces")
    longs = lambda c: F.array(c.cast("bigint"))
    spans = compared.unionByName(different.where("copies > 1").select(*PIECE, longs(F.lit(0)).alias("begins"), longs(F.col("windows") + (length - 1)).alias("ends")))
    hits = again.drop("lead").join(spans if more is None else spans.unionByName(more), list(PIECE))
    # A piece that follows itself is repeated as a whole, and so is the run.
    further = (F.col("times") - 1) * F.col("windows")
    moved = F.transform(F.arrays_zip("begins", "ends"), lambda s: F.struct((F.col("start") + s["begins"]).alias("begin"), (F.col("start") + s["ends"] + further).alias("end")))
    out = base.stored(hits.select("k1", "k2", moved.alias("spans")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans")), "repeated-spans")
    for path in (again.scratch_path, different.scratch_path, *made):
        delete(spark, path)
    return out


def merge_spans(begins: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal runs of the union of the spans; spans that touch are one run."""
    order = np.argsort(begins, kind="stable")
    b, e = begins[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate([[True], b[1:] > e[:-1]]))
    return b[first].tolist(), e[np.append(first[1:] - 1, len(e) - 1)].tolist()


def without(data: bytes, begins: list[int], ends: list[int]) -> bytes:
    at, kept = 0, []
    for b, e in zip(begins, ends, strict=True):
        kept.append(data[at:b])
        at = e
    return b"".join([*kept, data[at:]])


def whole_characters(data: bytes, begins: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """The spans without the parts of characters at their ends; empty ones go."""
    out: tuple[list[int], list[int]] = ([], [])
    for b, e in zip(begins, ends, strict=True):
        while b < e and data[b] & 0xC0 == 0x80:
            b += 1
        while b < e < len(data) and data[e] & 0xC0 == 0x80:
            e -= 1
        if b < e:
            out[0].append(b)
            out[1].append(e)
    return out


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", text: bool = False, **bounds) -> DataFrame:
    """Return ``carry``, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept_text`` if ``text``), a row for each input row.

    Every byte is removed that a ``length``-byte string covers which also starts anywhere else in the table, the same
    text included; overlaps count, and all strings are judged on the input. Matches never cross texts. A null text
    counts as empty; repeated rows repeat each other; ids may be null; an empty table gives an empty result.
    ``kept_text`` keeps the characters that a span's ends would cut through. A carried column that has the name of a
    result column gives way to it; no other name is reserved.
    """
    own = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 4 + text]
    carry = tuple(c for c in carry if c.lower() not in own)
    return _cut(docs, carry, length, gram, id_column, text_column, text, bounds).select(*base.unpacked(carry), *own)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text", **bounds) -> DataFrame:
    """``docs`` with what :func:`remove_repeats` keeps of each text: all rows, all columns, whatever their names.

    A null text stays null; a text that is removed as a whole becomes empty.
    """
    cut = _cut(docs, tuple(docs.columns), length, gram, id_column, text_column, True, bounds)
    return cut.select(*[F.when(x.isNotNull(), F.col("kept_text")).alias(c) if c == text_column else x for c, x in zip(docs.columns, base.unpacked(docs.columns), strict=True)])


def _cut(docs: DataFrame, carry: tuple[str, ...], length: int, gram: int, id_column: str, text_column: str, text: bool, bounds: dict) -> DataFrame:
    """The packed columns ``carry`` as ``row``, and the results."""
    base.ship(docs.sparkSession)
    rows = keyed(docs, carry, id_column, text_column)
    joined = rows.join(repeated_spans(rows, length, gram, **bounds).hint("merge"), ["k1", "k2"], "left")
    picked = joined.select("row", "text", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.slices(batches):
            out: list[list] = [[] for _ in names]
            for t, b, e in zip(base.text_of(batch).to_pylist(), batch.column("begins").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                data = t.encode()
                b, e = merge_spans(np.array(b), np.array(e)) if b else ([], [])
                whole = without(data, *whole_characters(data, b, e)).decode() if b and text else t
                values = (len(data), sum(e) - sum(b), len(b), hashlib.sha256(without(data, b, e)).hexdigest(), whole)
                for column, value in zip(out, values, strict=False):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], ["row", *names])

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 4 + text]
    schema = f"row {picked.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * text
    return picked.mapInArrow(run, schema)
