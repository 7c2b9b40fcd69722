"""A language model in an Elias-Fano n-gram trie, counted, built and queried in shards.

Level 1 holds the words (ordered by a 64-bit hash: a word's number is its rank); hashes and running totals of the counts
are Elias-Fano sequences, and smoothed counts are quantised (exact counts are read only for totals). Level 2 holds, for
each word as context, the numbers of its successors; level 3, for each pair of level 2 as context (a pair's number is
its place there), the numbers of the words after it. In both the pointers (where a context's successors begin) and the
successors are Elias-Fano sequences; successors are stored relative to their context, as the last value of the context
before plus the number, which keeps the whole level monotone. A lookup is a successor search for that sum. Smoothed
probabilities, and level 3's weights of what is left, are quantised to 256 levels a shard. Words are numbered in 32 bits;
training raises beyond that.

p(w | v) = max(c(v w) - D, 0) / c(v) + D * n(v) / c(v) * p(w), where n(v) counts the different successors of v and
p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)); an unknown context leaves p(w). p(w | u v) is the same with c(u v), n(u v)
and p(w | v) in their places. The end of a text is the context of the next text's first word; no text's words are the
context of another's, so a first word has no pair before it, and a second word the pair (end, first word).

Counting: each task sends, to every shard, sorted and compressed arrays of keys and counts; a shard covers a range
of pairs, with the triples that begin with them, and merges arrays as they come. The successors of a frequent word (with
more than a shard's share of all tokens) are cut over several shards, and so are the words after a frequent pair, which
have files of their own: no task holds all of a hot word's or pair's. Frequent pairs are found while words are counted:
each slice of text reports pairs with half that share of its tokens, so no pair with the whole share of all tokens goes
unreported, and the sums of the reports pick at most twice as many pairs as there are shards. Shards are files in the
shared folder; scoring maps them into memory and reads what it needs.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .elias_fano import EliasFano

DISCOUNT = 0.75
#: Hash of the end token: of a space, which no word contains.
END = xxhash.xxh64_intdigest(b" ")
#: Words are numbered in 32 bits.
WORD_NUMBERS = 1 << 32
#: Keys that a counting task holds before it sends them.
HELD = 4_000_000
BATCH = 4 << 20


@dataclass
class Tokens:
    """Tokens of a slice: different words' hashes, and of each token its index there; each text ends in END."""

    hashes: np.ndarray
    codes: np.ndarray
    starts: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    """Lower-case A-Z, split at ASCII white space, add the end token to each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = np.asarray(parts.offsets).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64)
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    kept = np.array([len(w) > 0 for w in words] + [True])[codes] if len(codes) else np.zeros(0, bool)
    sizes = np.diff(np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]])
    codes = codes[kept]
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
    out = np.full(len(codes) + len(sizes), len(words), np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)] = codes
    digest = xxhash.xxh64_intdigest
    return Tokens(np.array([digest(w) for w in words] + [END], np.uint64), out, starts)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of equal weight, and counts, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return struct.pack("<q", len(keys)) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack("<q", data[:8])[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    side = lambda x: np.ascontiguousarray(x.reshape(8, n).T).reshape(-1).view("<u8")
    return np.cumsum(side(planes[: 8 * n]), dtype=np.uint64), side(planes[8 * n :]).astype(np.int64)


def pack_triples(pairs: np.ndarray, words: np.ndarray, counts: np.ndarray) -> bytes:
    """Like :func:`pack`, with a word to each (repeated) pair."""
    gaps = np.diff(pairs, prepend=np.uint64(0)).astype("<u8")
    planes = b"".join(x.view(np.uint8).reshape(len(pairs), -1).T.tobytes() for x in (gaps, words.astype("<u4"), counts.astype("<u4")))
    return struct.pack("<q", len(pairs)) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_triples(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = struct.unpack("<q", data[:8])[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8)
    side = lambda x, kind: np.ascontiguousarray(x.reshape(-1, n).T).reshape(-1).view(kind)
    return np.cumsum(side(planes[: 8 * n], "<u8"), dtype=np.uint64), side(planes[8 * n : 12 * n], "<u4"), side(planes[12 * n :], "<u4").astype(np.int64)


def merged_triples(pairs: np.ndarray, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different (pair, word) and the sums of their counts."""
    different, at = np.unique(pairs, return_inverse=True)
    keys, counts = merged(at.astype(np.uint64) << np.uint64(32) | words, counts)
    return different[(keys >> np.uint64(32)).astype(np.int64)], (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts


class TripleSender:
    """What :class:`Sender` is for keys, for triples: they go to the shard of the pair they begin with.

    Those of a frequent pair go to its parts, which are numbered behind the shards.
    """

    def __init__(self, bounds: np.ndarray, heavy: Heavy):
        self.bounds, self.heavy, self.parts, self.held = bounds, heavy, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.held += len(columns[0])
        if self.held >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        columns = merged_triples(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))
        self.parts, self.held = [], 0
        frequent = self.heavy.index(columns[0])
        own = frequent >= 0
        yield from self.cut(columns[0][~own], self.bounds, [c[~own] for c in columns], 0)
        yield from self.cut(Heavy.keys(frequent[own], columns[1][own]), self.heavy.cuts, [c[own] for c in columns], len(self.bounds))

    @staticmethod
    def cut(keys: np.ndarray, bounds: np.ndarray, columns: list[np.ndarray], first: int) -> Iterator[pa.RecordBatch]:
        cuts = np.concatenate([np.searchsorted(keys, bounds), [len(keys)]])
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int32()), pa.array([None], pa.binary()), pa.array([pack_triples(*(c[a:b] for c in columns))], pa.binary())], ["shard", "data", "triples"])


class Sender:
    """Gathers keys and counts, and yields a packed array for each shard once enough are held, and at the end."""

    def __init__(self, bounds: np.ndarray):
        self.bounds, self.keys, self.counts, self.held = bounds, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        keys, counts = merged(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.held = [], [], 0
        cuts = np.concatenate([np.searchsorted(keys, self.bounds), [len(keys)]])
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(keys[a:b], counts[a:b])], pa.binary())], ["shard", "data"])


class Gathered:
    """Sorted arrays merged as they come: what waits to be merged is never more than what is, or HELD."""

    def __init__(self, merge: Callable[..., tuple[np.ndarray, ...]], *empty: np.ndarray):
        self.merge, self.whole, self.parts, self.waiting = merge, empty, [], 0

    def add(self, part: tuple[np.ndarray, ...]) -> None:
        self.parts.append(part)
        self.waiting += len(part[0])
        if self.waiting > max(HELD, len(self.whole[0])):
            self.all()

    def all(self) -> tuple[np.ndarray, ...]:
        if self.parts:
            self.whole = self.merge(*(np.concatenate(c) for c in zip(self.whole, *self.parts, strict=True)))
            self.parts, self.waiting = [], 0
        return self.whole


def no_keys() -> Gathered:
    return Gathered(merged, np.zeros(0, np.uint64), np.zeros(0, np.int64))


def no_triples() -> Gathered:
    return Gathered(merged_triples, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))


def frequent_pairs(t: Tokens, n: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, next word, count) of the pairs that are a ``share``-th of a slice's tokens or more, as places in its hashes.

    ``n`` counts the words. The end of a text comes before the next one's first word; nothing comes after a pair that an
    end closes, so these are left out.
    """
    end = len(t.hashes) - 1
    often = n * share >= len(t.codes)
    before = np.concatenate([[end], t.codes[:-1]])
    both = often[before] & often[t.codes] & (t.codes != end)
    pair, count = np.unique(before[both] * len(t.hashes) + t.codes[both], return_counts=True)
    kept = count * share >= len(t.codes)
    return pair[kept] // len(t.hashes), pair[kept] % len(t.hashes), count[kept]


def quantised(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each, what the codes stand for)."""
    book = levels(logs).astype(np.float32)
    return np.searchsorted((book[1:] + book[:-1]) / 2, logs.astype(np.float32)).astype(np.uint8), book


def sequences(context: np.ndarray, n_contexts: int, word: np.ndarray) -> tuple[np.ndarray, EliasFano, EliasFano]:
    """(successors of each context, pointers, successors relative to their context) of sorted pairs of numbers."""
    sizes = np.bincount(context, minlength=n_contexts)
    pointers = np.concatenate([[0], np.cumsum(sizes)])
    last = np.zeros(n_contexts, np.uint64)
    ends = np.flatnonzero(sizes)
    last[ends] = word[pointers[ends + 1] - 1] + np.uint64(1)
    shift = np.concatenate([[np.uint64(0)], np.cumsum(last, dtype=np.uint64)])[:-1]
    return sizes, EliasFano.build(pointers), EliasFano.build(word + np.repeat(shift, sizes))


def found(pointers: EliasFano, successors: EliasFano, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each word among its context's successors, in the whole level, or -1; how many that context has)."""
    if not len(context):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Look-ups come sorted by context: what depends on the context alone is read once a run of equal ones.
    new = np.concatenate([[True], context[1:] != context[:-1]])
    run, own = np.cumsum(new) - 1, context[new]
    begin, end = pointers.access(own).astype(np.int64), pointers.access(own + 1).astype(np.int64)
    shift = np.zeros(len(own), np.uint64)
    inner = np.flatnonzero((begin > 0) & (begin < end))
    shift[inner] = successors.access(begin[inner] - 1) + np.uint64(1)
    place = np.full(len(context), -1, np.int64)
    some = np.flatnonzero((begin < end)[run] & (word >= 0))
    if len(some):
        k = run[some]
        at = successors.index(word[some].astype(np.uint64) + shift[k])
        hit = (at < end[k]) & (at >= begin[k])
        place[some[hit]] = at[hit]
    return place, (end - begin)[run]


def save(root: str, kind: str, head: dict, arrays: list[np.ndarray]) -> str:
    """Write arrays one after the other behind a JSON header; the name is new, so a retried task harms no reader."""
    files, path = pafs.FileSystem.from_uri(root)
    files.create_dir(path, recursive=True)
    name = f"{kind}-{uuid.uuid4().hex}"
    head = json.dumps(head | {"arrays": [[str(a.dtype), len(a)] for a in arrays]}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    with files.open_output_stream(f"{path}/{name}") as out:
        out.write(struct.pack("<q", len(head)) + head)
        for a in arrays:
            data = np.ascontiguousarray(a).tobytes()
            out.write(data + bytes(-len(data) % 64))
    return name


def open_mapped(root: str, name: str) -> tuple[dict, list[np.ndarray]]:
    """Header and arrays of a file, mapped into memory (a store that can't be mapped is copied to a local file first)."""
    files, path = pafs.FileSystem.from_uri(root)
    local = f"{path}/{name}"
    if not isinstance(files, pafs.LocalFileSystem):
        local = os.path.join(tempfile.mkdtemp(prefix="tidemark-lm-"), name)
        pafs.copy_files(f"{path}/{name}", local, source_filesystem=files, destination_filesystem=pafs.LocalFileSystem())
    raw = np.asarray(np.memmap(local, np.uint8, "r"))
    if local != f"{path}/{name}":
        os.remove(local)  # the mapping keeps the data
    n = struct.unpack("<q", raw[:8].tobytes())[0]
    head = json.loads(raw[8 : 8 + n].tobytes())
    at, arrays = 8 + n, []
    for kind, size in head["arrays"]:
        dtype = np.dtype(kind)
        arrays.append(raw[at : at + size * dtype.itemsize].view(dtype))
        at += -(-size * dtype.itemsize // 64) * 64
    return head, arrays


@dataclass
class Model:
    """Names and ranges of the shards, and the totals; a few numbers for each shard."""

    root: str
    words: list[tuple[int, str, int, int]]  # first hash, file, number of its first word, words
    level: list[tuple[int, str]]  # first key, file
    split: dict[int, int]  # contexts cut over shards: how many different successors
    n_tokens: int
    n_words: int
    order: int = 3
    heavy: list[tuple[int, int, int]] = field(default_factory=list)  # hashes of a frequent pair, parts of the words after it
    tails: dict[int, tuple[str, int, int]] = field(default_factory=dict)  # of a part: file, different words, occurrences


class Vocabulary:
    """Level 1: numbers, counts and quantised smoothed counts of words by hash."""

    def __init__(self, root: str, shards: list[tuple[int, str, int, int]]):
        self.first = np.array([s[0] for s in shards], np.uint64)
        self.offset = np.array([s[2] for s in shards] + [shards[-1][2] + shards[-1][3]] if shards else [0], np.int64)
        self.parts = [self.open(root, s[1]) for s in shards]

    @staticmethod
    def save(root: str, hashes: np.ndarray, counts: np.ndarray) -> str:
        h, c = EliasFano.build(hashes - hashes[0]), EliasFano.build(np.concatenate([[0], np.cumsum(counts)]))
        codes, book = quantised(np.log10(counts + 0.5))
        head = {"n": len(hashes), "first": int(hashes[0]), "last": int(hashes[-1]), "hash_bits": h.l, "count_bits": c.l}
        return save(root, "words", head, [*h.arrays(), *c.arrays(), codes, book])

    @staticmethod
    def open(root: str, name: str) -> tuple[dict, EliasFano, EliasFano, np.ndarray, np.ndarray]:
        head, a = open_mapped(root, name)
        return head, EliasFano(head["n"], head["hash_bits"], *a[0:3]), EliasFano(head["n"] + 1, head["count_bits"], *a[3:6]), a[6], 10.0 ** np.asarray(a[7]).astype(float)

    def counts(self, number: np.ndarray) -> np.ndarray:
        """How often the words of these numbers occur."""
        part, out = np.searchsorted(self.offset, number, "right") - 1, np.empty(len(number), np.int64)
        for k in np.unique(part).tolist():
            own = part == k
            at = number[own] - self.offset[k]
            out[own] = (self.parts[k][2].access(at + 1) - self.parts[k][2].access(at)).astype(np.int64)
        return out

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, quantised count + 0.5) of each hash; the latter is exactly 0.5 where it is unknown."""
        order = np.argsort(hashes)
        asked = hashes[order]
        number, smooth = np.full(len(asked), -1, np.int64), np.full(len(asked), 0.5)
        cuts = np.concatenate([np.searchsorted(asked, self.first), [len(asked)]])
        for k, (head, own, _, codes, book) in enumerate(self.parts):
            some = np.arange(cuts[k], cuts[k + 1])
            some = some[(asked[some] >= np.uint64(head["first"])) & (asked[some] <= np.uint64(head["last"]))]
            if len(some):
                at = own.index(asked[some] - np.uint64(head["first"]))
                some, at = some[at >= 0], at[at >= 0]
                number[some] = at + self.offset[k]
                smooth[some] = book[codes[at]]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return number[back], smooth[back]


class Heavy:
    """Frequent pairs by number, and where the words after them are cut into parts."""

    def __init__(self, known: Vocabulary, pairs: list[tuple[int, int, int]], n_words: int):
        u, v = (known.look(np.array([p[k] for p in pairs], np.uint64))[0].astype(np.uint64) for k in (0, 1))
        key = u << np.uint64(32) | v
        order = np.argsort(key)
        self.pairs = key[order]
        cuts = [i << 32 | k * n_words // pairs[j][2] for i, j in enumerate(order.tolist()) for k in range(pairs[j][2])]
        self.cuts = np.array(cuts, np.uint64)

    @staticmethod
    def keys(index: np.ndarray, word: np.ndarray) -> np.ndarray:
        return index.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)

    def index(self, pairs: np.ndarray) -> np.ndarray:
        """The place of each pair (first << 32 | second) among the frequent ones, or -1."""
        if not len(self.pairs):
            return np.full(len(pairs), -1, np.int64)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, at, -1)

    def part(self, index: np.ndarray, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.keys(index, word), "right") - 1


class Tail:
    """Level 3 of one part of a frequent pair: words in the order of their numbers, with discounted counts."""

    def __init__(self, root: str, name: str):
        head, a = open_mapped(root, name)
        self.first, self.last, self.words = head["first"], head["last"], EliasFano(head["n"], head["bits"], *a[0:3])
        self.codes, self.book = a[3], 10.0 ** np.asarray(a[4]).astype(float)

    @staticmethod
    def save(root: str, words: np.ndarray, counts: np.ndarray) -> str:
        s = EliasFano.build((words - words[0]).astype(np.uint64))
        codes, book = quantised(np.log10(counts - DISCOUNT))
        return save(root, "tail", {"n": len(words), "first": int(words[0]), "last": int(words[-1]), "bits": s.l}, [*s.arrays(), codes, book])

    def look(self, word: np.ndarray) -> np.ndarray:
        """The discounted count of each word, or 0."""
        out = np.zeros(len(word))
        some = np.flatnonzero((word >= self.first) & (word <= self.last))
        if len(some):
            at = self.words.index((word[some] - self.first).astype(np.uint64))
            out[some[at >= 0]] = self.book[self.codes[at[at >= 0]]]
        return out


def levels(logs: np.ndarray, n: int = 256) -> np.ndarray:
    """At most n levels: all different values if they are few, else half by rank among them, half at even steps."""
    different = np.unique(logs)
    if len(different) <= n:
        return different
    by_rank = different[np.linspace(0, len(different) - 1, n // 2).round().astype(int)]
    return np.unique(np.concatenate([by_rank, np.linspace(different[0], different[-1], n // 2 + 2)[1:-1]]))[:n]


class Level:
    """Levels 2 and 3 of one shard."""

    def __init__(self, root: str, name: str):
        head, a = open_mapped(root, name)
        self.first = head["first"]
        self.contexts = head["contexts"]
        self.pointers = EliasFano(head["contexts"] + 1, head["pointer_bits"], *a[0:3])
        self.successors = EliasFano(head["n"], head["successor_bits"], *a[3:6])
        self.codes, self.book = a[6], 10.0 ** np.asarray(a[7]).astype(float)
        self.deep = head["n3"] > 0
        if self.deep:
            self.pointers3 = EliasFano(head["n"] + 1, head["pointer_bits3"], *a[8:11])
            self.successors3 = EliasFano(head["n3"], head["successor_bits3"], *a[11:14])
            self.codes3, self.book3 = a[14], 10.0 ** np.asarray(a[15]).astype(float)
            #: What a pair leaves to level 2; 1 (at the end of the book) where nothing follows it.
            self.rest, self.rest_book = a[16], np.append(10.0 ** np.asarray(a[17]).astype(float), 1.0)

    @staticmethod
    def save(root: str, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, triples: tuple[np.ndarray, np.ndarray, np.ndarray]) -> str:
        """Keys are context << 32 | successor, sorted; totals: how often each key's context occurs."""
        context = (keys >> np.uint64(32)).astype(np.int64)
        first = int(context[0])
        n_contexts = int(context[-1]) - first + 1
        _, p, s = sequences(context - first, n_contexts, keys & np.uint64(0xFFFFFFFF))
        codes, book = quantised(np.log10((counts - DISCOUNT) / totals))
        head = {"first": first, "contexts": n_contexts, "n": len(keys), "pointer_bits": p.l, "successor_bits": s.l, "n3": len(triples[0])}
        arrays = [*p.arrays(), *s.arrays(), codes, book]
        if len(triples[0]):
            pair, word, n = triples
            place = np.searchsorted(keys, pair)  # every pair that a word follows is one of level 2
            sizes, p3, s3 = sequences(place, len(keys), word.astype(np.uint64))
            follow = np.bincount(place, weights=n, minlength=len(keys))
            codes3, book3 = quantised(np.log10((n - DISCOUNT) / follow[place]))
            some = np.flatnonzero(sizes)
            rest_codes, rest_book = quantised(np.log10(DISCOUNT * sizes[some] / follow[some]))
            rest = np.full(len(keys), len(rest_book), np.uint16)
            rest[some] = rest_codes
            head |= {"pointer_bits3": p3.l, "successor_bits3": s3.l}
            arrays += [*p3.arrays(), *s3.arrays(), codes3, book3, rest.astype(np.uint8) if len(rest_book) < 256 else rest, rest_book]
        return save(root, "level", head, arrays)

    def look(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(discounted share or 0, different successors in this shard, place or -1) of each pair."""
        share, different, place = np.zeros(len(context)), np.zeros(len(context), np.int64), np.full(len(context), -1, np.int64)
        c = context - self.first
        inside = np.flatnonzero((c >= 0) & (c < self.contexts))
        if len(inside):
            place[inside], different[inside] = found(self.pointers, self.successors, c[inside], word[inside])
            hit = np.flatnonzero(place >= 0)
            share[hit] = self.book[self.codes[place[hit]]]
        return share, different, place

    def look_after(self, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The discounted share (or 0) of each word after the pair at each place."""
        share = np.zeros(len(place))
        if self.deep:
            at = found(self.pointers3, self.successors3, place, word)[0]
            hit = np.flatnonzero(at >= 0)
            share[hit] = self.book3[self.codes3[at[hit]]]
        return share

    def left(self, place: np.ndarray) -> np.ndarray:
        return self.rest_book[self.rest[place]] if self.deep else np.ones(len(place))


class Reader:
    """A model opened for scoring."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Vocabulary(model.root, model.words)
        self.bounds = np.array([b for b, _ in model.level], np.uint64)
        self.levels: dict[int, Level] = {}
        self.split = np.array(sorted(model.split), np.int64)
        self.split_sizes = np.array([model.split[k] for k in sorted(model.split)], np.int64)
        self.heavy = Heavy(self.words, model.heavy, model.n_words)
        self.tails: dict[int, Tail] = {}
        #: Different words after each frequent pair, and how many words in all.
        self.followers, self.follow = np.zeros(len(self.heavy.pairs)), np.zeros(len(self.heavy.pairs))
        for part, (_, different, n) in model.tails.items():
            pair = int(self.heavy.cuts[part] >> np.uint64(32))
            self.followers[pair] += different
            self.follow[pair] += n

    def by_shard(self, shard: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, Level, np.ndarray]]:
        """(number, level, where) of each shard that occurs (-1 is none); within it by ``key``, so that look-ups go forward."""
        order = np.argsort(shard.astype(np.int64) << np.int64(40) | np.maximum(key, 0))
        cuts = np.searchsorted(shard[order], np.arange(len(self.bounds) + 1))
        for k in np.unique(shard[order[cuts[0] :]]).tolist():
            if k not in self.levels:
                self.levels[k] = Level(self.model.root, self.model.level[k][1])
            yield k, self.levels[k], order[cuts[k] : cuts[k + 1]]

    def pairs(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """(discounted share, different successors of the context, shard, place), for pairs of numbers (-1: unknown)."""
        share, different = np.zeros(len(context)), np.zeros(len(context), np.int64)
        shard, place = np.full(len(context), -1, np.int64), np.full(len(context), -1, np.int64)
        if not len(self.bounds):
            return share, different, shard, place
        known = np.flatnonzero(context >= 0)
        key = (context[known].astype(np.uint64) << np.uint64(32)) | np.maximum(word[known], 0).astype(np.uint64)
        shard[known] = np.searchsorted(self.bounds, key, "right") - 1
        for _, level, own in self.by_shard(shard, context):
            share[own], different[own], place[own] = level.look(context[own], word[own])
        if len(self.split):
            at = np.minimum(np.searchsorted(self.split, context), len(self.split) - 1)
            hit = self.split[at] == context
            different[hit] = self.split_sizes[at[hit]]
        return share, different, shard, place

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(n_tokens, n_known, base_score, score) of each text."""
        t = tokens(texts)
        if not len(t.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        number, smooth = self.words.look(t.hashes)
        count = np.zeros(len(number), np.int64)
        count[number >= 0] = self.words.counts(number[number >= 0])
        total = self.model.n_tokens + 0.5 * (self.model.n_words + 1)
        plain, single = (count + 0.5) / total, smooth / total
        before = np.empty_like(t.codes)
        before[0], before[1:] = len(t.hashes) - 1, t.codes[:-1]
        both, back = np.unique(before * len(t.hashes) + t.codes, return_inverse=True)
        u, w = both // len(t.hashes), both % len(t.hashes)
        share, different, shard, place = self.pairs(number[u], number[w])
        rest = np.where(count[u] > 0, DISCOUNT * different / np.maximum(count[u], 1), 1.0)
        two = (share + rest * single[w])[back]
        if self.model.order > 2 and len(back) > 1:
            two[1:] = self.third(back, number[u], number[w], shard, place, two, t.starts)[1:]
        logs = np.log10(two)
        size = np.diff(np.concatenate([t.starts, [len(t.codes)]]))
        known = np.add.reduceat((count > 0)[t.codes].astype(np.int64), t.starts)
        return size, known, np.add.reduceat(np.log10(plain)[t.codes], t.starts), np.add.reduceat(logs, t.starts)

    def third(self, back: np.ndarray, context: np.ndarray, word: np.ndarray, shard: np.ndarray, place: np.ndarray, two: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities with level 3, of tokens whose pairs (of ``context`` and ``word``) have the numbers ``back``, from those without."""
        left = np.ones(len(place))
        known = np.flatnonzero(place >= 0)
        frequent = np.full(len(place), -1, np.int64)
        frequent[known] = self.heavy.index(context[known].astype(np.uint64) << np.uint64(32) | word[known].astype(np.uint64))
        own = np.flatnonzero(frequent >= 0)
        left[own] = DISCOUNT * self.followers[frequent[own]] / np.maximum(self.follow[frequent[own]], 1)
        shard = np.where(frequent >= 0, -1, shard)
        kept = np.where(place >= 0, shard, -1)
        for _, level, own in self.by_shard(kept, place):
            left[own] = level.left(place[own])
        out = two.copy()
        # A token whose own pair is unknown can't follow a pair; a first word has none before it.
        inner = np.ones(len(back), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        at = at[place[back[at - 1]] >= 0]
        pair = back[at - 1]
        out[at] = left[pair] * two[at]
        at, pair = at[place[back[at]] >= 0], pair[place[back[at]] >= 0]
        after, again = np.unique(pair << 32 | back[at], return_inverse=True)
        pair, own_pair = after >> 32, after & 0xFFFFFFFF
        share = np.zeros(len(after))
        for _, level, own in self.by_shard(shard[pair], place[pair]):
            share[own] = level.look_after(place[pair[own]], word[own_pair[own]])
        own = np.flatnonzero(frequent[pair] >= 0)
        part = self.heavy.part(frequent[pair[own]], word[own_pair[own]])
        for k in np.unique(part).tolist():
            if k not in self.model.tails:
                continue
            if k not in self.tails:
                self.tails[k] = Tail(self.model.root, self.model.tails[k][0])
            here = own[part == k]
            share[here] = self.tails[k].look(word[own_pair[here]]) / self.follow[frequent[pair[here]]]
        out[at] += share[again]
        return out


_readers: dict[str, Reader] = {}


def reader(model: Model) -> Reader:
    if model.root not in _readers:
        _readers.clear()
        _readers[model.root] = Reader(model)
    return _readers[model.root]


def train(docs: DataFrame, root: str, n_shards: int | None = None, text_column: str = "text", order: int = 3) -> Model:
    """Count all texts of ``docs`` and build the trie under ``root``; the driver gets a few numbers for each shard.

    ``order`` 2 leaves level 3 out.
    """
    spark = docs.sparkSession
    base.ship(spark)
    n_shards = n_shards or max(8, docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    picked = docs.select(docs[text_column].cast("string").alias("text"))
    bounds = (np.arange(n_shards, dtype=object) * (1 << 64) // n_shards).astype(np.uint64)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, often = Sender(bounds), Counter()
        for batch in base.slices(batches, most=BATCH):
            t = tokens(base.text_of(batch))
            n = np.bincount(t.codes, minlength=len(t.hashes))
            if order > 2:
                u, v, c = frequent_pairs(t, n, 2 * n_shards)
                for key, k in zip(zip(t.hashes[u].tolist(), t.hashes[v].tolist(), strict=True), c.tolist(), strict=True):
                    often[key] += k
            yield from (pa.RecordBatch.from_arrays([*b.columns, pa.array([None], pa.binary())], ["shard", "data", "pairs"]) for b in sender.add(t.hashes[n > 0], n[n > 0]))
        yield from (pa.RecordBatch.from_arrays([*b.columns, pa.array([None], pa.binary())], ["shard", "data", "pairs"]) for b in sender.flush())
        if often:
            rows = np.array([(*key, k) for key, k in often.items()], np.uint64)
            shard = np.searchsorted(bounds, rows[:, 0], "right") - 1
            for k in np.unique(shard).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([None], pa.binary()), pa.array([rows[shard == k].tobytes()], pa.binary())], ["shard", "data", "pairs"])

    def save_words(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pairs = no_keys(), Counter()
        for batch in batches:
            for data, some in zip(batch.column("data"), batch.column("pairs"), strict=True):
                if data.is_valid:
                    held.add(unpack(data.as_py()))
                if some.is_valid:
                    for u, v, n in np.frombuffer(some.as_py(), np.uint64).reshape(-1, 3).tolist():
                        pairs[u, v] += n
        keys, counts = held.all()
        total = int(counts.sum())
        often = np.flatnonzero(counts * n_shards >= total)  # n_shards at most; the threshold of all tokens is no lower
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        yield pa.RecordBatch.from_pylist([{
            "shard": key[0].as_py(), "file": Vocabulary.save(root, keys, counts), "words": len(keys), "tokens": total,
            "often": [{"i": i, "n": n} for i, n in zip(often.tolist(), counts[often].tolist(), strict=True)],
            "pairs": [{"u": signed(u), "v": signed(v), "n": n} for (u, v), n in sorted(pairs.items())],
        }], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("words", pa.int64()), ("tokens", pa.int64()),
                       ("often", pa.list_(pa.struct([("i", pa.int64()), ("n", pa.int64())]))), ("pairs", pa.list_(pa.struct([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])))]))

    sent = picked.mapInArrow(count_words, "shard int, data binary, pairs binary")
    found = base.stored(sent.groupBy("shard").applyInArrow(save_words, "shard int, file string, words long, tokens long, often array<struct<i:long,n:long>>, pairs array<struct<u:long,v:long,n:long>>"), "lm-words")
    rows = sorted(found.select("shard", "file", "words", "tokens").collect())
    n_tokens, offset = sum(r["tokens"] for r in rows), 0
    # Words with more than a shard's share of the tokens: fewer than shards. Pairs with half of it: at most twice as many.
    often = {}
    for k, i, n in found.select("shard", F.inline("often")).where(F.col("n") * n_shards > n_tokens).collect():
        often.setdefault(k, []).append((i, n))
    some = found.select(F.inline("pairs")).where(F.col("n") * (2 * n_shards) >= n_tokens).collect()
    # What a slice left unreported is under half a shard's share of its tokens.
    heavy = sorted((u % (1 << 64), v % (1 << 64), -(-(2 * n * n_shards + n_tokens) // (2 * n_tokens))) for u, v, n in some)
    words, cuts, split = [], set(), []
    for r in rows:
        words.append((int(bounds[r["shard"]]), r["file"], offset, r["words"]))
        cuts.add(offset << 32)
        for i, _ in often.get(r["shard"], ()):
            u = offset + i
            split.append(u)
            cuts |= {u << 32, (u + 1) << 32}
        offset += r["words"]
    if offset > WORD_NUMBERS:
        raise ValueError(f"{offset} different words are more than their numbers can tell apart ({WORD_NUMBERS})")
    # A frequent context's successors are cut at even steps of the words' numbers.
    for r, (_, _, begin, _) in zip(rows, words, strict=True):
        for i, n in often.get(r["shard"], ()):
            parts = -(-n * n_shards // n_tokens)
            cuts |= {(begin + i) << 32 | k * offset // parts for k in range(1, parts)}
    cuts = np.array(sorted(cuts), np.uint64)
    n_words = offset

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(root, words)
        sender, triples = Sender(cuts), TripleSender(cuts, Heavy(known, heavy, n_words))
        none = pa.array([None], pa.binary())
        paired = lambda found: (pa.RecordBatch.from_arrays([*b.columns, none], ["shard", "data", "triples"]) for b in found)
        for batch in base.slices(batches, most=BATCH):
            t = tokens(base.text_of(batch))
            number = known.look(t.hashes)[0].astype(np.uint64)
            codes = number[t.codes]
            before = np.concatenate([number[-1:], codes[:-1]])
            both, back, n = np.unique(before << np.uint64(32) | codes, return_inverse=True, return_counts=True)
            yield from paired(sender.add(both, n))
            if order > 2:
                inner = np.ones(len(codes), bool)
                inner[t.starts] = False
                at = np.flatnonzero(inner)
                keys, n = np.unique(back[at - 1].astype(np.uint64) << np.uint64(32) | codes[at], return_counts=True)
                yield from triples.add(both[(keys >> np.uint64(32)).astype(np.int64)], (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), n)
        yield from paired(sender.flush())
        yield from triples.flush()

    split_set = set(split)

    def save_level(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, after, shard = no_keys(), no_triples(), key[0].as_py()
        for batch in batches:
            for data, triples in zip(batch.column("data"), batch.column("triples"), strict=True):
                if data.is_valid:
                    held.add(unpack(data.as_py()))
                if triples.is_valid:
                    after.add(unpack_triples(triples.as_py()))
        keys, counts = held.all()
        if shard >= len(cuts):
            _, word, n = after.all()
            out = (shard, Tail.save(root, word.astype(np.int64), n), None, len(word), int(n.sum()))
        else:
            context = (keys >> np.uint64(32)).astype(np.int64)
            different, back = np.unique(context, return_inverse=True)
            totals = Vocabulary(root, words).counts(different)
            cut = int(context[0]) if int(context[0]) in split_set else None
            out = (shard, Level.save(root, keys, counts, totals[back], after.all()), cut, len(keys), None)
        schema = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("split", pa.int64()), ("successors", pa.int64()), ("follow", pa.int64())])
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, out, strict=True))], schema)

    sent = picked.mapInArrow(count_pairs, "shard int, data binary, triples binary")
    found = sent.groupBy("shard").applyInArrow(save_level, "shard int, file string, split long, successors long, follow long")
    rows = sorted(base.stored(found, "lm-level").collect(), key=lambda r: r["shard"])
    tails = {r["shard"] - len(cuts): (r["file"], r["successors"], r["follow"]) for r in rows if r["shard"] >= len(cuts)}
    rows = [r for r in rows if r["shard"] < len(cuts)]
    sizes: dict[int, int] = {}
    for r in rows:
        if r["split"] is not None:
            sizes[r["split"]] = sizes.get(r["split"], 0) + r["successors"]
    return Model(root, words, [(int(cuts[r["shard"]]), r["file"]) for r in rows], sizes, n_tokens, n_words, order, heavy, tails)


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """Return ``carry``, n_tokens, n_known, train_tokens, base_score and score (log10), a row for each input row.

    A null text counts as empty: one token, the end. An empty table gives an empty result, an empty training table a
    model that knows nothing. A carried column with the name of a result column gives way to it.
    """
    base.ship(docs.sparkSession)
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    carry = tuple(c for c in carry if c.lower() not in names)
    picked = docs.select(base.packed(carry, docs).alias("row"), docs[text_column].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reader(model)
        for batch in base.slices(batches, most=BATCH):
            n, known, plain, own = r.score(base.text_of(batch))
            columns = [batch.column("row"), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.n_tokens)), pa.array(plain), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, ["row", *names])

    scored = picked.mapInArrow(run, f"row {picked.schema['row'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(*base.unpacked(carry), *names)


def score_held_out(docs: DataFrame, folds: int = 5, fold: int = 1, root: str | None = None) -> DataFrame:
    """Learn from the documents outside a fold of crc32 of the id (a null id is learnt from), and score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Repeated rows are learnt from as
    often as they occur.
    """
    root = root or base.scratch(docs.sparkSession, "lm")
    out = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % folds == fold, F.lit(False))
    rows = docs.select(docs["doc_id"], docs["text"], out.alias("held_out"))
    model = train(rows.where(~F.col("held_out")), root)
    return score(rows, model, ("doc_id", "held_out"))
