"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, and how usual that is.

The tokens of two tokenizers over the same bytes form a bipartite graph: two tokens are joined where their byte ranges
overlap. Union-find over it gives the connected components, and those are exactly the minimal groups, the shortest
stretches that both tokenizers end together. The members of a component expand to links, all its pairs of an A and a B
token; links are counted per distinct id on either side, so that a long component doesn't cost its square.

Where both tokenizers must start anew (before lone spaces and line feeds, see :mod:`.segments`) a text falls into
segments that can be aligned one by one; a block aligns equal ones once, and all of them at the same time.

How many documents hold a pair is counted in three steps, none of which moves a row for each pair of a document:

1. A task aligns its documents in blocks of a few megabytes of text. A block keeps a sorted list of its pairs with the
   number of documents that hold them, and each document the places of its pairs in that list, with their links.
2. The lists are summed pair by pair, and the highest count of each A id is found: at most one row an id of A's
   vocabulary, which is what bounds the broadcast.
3. Counts return to the blocks that asked, a block meets its documents again, and their sums are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base, packing, segments, token_counts

#: What sentencepiece writes for a space.
SPACE = "▁"
#: Bytes of text in a block; a longer text makes a block of its own.
BLOCK_BYTES = 4 << 20
#: Links of a group that are written out; those of a larger one are counted by distinct ids first.
WRITTEN = 1024
NOTHING = np.zeros(0, np.int64)
_aligners: dict[tuple[str, str], Aligner] = {}


def components(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Union-find over the edges x-y of n vertices: the smallest vertex of each one's component.

    All edges hook at once the root of one end below that of the other, then all paths are halved until they end at
    roots; rounds grow with the logarithm of the largest component.
    """
    parent = np.arange(n)
    while True:
        a, b = parent[x], parent[y]
        if (a == b).all():
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while ((up := parent[parent]) != parent).any():
            parent = up


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of the numbers of each."""
    if not len(keys):
        return keys, numbers
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(numbers[order], first)


def before(lengths: np.ndarray) -> np.ndarray:
    """Running totals, from zero to all."""
    return np.concatenate([[0], np.cumsum(lengths)])


def joined(parts: pa.Array, lengths: np.ndarray, separator: str) -> pa.Array:
    """Runs of so many strings, each as one string."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(before(lengths), pa.int32()), parts), separator)


class Tokens:
    """The ids of many segments, one after the other: ``ids`` and how many each segment has."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, table: pa.Array):
        self.ids, self.counts, self.table = ids, counts, table
        self.sizes = np.asarray(pc.binary_length(table)).astype(np.int64)[ids]

    def written(self) -> np.ndarray:
        """The bytes that the tokens stand for."""
        taken = self.table.take(pa.array(self.ids))  # its values lie one after the other in its last buffer
        return np.frombuffer(taken.buffers()[2], np.uint8, self.sizes.sum()) if self.sizes.any() else np.zeros(0, np.uint8)

    def bytes_each(self) -> np.ndarray:
        total = before(self.sizes)
        ends = before(self.counts)
        return total[ends[1:]] - total[ends[:-1]]

    def of(self, chosen: np.ndarray) -> Tokens:
        return Tokens(self.ids[np.repeat(chosen, self.counts)], self.counts[chosen], self.table)


class Aligned:
    """What a block knows of its different segments.

    ``ok``: both tokenizers give back its bytes; ``sizes``: its A tokens, B tokens, groups and links; ``groups``: these
    as text; ``held`` and ``starts``: how many of ``keys`` (pairs, some repeated) and ``links`` are its own, and where.
    """

    def __init__(self, texts: list[bytes], a: Tokens, b: Tokens, width: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.ok = (a.bytes_each() == lengths) & (b.bytes_each() == lengths)
        for side in (a, b):  # of those with as many bytes, whether they are the same
            text = np.frombuffer(b"".join(t for t, ok in zip(texts, self.ok.tolist(), strict=True) if ok), np.uint8)
            places = np.flatnonzero(self.ok)
            differs = np.flatnonzero(text != side.of(self.ok).written())
            self.ok[places[np.searchsorted(np.cumsum(lengths[places]), differs, "right")]] = False
        a, b = a.of(self.ok), b.of(self.ok)
        ends_a, ends_b, n = np.cumsum(a.sizes), np.cumsum(b.sizes), len(a.ids)
        ends = np.union1d(ends_a, ends_b)  # between two ends lies one token of either
        root = components(np.searchsorted(ends_a, ends), n + np.searchsorted(ends_b, ends), n + len(b.ids))
        # A component lies in one piece and its smallest vertex is its first A token, so groups are in order.
        firsts, group_a = np.unique(root[:n], return_inverse=True)
        group_b = np.searchsorted(firsts, root[n:])
        in_a, in_b = np.bincount(group_a, minlength=len(firsts)), np.bincount(group_b, minlength=len(firsts))
        word = np.repeat(np.flatnonzero(self.ok), a.counts)[firsts] if n else NOTHING
        total = np.bincount(word, minlength=len(texts))
        each = in_a * in_b
        of_word = before(each)
        at = before(total)
        self.sizes = np.zeros((len(texts), 4), np.int64)
        self.sizes[self.ok, 0], self.sizes[self.ok, 1] = a.counts, b.counts
        self.sizes[:, 2], self.sizes[:, 3] = total, of_word[at[1:]] - of_word[at[:-1]]
        names = pa.array([str(i) for i in range(max(len(a.table), len(b.table)))])
        group = pc.binary_join_element_wise(joined(names.take(pa.array(a.ids)), in_a, ","), joined(names.take(pa.array(b.ids)), in_b, ","), "|")
        self.groups = joined(group, total, ";").cast(pa.binary()).to_pylist()
        self._links(word, a.ids, b.ids, before(in_a)[:-1], before(in_b)[:-1], in_a, in_b, width)

    def _links(self, word: np.ndarray, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, width: int) -> None:
        small = in_a * in_b <= WRITTEN
        each = (in_a * in_b)[small]
        k = spread(np.zeros(len(each), np.int64), each)
        columns = np.repeat(in_b[small], each)
        keys = [a[np.repeat(at_a[small], each) + k // columns] * width + b[np.repeat(at_b[small], each) + k % columns]]
        links, words = [np.ones(len(k), np.int64)], [np.repeat(word[small], each)]
        for g in np.flatnonzero(~small).tolist():
            (ua, ca), (ub, cb) = (np.unique(x, return_counts=True) for x in (a[at_a[g] : at_a[g] + in_a[g]], b[at_b[g] : at_b[g] + in_b[g]]))
            keys.append((ua[:, None] * width + ub[None, :]).ravel())
            links.append((ca[:, None] * cb[None, :]).ravel())
            words.append(np.full(len(keys[-1]), word[g]))
        words, self.keys, self.links = np.concatenate(words), np.concatenate(keys), np.concatenate(links)
        if not small.all():
            order = np.argsort(words, kind="stable")
            words, self.keys, self.links = words[order], self.keys[order], self.links[order]
        self.held = np.bincount(words, minlength=len(self.ok))
        self.starts = before(self.held)[:-1]


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import json

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, vocab = packing._byte_letters(), self.a.get_vocab()
        a_tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_tokens = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_table, self.b_table = pa.array(a_tokens, pa.binary()), pa.array(b_tokens, pa.binary())
        #: Ids of B, and so the factor of A's in the key of a pair.
        self.width = len(pieces)
        self.space = self.b.piece_to_id(SPACE)
        probe = "a b\nc"
        whole = b"".join(b_tokens[i] for i in self.b.encode(probe)) == b" " + probe.encode()
        #: Whether segments can be aligned one by one: no token reaches over a place where texts are cut.
        self.cuts = whole and token_counts.splits_safely(a_path) and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        #: A much faster form of A, for files whose ids follow their merges.
        self.fast = None
        if self.cuts and packing.ids_follow_merges(spec["model"]):
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: what ByteLevel splits by
            self.fast = tiktoken.Encoding("alignment", pat_str=pattern, mergeable_ranks={a_tokens[i]: i for t, i in spec["model"]["vocab"].items() if t not in special}, special_tokens={})

    def cut(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
        """(rows, offsets, places, segments): row rows[i] and the space before it are segments[places[offsets[i] : offsets[i + 1]]]."""
        if not self.cuts:
            yield np.arange(len(texts)), np.arange(len(texts) + 1), np.arange(len(texts)), [" " + t for t in texts.to_pylist()]
            return
        uneven = np.asarray(pc.match_substring_regex(texts, segments._UNEVEN))
        for rows, with_space in ((np.flatnonzero(~uneven), False), (np.flatnonzero(uneven), True)):
            own = texts.take(pa.array(rows))
            for at, offsets, parts in segments.groups(pc.binary_join_element_wise(" ", own, "") if with_space else own):
                # Elsewhere only the first segment of a text can begin with something else than a space or line feed.
                words = parts.dictionary.to_pylist()
                yield rows[at], offsets.astype(np.int64), np.asarray(parts.indices).astype(np.int64), words if with_space else [w if w[:1] in (" ", "\n") else " " + w for w in words]

    def encode_a(self, words: list[str]) -> Tokens:
        """A's ids of segments. Those that a cut may follow and precede are encoded as one text."""
        alone = np.array([self.fast is None or len(w) < 2 or w[1].isspace() or w[-1].isspace() for w in words], bool)
        counts, parts = np.zeros(len(words), np.int64), []
        sizes = np.asarray(pc.binary_length(self.a_table)).astype(np.int64)
        together = [w for w, single in zip(words, alone.tolist(), strict=True) if not single]
        made = []
        for run in segments.chunks(together, segments.sizes_of(together)) if together else ():
            ids = self.fast.encode_to_numpy("".join(run)).astype(np.int64)
            ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(segments.sizes_of(run)))
            made.append(np.diff(ends + 1, prepend=0))
            parts.append(ids)
        if made:
            counts[~alone] = np.concatenate(made)
        single = [words[k] for k in np.flatnonzero(alone)]
        own = [np.array(e.ids, np.int64) for run in (segments.chunks(single, segments.sizes_of(single)) if single else ()) for e in self.a.encode_batch_fast(run, add_special_tokens=False)]
        counts[alone] = [len(x) for x in own]
        ids, flat, total = np.zeros(counts.sum(), np.int64), np.repeat(alone, counts), NOTHING
        ids[~flat] = np.concatenate([*parts, total])
        ids[flat] = np.concatenate([*own, total])
        return Tokens(ids, counts, self.a_table)

    def encode_b(self, words: list[str]) -> Tokens:
        """B's ids of segments: it puts a space before a text itself, which a segment that begins with a line feed doesn't have."""
        ids = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        ids = [x if w[0] == " " else x[x[:1] == [self.space] :] for w, x in zip(words, ids, strict=True)]
        counts = np.array([len(x) for x in ids], np.int64)
        return Tokens(np.fromiter((i for x in ids for i in x), np.int64, counts.sum()), counts, self.b_table)

    def align(self, words: list[str]) -> Aligned:
        return Aligned([w.encode() for w in words], self.encode_a(words), self.encode_b(words), self.width)


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def packed_numbers(x: np.ndarray) -> bytes:
    """Numbers from zero up in as few bytes each as the largest needs; the first byte says how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or x.max() < 1 << 8 * w or w == 8)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked_numbers(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
BLOCK_SCHEMA = f"block long, {FIELDS}, places binary, links binary, pairs array<long>, holders array<long>"


def blocks(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document, with its pairs' places in its block, and one for each block with its pairs.

    A document's row has no ``pairs``, a block's has nothing else. Places are written as steps from one to the next.
    """
    base.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task = aligner(a_path, b_path), TaskContext.get().partitionId()
        for k, batch in enumerate(base.slices(batches, most=BLOCK_BYTES)):
            yield _block(own, batch.column("doc_id"), base.text_of(batch), (task << 32) + k)

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(run, BLOCK_SCHEMA)


def _block(own: Aligner, ids: pa.Array, texts: pa.Array, block: int) -> pa.RecordBatch:
    n = len(ids)
    sizes, digests = np.zeros((n, 4), np.int64), [""] * n
    document, key, links = [NOTHING], [NOTHING], [NOTHING]
    filled = np.flatnonzero(np.asarray(pc.binary_length(texts)) > 0)
    for rows, offsets, places, words in own.cut(texts.take(pa.array(filled))):
        if not len(rows):
            continue
        rows, found = filled[rows], own.align(words)
        of_row = np.repeat(np.arange(len(rows)), np.diff(offsets))
        ok = np.bincount(of_row[~found.ok[places]], minlength=len(rows)) == 0
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(found.sizes[places], 0)])
        sizes[rows] = (total[offsets[1:]] - total[offsets[:-1]]) * ok[:, None]
        for i in np.flatnonzero(ok).tolist():
            digests[rows[i]] = hashlib.sha256(b";".join([found.groups[p] for p in places[offsets[i] : offsets[i + 1]].tolist()])).hexdigest()
        # Documents and their different segments, then their pairs.
        whole = ok[of_row]
        both, times = np.unique(of_row[whole] * len(words) + places[whole], return_counts=True)
        segment = both % len(words)
        held = found.held[segment]
        at = spread(found.starts[segment], held)
        document.append(np.repeat(rows[both // len(words)], held))
        key.append(found.keys[at])
        links.append(found.links[at] * np.repeat(times, held))
    document, links = np.concatenate(document), np.concatenate(links)
    pairs, place = np.unique(np.concatenate(key), return_inverse=True)
    both, links = summed(document * max(len(pairs), 1) + place, links)
    of_doc, place = both // max(len(pairs), 1), both % max(len(pairs), 1)
    bounds = np.searchsorted(of_doc, np.arange(n + 1))
    steps = np.diff(place, prepend=0)
    steps[bounds[:-1][bounds[:-1] < len(place)]] = place[bounds[:-1][bounds[:-1] < len(place)]]
    cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    none = lambda kind: pa.nulls(1, kind)
    holders = np.bincount(place, minlength=len(pairs)).astype(np.int64)
    lists = lambda x: pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([x.tolist()], pa.list_(pa.int64()))])
    arrays = [
        pa.array(np.full(n + 1, block)), pa.concat_arrays([ids.cast(pa.int64()), none(pa.int64())]),
        *[pa.concat_arrays([pa.array(sizes[:, c]), none(pa.int64())]) for c in range(4)], pa.array([*digests, None], pa.string()),
        pa.array([*[packed_numbers(steps[a:b]) for a, b in cut], None], pa.binary()), pa.array([*[packed_numbers(links[a:b]) for a, b in cut], None], pa.binary()), lists(pairs), lists(holders),
    ]
    return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in BLOCK_SCHEMA.split(", ")])


def pair_counts(asked: DataFrame, width: int) -> DataFrame:
    """Stored (pair, count, best) of (pair, holders): in how many documents, and whether none of its A id has more."""
    counted = base.stored(asked.groupBy("pair").agg(F.sum("holders").alias("count")), "pair-counts")
    a = F.floor(F.col("pair") / F.lit(width)).alias("a")
    highest = counted.groupBy(a).agg(F.max("count").alias("highest"))  # a row for each id of A's vocabulary at most
    return base.stored(counted.withColumn("a", a).join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "best-pairs")


def align(docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``, a row for each row.

    A reads a space and the text by a byte-level ``tokenizers`` file, B the text by a sentencepiece model that puts the
    space before it itself. Special tokens are neither added nor recognised. A text that is null, empty, or that either
    tokenizer doesn't give back byte by byte has no tokens: zeros, and an empty ``groups_sha256``. ``n_best`` counts links
    whose pair is held by as many documents as any of its A id, ``count_sum`` adds up the documents of all links' pairs.
    Repeated rows are documents of their own; null ids are kept; other columns are not read; an empty table gives an
    empty result.
    """
    base.ship(docs.sparkSession)
    width = aligner(a_path, b_path).width
    made = base.stored(blocks(docs, a_path, b_path, id_column, text_column), "alignments")
    asked = made.where("pairs is not null").select(F.col("block").alias("asked_by"), F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("holders").alias("holders"))))
    answers = asked.join(pair_counts(asked, width), "pair").select("asked_by", "pair", "count", "best")
    documents = made.where("pairs is null").drop("pairs", "holders")

    def add(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("pair")
        count, best = known.column("count").to_numpy(), known.column("best").to_numpy().astype(bool)
        n_best, count_sum = [], []
        for steps, links in zip(rows.column("places").to_pylist(), rows.column("links").to_pylist(), strict=True):
            place, links = np.cumsum(unpacked_numbers(steps)), unpacked_numbers(links)
            n_best.append(int(links[best[place]].sum()))
            count_sum.append(int((links * count[place]).sum()))
        own = [f.split()[0] for f in FIELDS.split(", ")]
        return pa.table({**{c: rows.column(c) for c in own}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())})

    out = documents.groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(add, f"{FIELDS}, n_best long, count_sum long")
    return out.select(F.col("doc_id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
