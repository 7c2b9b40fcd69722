"""Best-fit packing of tokenised documents into sequences of fixed capacity, after dominance reduction.

Only lengths matter for packing, and there are at most ``capacity`` different ones. So the corpus is reduced to a
histogram of piece lengths (a table of bounded size, the only thing the driver sees), the packing is planned on counts
of equal pieces, and the plan comes back as ranges: of the pieces of length s, those numbered a to b go to such and
such sequences at such an offset. Pieces are numbered within their length by the task that cut them plus a prefix sum
over tasks, so no task ever gathers all pieces of one length.

The plan: Martello and Toth's reduction permanently fixes sets of up to three pieces that dominate all alternatives,
for pieces of any length (:func:`reduce_instance`), and best-fit decreasing packs the rest (:func:`best_fit`).
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base, segments, token_counts

#: A group of equal sequences: how many, and (length, copies) of the pieces in each, in the order they lie there.
Group = tuple[int, tuple[tuple[int, int], ...]]


def reduce_instance(counts: list[int], capacity: int) -> tuple[list[Group], list[int]]:
    """Fix dominating sets until no piece has one; return them and the counts that are left.

    What :func:`dominating` finds stays right while copies of it are taken out (the rest only gets smaller), so a set is
    fixed as often as its pieces last. Passes go from the longest pieces to the shortest, until one changes nothing.
    """
    left, fixed, changed = list(counts), [], True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while left[j] and (others := dominating(left, j, capacity - j)) is not None:
                need = Counter((j, *others))
                times = min(left[s] // n for s, n in need.items())
                fixed.append((times, tuple(sorted(need.items(), reverse=True))))
                for s, n in need.items():
                    left[s] -= times * n
                changed = True
    return fixed, left


def dominating(counts: list[int], j: int, room: int) -> tuple[int, ...] | None:
    """The pieces beside one of length j that dominate whatever else could stand there; None if none are known to.

    A set dominates another if the other's pieces can be dealt out to its own, each of which is as long as what it gets:
    they can then change places in any packing. With k the most others that fit beside j:
    - k = 0: j stands alone;
    - the longest that fits fills the room, or k = 1: that one dominates;
    - k = 2 and the longest that fits is as long as the best pair: it dominates;
    - k = 2, the best pair has the longest that fits, and no two pieces longer than its second fit: the pair dominates.
    """
    left = list(counts)
    left[j] -= 1
    small = _smallest(left, 3)
    if not small or small[0] > room:
        return ()
    first = _longest(left, room)
    k = sum(1 for total in accumulate(small) if total <= room)
    if k == 1 or first == room:
        return (first,)
    if k > 2:
        return None
    best = _best_pair(left, room)
    if first >= best:
        return (first,)
    left[first] -= 1
    second = _longest(left, room - first)
    if first + second == best:
        longer = _smallest(left, 2, second + 1)
        if len(longer) < 2 or sum(longer) > room:
            return first, second
    return None


def _longest(left: list[int], room: int) -> int:
    return next((s for s in range(min(room, len(left) - 1), 0, -1) if left[s]), 0)


def _smallest(left: list[int], n: int, least: int = 1) -> list[int]:
    out: list[int] = []
    for s in range(least, len(left)):
        if left[s]:
            out += [s] * min(left[s], n - len(out))
            if len(out) == n:
                break
    return out


def _best_pair(left: list[int], room: int) -> int:
    """The largest sum of two pieces that fits into ``room``."""
    most, low, high = 0, 1, min(room, len(left) - 1)
    while low <= high:
        if not left[low] or (low == high and left[low] < 2):
            low += 1
        elif not left[high] or low + high > room:
            high -= 1
        else:
            most = max(most, low + high)
            low += 1
    return most


def best_fit(counts: list[int], capacity: int) -> list[Group]:
    """Best-fit decreasing over counts: each piece goes where the least room is left, equal pieces by the batch."""
    open_at: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def put(room: int, group: Group) -> None:
        if group[0]:
            if room not in open_at:
                open_at[room] = []
                bisect.insort(rooms, room)
            open_at[room].append(group)

    for s in range(capacity, 0, -1):
        c = counts[s]
        while c:
            at = bisect.bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                n, items = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(at)
            else:
                room, n, items = capacity, c, ()
            copies = room // s
            full = min(n, c // copies)
            rest = min(n - full, 1) * (c - full * copies if full < n else 0)
            rest = min(rest, copies - 1) if full < n else 0
            put(room - copies * s, (full, (*items, (s, copies))))
            if rest:
                put(room - rest * s, (1, (*items, (s, rest))))
            if items:
                put(room, (n - full - bool(rest), items))
            c -= full * copies + rest
    return [g for room in rooms for g in open_at[room]]


def plan(counts: list[int], capacity: int) -> list[Group]:
    """All groups of sequences for ``counts[s]`` pieces of each length s up to ``capacity``."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def ranges(groups: list[Group]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end, first sequence, copies, offset): where the pieces of each length go."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for n, items in groups:
        offset = 0
        for s, copies in items:
            first = used.get(s, 0)
            out.append((s, first, first + n * copies, sequence, copies, offset))
            used[s] = first + n * copies
            offset += s * copies
        sequence += n
    return out


_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def encoder(json_path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text by a ``tokenizers`` file, without added special tokens.

    Where the file is plain byte-level BPE whose ids follow the order of its merges, tiktoken is built from its
    vocabulary: it yields the same ids several times as fast (tests hold them against the file's own library). Any other
    file is used through its own library.
    """
    if json_path not in _encoders:
        import json

        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        if token_counts.splits_safely(json_path) and ids_follow_merges(spec["model"]):
            import tiktoken

            byte_of = _byte_letters()
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: what ByteLevel splits by
            enc = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            _encoders[json_path] = lambda text: enc.encode_to_numpy(text, allowed_special="all")
        else:
            tok = token_counts.load(json_path)
            _encoders[json_path] = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.int64)
    return _encoders[json_path]


def ids_follow_merges(model: dict) -> bool:
    """Whether later merges make larger ids, and all tokens but the bytes come from merges, so that an id is a rank."""
    vocab = model.get("vocab") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges") or []]
    made = [vocab.get("".join(m), -1) for m in merges]
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return plain and all(len(m) == 2 for m in merges) and all(a < b for a, b in zip([-1, *made], made, strict=False)) and sum(len(t) > 1 for t in vocab) <= len(made) + 64


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else from 256 up."""
    shown = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_ids(enc: Callable[[str], np.ndarray], text: str, longest: int = 1 << 20, cut: bool = True) -> np.ndarray:
    """The ids of a text; one longer than ``longest`` is encoded in runs that end where a token must (if ``cut``)."""
    if len(text) <= longest or not cut:
        return enc(text)
    items = segments.cut(text)
    return np.concatenate([enc("".join(run)) for run in segments.chunks(items, segments.sizes_of(items), longest)])


def pieces(docs: DataFrame, json_path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tokenise and cut: one row for each piece, with its number among equally long ones of the same task.

    Columns: id, piece, start, length, ids_crc32, task, number. A text's ids are followed by ``end_id``; only a
    document of more than ``capacity`` ids is cut, from its end, so that only its first piece may be shorter.
    """
    base.ship(docs.sparkSession)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    safe = token_counts.splits_safely(json_path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, seen = encoder(json_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in base.slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), base.text_of(batch).to_pylist(), strict=True):
                ids = np.append(token_ids(enc, text, cut=safe), end_id).astype("<u4")
                at = 0
                for k, end in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
                    rows.append((doc_id, k, at, end - at, zlib.crc32(ids[at:end].tobytes()), task, int(seen[end - at])))
                    seen[end - at] += 1
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long")


def pack(docs: DataFrame, json_path: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack all documents; return a row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (they still hold ``end_id``); null ids and repeated rows each give pieces of their own;
    other columns are not read; an empty table gives an empty result. Sequences are gapless from offset 0. Ties among
    equally long pieces are resolved by the order in which tasks met them, which changes no count.
    """
    spark = docs.sparkSession
    cut = base.stored(pieces(docs, json_path, capacity, end_id, id_column, text_column), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = base.stored(by_task.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-counts")
    counts = [0] * (capacity + 1)
    for length, n in shifts.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    table = spark.createDataFrame([(s, *rest) for s, *rest in ranges(plan(counts, capacity))], "length long, first long, end long, sequence long, copies long, at long")
    # The shifts grow with the tasks, so they are not broadcast; the keys spread even the most common length.
    numbered = cut.join(shifts.select("length", "task", "shift").hint("merge"), ["length", "task"]).withColumn("k", F.col("number") + F.col("shift"))
    # The plan's size is bounded by the capacity, not by the corpus: a few rows for each length.
    placed = numbered.join(F.broadcast(table), (numbered["length"] == table["length"]) & (numbered["k"] >= table["first"]) & (numbered["k"] < table["end"]))
    nth = F.col("k") - F.col("first")
    return placed.select(
        F.col("doc_id").alias(id_column), "piece", "start", numbered["length"], "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("at") + nth % F.col("copies") * numbered["length"]).cast("long").alias("offset"),
    )
