"""SimHash near-duplicates: a segment-popcount embedding, a grid range-join, exact verification, components.

A 64-bit fingerprint is embedded as the number of set bits in each of its 32 two-bit segments. One bit flip moves one
coordinate by one at most, so the Manhattan distance of two embeddings is a lower bound of the Hamming distance of the
fingerprints. Fingerprints within ``RADIUS`` = 3 bits therefore have embeddings at most 3 apart, and in one half of
the coordinates (16 of them) at most 1 apart. A half is a grid cell: every fingerprint enters its own cell of either
half, and is looked up in that cell and in those one step away in one coordinate. What meets in a cell is verified
exactly within the join, so that only true links leave it.

Equal fingerprints are merged before the join, so copies cost one row; a cell many different fingerprints share is a
skewed join key of a plain join, which adaptive execution splits, as it does for a component of many fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import base

SHINGLE = 3
RADIUS = 3
#: The even bits of half a fingerprint: adding them to its odd bits counts the set bits of all two-bit segments at once.
EVEN = 0x55555555


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in shingles], ">u8")
    votes = sum(np.unpackbits(h[i : i + 65536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64) for i in range(0, len(h), 65536))
    return int(np.packbits(votes * 2 > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, h, fp) of each row: its id, a hash of its text and its fingerprint; a null text counts as empty."""
    base.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in base.slices(batches):
            fps = [fingerprint(t.encode()) for t in base.text_of(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fps, pa.int64())], ["doc_id", "h", "fp"])

    picked = docs.select(docs[id_column].cast("long").alias("doc_id"), text_hash(docs[text_column]).alias("h"), docs[text_column].cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, h long, fp long")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def embedding(half: Column) -> Column:
    """The 16 segment counts of half a fingerprint, two bits each."""
    return half.bitwiseAND(F.lit(EVEN)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(EVEN))


def halves(fp: Column) -> list[Column]:
    """Grid cells of both halves as numbers that don't clash: the counts, and above them which half it is."""
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    return [embedding(low), embedding(high).bitwiseOR(F.lit(1 << 32))]


def around(cell: Column) -> Column:
    """The cell and its valid neighbours at Manhattan distance 1."""
    steps = []
    for i in range(0, 32, 2):
        count = F.shiftright(cell, i).bitwiseAND(F.lit(3))
        steps += [F.when(count < 2, cell + F.lit(1 << i)), F.when(count > 0, cell - F.lit(1 << i))]
    return F.filter(F.array(cell, *steps), lambda c: c.isNotNull())


def links(distinct_fps: DataFrame) -> DataFrame:
    """All pairs (a < b) of different fingerprints at most RADIUS bits apart; ``distinct_fps`` has the column fp."""
    probe = distinct_fps.select(F.col("fp").alias("a"), F.explode(F.concat(*[around(c) for c in halves(F.col("fp"))])).alias("cell"))
    build = distinct_fps.select(F.col("fp").alias("b"), F.explode(F.array(*halves(F.col("fp")))).alias("cell"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    return probe.join(build, (probe["cell"] == build["cell"]) & near).select("a", "b")


def components(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``fingerprints``: (fp, label), the component of each fingerprint that has links, and (fp, first), for each the
    first row with it.

    A row's rank is the struct (without id?, id, fingerprint, hash of the text).
    """
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "fp", "h")
    distinct = base.stored(fps.groupBy("fp").agg(F.min(rank).alias("first")), "distinct-fingerprints")
    return base.stored(connected_components(links(distinct), "a", "b", "fp", "label"), "labels"), distinct


def firsts(labels: DataFrame, distinct: DataFrame) -> DataFrame:
    """Stored (label, first): the first row of each component of several fingerprints.

    It is stored before it meets the labels, so that the join can be split where many fingerprints share a label.
    """
    return base.stored(labels.join(distinct, "fp").groupBy("label").agg(F.min("first").alias("first")), "first-rows")


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Return id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable over links, itself included).

    A row for each input row; null texts count as empty, and all empty texts share fingerprint zero. Ids may repeat;
    a null id takes part in links but never names a component unless all its members lack one. Other columns are not
    read; an empty table gives an empty result.
    """
    fps = base.stored(fingerprints(docs, id_column, text_column), "fingerprints")
    labels, distinct = components(fps)
    linked = labels.join(firsts(labels, distinct), "label").select("fp", F.col("first.doc_id").alias("component_id"))
    alone = distinct.join(labels, "fp", "left_anti").select("fp", F.col("first.doc_id").alias("component_id"))
    of_fp = base.stored(linked.unionByName(alone), "components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(of_fp, "fp").select(F.col("doc_id").alias(id_column), hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id. All columns are kept.

    A group is one of texts, so rows with equal ids and different texts all stay unless their texts are near-duplicates;
    of equal rows one stays. A row without an id stays only where its whole group has none. A null text counts as
    empty; all empty texts are one group; an empty table gives an empty result. No column name is reserved.
    """
    labels, distinct = components(fingerprints(docs, id_column, text_column))
    alone = distinct.join(labels, "fp", "left_anti").select("first")
    kept = firsts(labels, distinct).select("first").unionByName(alone).select(F.col("first.doc_id").alias("kept_id"), F.col("first.h").alias("kept_h"))
    rows = docs.select(base.packed(docs.columns, docs).alias("row"), docs[id_column].cast("long").alias("id"), text_hash(docs[text_column]).alias("h"))
    first = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")), "left_semi")
    return first.dropDuplicates(["id", "h"]).select(*base.unpacked(docs.columns))
