"""Near-duplicate vectors: binary codes of randomly rotated vectors, with stored correction factors.

A unit vector o is rotated at random (several rotations, if it takes more bits than it has dimensions) and the signs are
kept as its code. The code stands for a vector y, its reconstruction; with the stored factor f = <y, o> the product
<y, q> / f estimates <o, q> without bias, as the rest of y points in a random direction. The second stored factor, the
length of that rest over f, gives the estimate's deviation for any cosine: the bound by which a pair is ruled out. The
other side of a product is the vector in 8 bits a component, rounded at random, so that rounding adds no bias either.

1. Equal vectors are merged; they count as links, and cost one row.
2. The code is cut into ``TABLES`` bands of ``BITS`` bits. Vectors that share a band (and label and length) meet in that
   cell; those alone in a cell are left out before any code is moved. A pair is looked at in its first common band only.
3. In a cell, pairs whose estimate is below the threshold by more than ``SIGMAS`` deviations are ruled out. A vector with
   a pair left is to be recomputed there.
4. Only those meet again with their whole vectors: exact cosines in double precision decide. What leaves the task is a
   row a vector: its number of links there, and the smallest vector that it is connected with.
5. Components of these rows join what different cells have found.

A cell of more than ``BLOCK`` vectors is dealt into blocks by hash, and each two blocks meet in a group of their own, so
no group exceeds a few thousand rows, and pairs are compared within tasks, never written.

A pair with exactly the threshold of 0.98 shares one band of 16 with probability 0.9989 (each bit agrees with
probability 1 - angle / pi), closer ones more likely; the bound rules out a true link once in some millions.
``BITS`` should be near log2 of the vectors a label, so that few strangers share a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import base

TABLES, BITS = 16, 16
#: Deviations of the estimate that a true link may lie below the threshold.
SIGMAS = 5.0
#: Vectors of a block: two blocks are compared at a time.
BLOCK = 1024
SEED = 17
CELL = ["g", "cell", "low", "high"]


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """``dim`` orthonormal rows of at least TABLES * BITS columns: random rotations side by side, scaled to one."""
    rng, times = np.random.default_rng(SEED), -(-TABLES * BITS // dim)
    parts = []
    for _ in range(times):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.where(np.diag(r) < 0, -1.0, 1.0))
    return np.concatenate(parts, 1) / np.sqrt(times)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; none is zero."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # no square overflows or vanishes
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign codes, and the correction factors: <y, o> and the length of what is left of y over it."""
    turned = units @ rotation(units.shape[1])
    signs = turned >= 0
    align = np.abs(turned).sum(1) / np.sqrt(signs.shape[1])
    y = _reconstructed(signs, units.shape[1])
    rest = np.sqrt(np.maximum((y * y).sum(1) - align**2, 0))
    return np.packbits(signs, axis=1, bitorder="little"), align, rest / align


def _reconstructed(signs: np.ndarray, dim: int) -> np.ndarray:
    return (signs * 2.0 - 1.0) @ rotation(dim).T / np.sqrt(signs.shape[1])


def rounded(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight bits a component with random rounding, and the size of a step."""
    step = np.abs(units).max(1) / 127
    dither = np.random.default_rng(SEED + 1).random(units.shape[1])
    return np.floor(units / step[:, None] + dither).clip(-127, 127).astype(np.int8), step


def estimates(codes: np.ndarray, align: np.ndarray, spread: np.ndarray, small: np.ndarray, step: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of all pairs, each the mean of both directions, and their deviation at the threshold."""
    dim = small.shape[1]
    signs = np.unpackbits(codes, axis=1, bitorder="little", count=rotation(dim).shape[1])
    guide = _reconstructed(signs, dim) / align[:, None]
    one_way = guide @ (small * step[:, None]).T
    turned = spread * np.sqrt((1 - threshold * threshold) / max(dim - 1, 1))
    rounding = np.sqrt((guide * guide).sum(1)).max() * step / 2
    deviation = np.hypot((turned[:, None] + turned[None, :]) / 2, np.maximum(rounding[:, None], rounding[None, :]))
    return (one_way + one_way.T) / 2, deviation


def bands(codes: np.ndarray) -> np.ndarray:
    """The first TABLES * BITS bits as TABLES numbers a row."""
    return codes[:, : TABLES * BITS // 8].copy().view("<u2").reshape(len(codes), TABLES)


def first_met(band: np.ndarray, table: int, own: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which pairs are to be looked at here: different ones of the two blocks with no earlier common band."""
    met = own[:, None] != own[None, :] if low != high else ~np.eye(len(own), dtype=bool)
    for t in range(table):
        met &= band[:, t, None] != band[None, :, t]
    return met


def valid(label: Column, vector: Column) -> Column:
    """Whether a vector can link at all: it has a label, numbers only, and some that aren't zero."""
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & numbers & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _bytes(column: pa.Array, kind: type) -> np.ndarray:
    """Binaries of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def codes(distinct: DataFrame) -> DataFrame:
    """(uid, g, code, align, spread, small, step, cells) of (uid, g, vector); g tells labels and lengths apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("vector").value_lengths().to_numpy()
            for dim in np.unique(sizes):
                own = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                units = unit(_matrix(own.column("vector")))
                code, align, spread = encode(units)
                small, step = rounded(units)
                cells = bands(code).astype(np.int32) + (np.arange(TABLES, dtype=np.int32) << BITS)
                arrays = [
                    own.column("uid"), own.column("g"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(align), pa.array(spread),
                    pa.array([r.tobytes() for r in small], pa.binary()), pa.array(step), pa.ListArray.from_arrays(np.arange(0, cells.size + 1, TABLES, dtype=np.int32), cells.ravel()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["uid", "g", "code", "align", "spread", "small", "step", "cells"])

    return distinct.select("uid", "g", "vector").mapInArrow(run, "uid long, g long, code binary, align double, spread double, small binary, step double, cells array<int>")


def meetings(coded: DataFrame) -> DataFrame:
    """(g, cell, low, high, uid, own): who meets whom; a large cell gives a group for each two of its blocks.

    The counts of cells are stored first, so that the join back is of two plain shuffles and can be split.
    """
    each = coded.select("uid", "g", F.explode("cells").alias("cell"))
    busy = base.stored(each.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "busy-cells")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = each.join(busy, ["g", "cell"]).select("g", "cell", "uid", blocks.alias("blocks"), F.pmod(F.xxhash64("uid"), blocks).cast("int").alias("own"))
    other = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("g", "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "uid", "own")


def _undecided(threshold: float):
    """Of each cell the vectors with a pair that the estimate can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in base.runs(batches, CELL):
            if len(group) < 2:
                continue
            g, cell, low, high = (group.column(c)[0].as_py() for c in CELL)
            own, code = group.column("own").to_numpy(), _bytes(group.column("code"), np.uint8)
            factors = [group.column(c).to_numpy() for c in ("align", "spread", "step")]
            estimate, deviation = estimates(code, factors[0], factors[1], _bytes(group.column("small"), np.int8), factors[2], threshold)
            left = first_met(bands(code), cell >> BITS, own, low, high) & (estimate >= threshold - SIGMAS * deviation)
            kept = group.filter(pa.array(left.any(1)))
            if len(kept):
                yield kept.select([*CELL, "uid", "own"]).combine_chunks().to_batches()[0]

    return run


def _exact(threshold: float):
    """Of each cell the links of each vector, by exact cosine, and the smallest vector it is connected with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in base.runs(batches, CELL):
            cell, low, high = (group.column(c)[0].as_py() for c in CELL[1:])
            uid, own, n = (group.column(c).to_numpy() for c in ("uid", "own", "n"))
            units = unit(_matrix(group.column("vector").combine_chunks()))
            linked = first_met(bands(_bytes(group.column("code"), np.uint8)), cell >> BITS, own, low, high) & (units @ units.T >= threshold)
            some = linked.any(1)
            root = uid.copy()
            while True:
                lower = np.minimum(root, np.where(linked, root[None, :], root[:, None]).min(1))
                if (lower == root).all():
                    break
                root = lower
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(uid[some]), pa.array((linked @ n)[some]), pa.array(root[some])], ["uid", "links", "root"])

    return run


def found_links(distinct: DataFrame, threshold: float = 0.98) -> DataFrame:
    """Stored (uid, links, root): a row for each cell in which a vector of (uid, g, vector, n) has links."""
    coded = base.stored(codes(distinct), "codes")
    met = meetings(coded).join(coded.drop("g", "cells"), "uid")
    open_ = met.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_undecided(threshold), "g long, cell int, low int, high int, uid long, own int")
    open_ = base.stored(open_, "undecided")
    whole = open_.join(distinct.select("uid", "vector", "n"), "uid").join(coded.select("uid", "code"), "uid")
    exact = whole.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_exact(threshold), "uid long, links long, root long")
    return base.stored(exact, "links")


def groups(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Return id, ``n_links``, ``component_id`` and ``kept``: a row for each row.

    Vectors of one label and length link at a cosine of ``threshold`` or more; ``n_links`` counts the other rows linked
    directly, copies included, and ``component_id`` is the smallest id that links reach. A vector that is null, empty,
    zero, or that holds a null or something not finite links with nothing, and neither does one without a label: no
    links, its own component. Rows with equal ids are different rows. A row without an id takes part; it never names a
    component unless all its members lack an id, and is never ``kept``. Other columns are not read; an empty table gives
    an empty result.
    """
    base.ship(vectors.sparkSession)
    label, vector = vectors[label_column], vectors[vector_column].cast("array<double>")
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), label.alias("label"), vector.alias("vector"))
    rows = rows.withColumn("ok", valid(F.col("label"), F.col("vector")))
    # 128 bits stand for a label and vector.
    rows = rows.withColumns({"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "label", "vector"), "g": F.xxhash64("label", F.size("vector"))})
    merged = rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("g").alias("g"), F.first("vector").alias("vector"))
    distinct = base.stored(merged.withColumn("uid", F.monotonically_increasing_id()), "distinct-vectors")
    found = found_links(distinct, threshold)
    parts = base.stored(connected_components(found, "uid", "root", "uid", "component"), "vector-components")
    named = base.stored(parts.join(distinct.select("uid", "first"), "uid").groupBy("component").agg(F.min("first").alias("name")), "component-names")
    of = parts.join(named, "component").select("uid", "name").join(found.groupBy("uid").agg(F.sum("links").alias("links")), "uid", "left")
    known = distinct.select("uid", "h1", "h2", "first", "n").join(of, "uid", "left")
    known = base.stored(known.select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("name", "first").alias("component")), "vector-groups")
    # A row that can't link has no key to be found by.
    keyed = rows.select("vec_id", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in ("h1", "h2")])
    out = keyed.join(known, ["h1", "h2"], "left")
    own = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(F.col("vec_id").alias(id_column), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
