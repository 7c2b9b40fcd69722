"""Plumbing shared by the operators: the shared folder, shipping this package, batches bounded by bytes."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import delete, drop_scratch, scratch, shared_root, stored  # noqa: F401

PACKAGE = Path(__file__).resolve().parents[1]
#: Bytes of text that a Python function holds at a time (a single longer text is held alone).
BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver has it; Arrow batches are bounded by bytes unless they are."""
    for name, value in (("maxBytesPerBatch", str(BATCH_BYTES)), ("maxRecordsPerBatch", "2000")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) in (None, "10000", str((1 << 31) - 1), "-1"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    _shipped.add(key)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    folder = tempfile.mkdtemp(prefix="tidemark-zip-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{PACKAGE.name}-code.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)


def private(taken: Iterable[str], wanted: str) -> str:
    """A name like ``wanted`` that none of the columns ``taken`` has, in any case."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def packed(columns: Iterable[str], docs: DataFrame) -> Column:
    """The columns as one struct, whose fields are numbered: their names can't clash with anything beside it."""
    return F.struct(F.lit(None).cast("int").alias("_"), *[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(columns)])


def unpacked(columns: Iterable[str], struct: str = "row") -> list[Column]:
    """The fields of :func:`packed` under their own names."""
    return [F.col(struct)[f"c{k}"].alias(c) for k, c in enumerate(columns)]


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column without nulls (null: empty)."""
    return pc.fill_null(batch.column(name).cast(pa.string()), "")


def slices(batches: Iterable[pa.RecordBatch], name: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most ``most`` bytes of text each; one longer text makes a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches that are sorted by ``keys``; one key's rows are held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
