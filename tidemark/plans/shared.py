"""Tables in the folder that the driver and all executors share; they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_made: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package, wherever the driver has it; once an application."""
    key = spark.sparkContext.applicationId
    if key in _shipped:
        return
    _shipped.add(key)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    folder = tempfile.mkdtemp(prefix="tidemark-zip-")  # the driver's own; Spark serves it to the executors
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, f"{PACKAGE.name}-code.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only where neither the setting nor the context names one (tests) is a temporary folder of our own set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = sc.getCheckpointDir()
    if own is None:
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(f"file://{folder}")
        own = sc.getCheckpointDir()
    return own.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared root; :func:`drop_scratch` removes what was written there."""
    path = f"{shared_root(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folder names that :func:`scratch` gives out within the block; the list is filled at its end."""
    made: list[str] = []
    before = len(_made)
    yield made
    made.extend(path for _, path in _made[before:])


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of earlier calls; only for callers whose earlier results are stored elsewhere."""
    while _made:
        owner, path = _made.pop()
        if owner.sparkContext._jsc is not None:
            delete(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back
