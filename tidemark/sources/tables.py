"""Raw tables: JSON lines in several layouts, a time-sorted slim cache, a schema profiler, a vector cache."""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.shared import ship, stored

#: Where a table may lie below its folder, in order of preference.
LAYOUTS = ("{0}.jsonl.gz", "{0}.jsonl", "full-wiki-logs/{0}.jsonl", "{0}.json.gz")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def find(spark: SparkSession, folder: str, stem: str) -> str | None:
    """The first layout of a table that exists."""
    return next((p for p in (f"{folder}/{x.format(stem)}" for x in LAYOUTS) if exists(spark, p)), None)


def missing(spark: SparkSession, folder: str, stems: list[str]) -> list[str]:
    """Tables that no layout has."""
    return [s for s in stems if find(spark, folder, s) is None]


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines, gzip by extension; blank lines are skipped, missing fields are null."""
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON object a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def slim_cache(df: DataFrame, timestamp: Column, payload: list[str], path: str, keep: Column | None = None) -> None:
    """Write (id, ts, payload) as Parquet ordered by time, so that a window reads few row groups."""
    slim = df.select("id", timestamp.alias("ts"), F.to_json(F.struct(*payload)).alias("payload"))
    slim = slim.where(F.col("ts").isNotNull()) if keep is None else df.where(keep).select("id", timestamp.alias("ts"), F.to_json(F.struct(*payload)).alias("payload")).where(F.col("ts").isNotNull())
    slim.repartitionByRange("ts").sortWithinPartitions("ts").write.mode("overwrite").parquet(path)


def read_window(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Rows of a slim cache with start <= ts < end; the filter reaches the scan."""
    lit = lambda x: F.lit(x).cast("timestamp")
    return spark.read.parquet(path).where((F.col("ts") >= lit(start)) & (F.col("ts") < lit(end)))


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Only these columns of a cache; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def drill_down(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Turns of the wanted sessions (a table with session_id), ordered by time."""
    return turns.join(sessions.select("session_id").distinct(), "session_id", "left_semi").orderBy("created_at")


def profile(df: DataFrame) -> DataFrame:
    """(field, present, rows, type, distinct): for each top-level field how often it is set and with how many values."""
    one = lambda f: df.agg(F.lit(f.name).alias("field"), F.count(F.col(f"`{f.name}`")).alias("present"), F.count(F.lit(1)).alias("rows"), F.lit(f.dataType.simpleString()).alias("type"), F.approx_count_distinct(F.col(f"`{f.name}`").cast("string")).alias("distinct"))
    return reduce(DataFrame.unionByName, [one(f) for f in df.schema.fields])


def top_values(df: DataFrame, field: str, most: int = 10) -> DataFrame:
    """The most frequent values of a field."""
    return df.groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def missing_vectors(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, text) of the different texts that a vector cache (key, emb) lacks; the key is the text's SHA-1."""
    return texts.select(F.sha1("text").alias("key"), "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def changelog(spark: SparkSession, path: str) -> DataFrame:
    """(day, body): the dated sections of a change log, each up to the next section of any name; white space squeezed, cut to 300 characters."""
    whole = spark.read.text(path, wholetext=True)
    pattern = r"(?ms)^## (\d{4}-\d{2}-\d{2})[^\n]*\n(.*?)(?=^## |\z)"
    pair = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("d"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("b"))
    return whole.select(F.explode(pair).alias("x")).select(F.to_date("x.d").alias("day"), F.substring(F.trim(F.regexp_replace("x.b", r"\s+", " ")), 1, 300).alias("body"))


def first_rows(df: DataFrame, inside: Column, most: int) -> DataFrame:
    """Rows of a window, three times ``most`` at the most: a scan for a preview may stop there. Which rows is left open."""
    return df.where(inside).limit(3 * most)


def tables_of(spark: SparkSession, folder: str, stems: list[str]) -> DataFrame:
    """(stem, path): which table lies where; a null path where none does."""
    return spark.createDataFrame([(s, find(spark, folder, s)) for s in stems], "stem string, path string")


def coverage(rows: DataFrame, gap: Column, most: int = 5) -> DataFrame:
    """(rows, gaps, examples): how many rows a table has, for how many ``gap`` holds, and the first of its values."""
    gaps = rows.where(gap).agg(F.count(F.lit(1)).alias("gaps"))
    named = rows.where(gap).select(F.col(rows.columns[0]).cast("string").alias("x")).orderBy("x").limit(most).agg(F.array_sort(F.collect_list("x")).alias("examples"))
    return rows.agg(F.count(F.lit(1)).alias("rows")).crossJoin(gaps).crossJoin(named)  # one row each


def add_batch(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Add rows to a keyed cache as a folder of its own, which appears as a whole or not at all.

    It is written under a name that readers skip and then renamed; its name begins with the time. Runs at the same time
    don't see each other's half-written rows, and :func:`newest` says whose rows count where both bring a key.
    """
    spark = df.sparkSession
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.partitionBy(partition) if partition else df.write
    writer.parquet(f"{path}/_adding-{name}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{path}/_adding-{name}")
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.rename(at, hadoop.Path(f"{path}/batch={name}")):
        raise OSError(f"{path}/batch={name} can't be made")


def newest(spark: SparkSession, path: str, schema: str | StructType, key: str) -> DataFrame:
    """The rows of a keyed cache: of each key those of the last batch that has it."""
    rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    if "batch" not in rows.columns:
        rows = rows.withColumn("batch", F.regexp_extract(F.input_file_name(), "/batch=([^/]*)/", 1))
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"]).drop("batch")


def cached_turns(turns: DataFrame, sessions: DataFrame, path: str) -> DataFrame:
    """Turns of the wanted sessions by time, from a cache of whole sessions; what it lacks is read and added.

    A session without turns is looked for again each time. The cache is a table of batches, partitioned by session; of
    runs that add a session at the same time the last one counts.
    """
    spark = turns.sparkSession
    known = newest(spark, path, turns.schema, "session_id").select("session_id").distinct()
    wanted = sessions.select("session_id").distinct().join(known, "session_id", "left_anti")
    add_batch(turns.join(wanted, "session_id", "left_semi"), path, "session_id")
    return drill_down(newest(spark, path, turns.schema, "session_id"), sessions).select(*turns.columns)


def cached_vectors(texts: DataFrame, path: str, make) -> DataFrame:
    """(text, emb) of the different texts (null ones have none), from a cache by SHA-1; ``make`` turns (key, text) that it
    lacks into (key, emb), which are added. Of runs that add a text at the same time the last one counts."""
    spark, schema = texts.sparkSession, "key string, emb array<float>"
    texts = texts.where("text is not null").select("text").distinct()
    add_batch(make(missing_vectors(texts, newest(spark, path, schema, "key"))).select("key", F.col("emb").cast("array<float>").alias("emb")), path)
    return texts.withColumn("key", F.sha1("text")).join(newest(spark, path, schema, "key"), "key").select("text", "emb")


def walk(path: str, value, found: Counter, values: dict[str, Counter], distinct: int) -> None:
    """Count every path below a parsed JSON value by type, and short scalars by value while they look like categories."""
    kind = "null" if value is None else next(name for python, name in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string"), (list, "array"), (dict, "object")) if isinstance(value, python))
    found[path, kind] += 1
    if kind in ("bool", "int", "string") and (kind != "string" or len(value) < 40):
        own = values.setdefault(path, Counter())
        if len(own) <= distinct:
            own[value if kind == "string" else json.dumps(value)] += 1
    for key, inner in value.items() if kind == "object" else ():
        walk(f"{path}.{key}" if path else key, inner, found, values, distinct)
    for inner in value if kind == "array" else ():
        walk(f"{path}[]", inner, found, values, distinct)


def profile_paths(spark: SparkSession, path: str, most: int = 25, distinct: int = 40, share: float = 0.5) -> DataFrame:
    """(path, n, types, top) of JSON lines, nested ones too, in one scan; lines that don't parse are skipped.

    ``types``: how often each type stands there; ``top``: the ``most`` frequent values, of equal ones by name, of a path
    that looks like a category: more than one and at most ``distinct`` different short values, in more than ``share`` of
    the lines. A task passes on what it has counted; a path with more values in one task than a category can have passes
    on none of them, so what is shuffled doesn't grow with ids.
    """
    ship(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        values: dict[str, Counter] = {}
        lines = 0
        for batch in batches:
            for line in batch.column("value").to_pylist():
                try:
                    parsed = json.loads(line)
                except (TypeError, ValueError):
                    continue
                lines += 1
                walk("", parsed, found, values, distinct)
        rows = [("line", "", "", lines)] + [("type", p, k, n) for (p, k), n in found.items() if p]
        for p, own in values.items():
            rows += [("many", p, "", 1)] if len(own) > distinct else [("value", p, v, n) for v, n in own.items() if p]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["what", "path", "name", "n"])

    counted = spark.read.text(path).mapInArrow(count, "what string, path string, name string, n long")
    counted = stored(counted.groupBy("what", "path", "name").agg(F.sum("n").alias("n")), "path-counts")
    types = counted.where("what = 'type'").groupBy("path").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("types"))
    lines = counted.where("what = 'line'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))  # one row
    value = counted.where("what = 'value'").join(counted.where("what = 'many'").select("path"), "path", "left_anti")
    few = value.groupBy("path").agg(F.count(F.lit(1)).alias("different"), F.sum("n").alias("held")).where(F.col("different").between(2, distinct))
    few = few.crossJoin(F.broadcast(lines)).where(F.col("held") > share * F.col("lines")).select("path")
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("name").alias("value"), "n"))), 1, most)  # ``distinct`` at most
    top = value.join(few, "path").groupBy("path").agg(F.transform(listed, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top"))
    return types.join(top, "path", "left")


def profile_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, n): every path of JSON lines, nested ones too, with how often each type stands there.

    Elements of an array have the path with ``[]``.
    """
    return profile_paths(spark, path).select("path", F.explode("types").alias("type", "n"))
