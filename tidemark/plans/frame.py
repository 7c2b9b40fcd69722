"""The canonical event frame: cleaning, order, touched resources, and the mapping of plain event tables onto it."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMPONENTS = ("temporal", "semantic", "resource", "direct", "goal", "action")
#: Actions that put nothing into what they touch, and target kinds that count as touched resources.
READ_ONLY = ("memory_read", "visit")
TOUCHABLE = ("resource", "room", "memory")
#: Rows are numbered within time buckets of this length first.
NUMBERING_US = 600_000_000

EVENT_SCHEMA = (
    "event_id string, timestamp timestamp, actor_id string, actor_type string, action_type string, target_id string, "
    "target_type string, content string, source string, tool string, mentions array<string>, resources array<string>, "
    "reply_to string, origin string, goal_key string, actor_name string, room_name string, target_label string, "
    "recreation_of string, raw_id string, extra map<string,string>"
)


@dataclass(frozen=True)
class PairConfig:
    """Tunables of pair scoring and edge collapse; the defaults are part of the semantics."""

    window_minutes: float = 120
    w_temporal: float = 0.15
    w_semantic: float = 0.30
    w_resource: float = 0.25
    w_direct: float = 0.15
    w_goal: float = 0.05
    w_action: float = 0.10
    semantic_floor: float = 0.5
    semantic_top_k: int = 5
    max_window_events: int = 1500
    min_pair_score: float = 0.35
    min_edge_score: float = 0.40
    max_pairs_per_edge: int = 25
    resource_share_cap: float = 0.5
    common_cause_sim: float = 0.6
    actor_types: tuple[str, ...] = ("agent",)
    template_min_actors: int = 3
    last_per_resource: int = 50
    inbox_rows: int = 400

    @property
    def window_us(self) -> int:
        return int(self.window_minutes * 60_000_000)

    def weight(self, component: str) -> float:
        return getattr(self, f"w_{component}")

    def replace(self, **changes) -> PairConfig:
        return PairConfig(**{f.name: getattr(self, f.name) for f in fields(self)} | changes)


def numbered(df: DataFrame, timestamp: str = "timestamp", tie: str = "event_id") -> DataFrame:
    """Add ``us`` (microseconds since the epoch) and ``rn``, the row's place (from 0) by time, then by ``tie``.

    Two levels: counts of time buckets give each bucket's first number, rows are numbered within their bucket. No task
    sorts more than one bucket; the running sum is over one row a bucket.
    """
    df = df.withColumn("us", F.unix_micros(timestamp)).withColumn("__bucket", F.floor(F.col("us") / NUMBERING_US))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = df.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).select("__bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__first"))
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(timestamp, tie))
    return df.withColumn("__place", place).join(first, "__bucket").withColumn("rn", F.col("__first") + F.col("__place") - 1).drop("__bucket", "__place", "__first")


def touched(target_type: Column, target_id: Column, resources: Column) -> Column:
    """Keys of the resources an event touches: its target, then what it names, without repeats."""
    own = F.when(target_type.isin(*TOUCHABLE) & target_id.isNotNull(), F.array(F.concat_ws(":", target_type, target_id))).otherwise(F.array().cast("array<string>"))
    named = F.transform(F.coalesce(resources, F.array().cast("array<string>")), lambda r: F.concat(F.lit("resource:"), r))
    return F.array_distinct(F.concat(own, named))


def canonical(raw: DataFrame, order: str | None = None) -> DataFrame:
    """The frame: rows without a time go, of equal ids the first stays (by ``order``, else by time), rows are numbered."""
    raw = raw.where(F.col("timestamp").isNotNull())
    first = Window.partitionBy("event_id").orderBy(*([order] if order else ["timestamp"]))
    kept = raw.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth", *([order] if order else []))
    return numbered(kept).withColumn("res", touched(F.col("target_type"), F.col("target_id"), F.col("resources")))


def text_key(content: Column) -> Column:
    """The hash of a text in lower case with its white space made even; null if nothing is left."""
    norm = F.lower(F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " ")))
    return F.when(norm != "", F.sha2(norm, 256))


def is_said(content: Column) -> Column:
    """Whether there is a text at all."""
    return F.trim(F.coalesce(content, F.lit(""))) != ""


def with_documents(ev: DataFrame, sf_dir: str, *columns: Column) -> DataFrame:
    """Add what ``columns`` make of each event's document (``content``); the texts themselves only if asked for."""
    docs = ev.sparkSession.read.parquet(f"{sf_dir}/documents.parquet")
    texts = docs.withColumnRenamed("text", "content").select(F.col("doc_id").alias("__doc"), *columns).dropDuplicates(["__doc"])
    return ev.withColumn("__doc", F.col("event_id").cast("long") % docs.count()).join(texts, "__doc", "left").drop("__doc")


def from_events(spark: SparkSession, sf_dir: str, with_embeddings: bool = True, with_content: bool = True) -> DataFrame:
    """The driver's ``events`` table as a canonical frame; vectors and what is asked of texts are only joined if asked for.

    Of a text an event has its hash (``text_key``) and whether there is one (``said``): many events share a document, and
    the texts are read where they are needed. Both joins come after the rows are numbered, so that they are moved once.
    """
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    kinds = {"error": "message", "purchase": "edit", "signup": "create", "click": "tool_use", "view": "visit"}
    action = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    none = F.lit(None).cast("string")
    ev = raw.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("u"), "user_id").alias("actor_id"), F.when(F.col("user_id") % 10 == 0, "human").otherwise("agent").alias("actor_type"),
        action.alias("action_type"), none.alias("target_id"), none.alias("target_type"), F.lit("events").alias("source"),
        F.when(action == "tool_use", F.concat(F.lit("t"), (k % 5).cast("string"))).alias("tool"),
        F.when(action == "message", F.array(F.concat(F.lit("u"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("mentions"),
        F.array(F.concat(F.lit("k"), k.cast("string"))).alias("resources"), none.alias("reply_to"),
        F.concat(F.lit("o"), (F.col("user_id") % 20).cast("string")).alias("origin"), F.concat(F.lit("g"), (F.col("user_id") % 7).cast("string")).alias("goal_key"),
        k.alias("__k"), F.col("user_id").alias("__user"),
    )
    ev = canonical(ev)
    if with_content:
        ev = with_documents(ev, sf_dir, text_key(F.col("content")).alias("text_key"), is_said(F.col("content")).alias("said")).fillna(False, ["said"])
    if with_embeddings:
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("emb")).dropDuplicates(["vec_id"])
        n = vectors.count()
        ev = ev.withColumn("vec_id", (F.col("__k") * 7 + F.col("__user")) % n).join(vectors, "vec_id", "left").drop("vec_id")
    return ev.drop("__k", "__user")
