"""The heterogeneous temporal graph as two tables: nodes, and typed edges keyed by event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The relation an action makes to its target.
RELATION = {"edit": "edited", "create": "created", "visit": "read", "memory_read": "read", "memory_write": "wrote", "tool_use": "used", "session_start": "used", "goal_set": "followed", "message": "sent"}


def actor_node() -> Column:
    return F.concat(F.when(F.col("actor_type") == "human", "human:").otherwise("agent:"), "actor_id")


def _hubs(ev: DataFrame, message_nodes: bool) -> DataFrame:
    """Events with their actor's node and the node that references hang on."""
    message = (F.col("action_type") == "message") & F.lit(message_nodes)
    target = F.concat_ws(":", F.coalesce("target_type", F.lit("resource")), "target_id")
    has_target = F.col("target_id").isNotNull() & (F.col("target_id") != "")
    hub = F.when(message, F.concat(F.lit("message:"), "event_id")).when(has_target & F.col("target_type").isin("session", "memory"), target).otherwise(actor_node())
    return ev.withColumn("actor", actor_node()).withColumn("is_message", message).withColumn("target", F.when(has_target, target)).withColumn("hub", hub)


def observed_edges(ev: DataFrame, message_nodes: bool = True) -> DataFrame:
    """(src, dst, key, rel, event_id): what events show, one edge for each link."""
    h = _hubs(ev, message_nodes)
    relation = F.coalesce(F.create_map(*[F.lit(x) for pair in RELATION.items() for x in pair])[F.col("action_type")], F.lit("used"))
    e = lambda df, src, dst, key, rel: df.select(F.col(src).alias("src"), dst.alias("dst"), key.alias("key"), rel.alias("rel"), "event_id")
    eid = F.col("event_id")
    room = h.where(F.col("is_message") & F.col("target_id").isNotNull() & (F.col("target_id") != ""))
    parts = [
        e(h.where("is_message"), "actor", F.col("hub"), eid, F.lit("sent")),
        e(room, "hub", F.concat(F.lit("room:"), "target_id"), F.concat(eid, F.lit(":room")), F.lit("posted_in")),
        e(h.where("is_message").withColumn("m", F.explode("mentions")), "hub", F.concat(F.lit("agent:"), "m"), F.concat(eid, F.lit(":to:"), "m"), F.lit("received")),
        e(h.where("not is_message and target is not null"), "actor", F.col("target"), eid, relation),
        e(h.where("tool is not null and tool <> ''"), "actor", F.concat(F.lit("tool:"), "tool"), F.concat(eid, F.lit(":tool")), F.lit("used")),
        e(h.withColumn("r", F.explode("resources")), "hub", F.concat(F.lit("resource:"), "r"), F.concat(eid, F.lit(":ref:"), "r"), F.lit("referenced")),
    ]
    return reduce(DataFrame.unionByName, parts)


def share_edges(ev: DataFrame, least: int = 2, most: int = 12) -> DataFrame:
    """(resource, a, b): unordered pairs of agents on a resource that at least ``least`` and at most ``most`` touch."""
    touch = ev.where("actor_type <> 'human'").select(F.explode(F.filter("res", lambda r: r.startswith("resource:"))).alias("resource"), "actor_id").distinct()
    few = touch.groupBy("resource").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most)).select("resource")
    own = touch.join(few, "resource")
    return own.withColumnRenamed("actor_id", "a").join(own.withColumnRenamed("actor_id", "b"), "resource").where("a < b")


def propagation_edges(edges: DataFrame, min_score: float = 0.0) -> DataFrame:
    """(src, dst, key, rel, score): the inferred agent graph above a score."""
    a, b = F.concat(F.lit("agent:"), "src"), F.concat(F.lit("agent:"), "dst")
    return edges.where(F.col("score") >= min_score).select(a.alias("src"), b.alias("dst"), F.concat(F.lit("prop:"), "src", F.lit("->"), "dst").alias("key"), F.lit("candidate_propagation").alias("rel"), "score")


def nodes(ev: DataFrame, message_nodes: bool = True) -> DataFrame:
    """(node, node_type, label): every node that an edge or an actor mentions; the latest event's label wins."""
    label = F.coalesce("actor_name", "actor_id") if "actor_name" in ev.columns else F.col("actor_id")
    actors = ev.select(actor_node().alias("node"), label.alias("label"), "rn")
    ends = observed_edges(ev, message_nodes)
    named = ends.select(F.explode(F.array("src", "dst")).alias("node")).select("node", F.expr("substring(node, instr(node, ':') + 1)").alias("label"), F.lit(-1).cast("long").alias("rn"))
    return actors.unionByName(named).groupBy("node").agg(F.max_by("label", "rn").alias("label")).select("node", F.substring_index("node", ":", 1).alias("node_type"), "label")
