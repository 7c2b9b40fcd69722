"""Episodes: activity segments, components of strong pairs, re-splitting, and what each episode contains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frame import PairConfig
from ..plans.shared import stored
from .components import connected_components, spanning_forest
from .edges import collapse_agent_edges, scoped


#: Rows that a task numbers at most when events are cut into segments.
SEGMENT_ROWS = 65_536


@dataclass(frozen=True)
class EpisodeConfig:
    gap_minutes: float = 45
    strong_pair_score: float = 0.45
    min_agents: int = 3
    min_events: int = 4
    max_hours: float = 4
    max_episodes: int = 50
    max_agents: int = 40


def segments(ev: DataFrame, gap_minutes: float = 45) -> DataFrame:
    """(event_id, rn, us, segment): a new segment after every gap longer than ``gap_minutes``.

    A prefix sum in two levels over ranges of ``SEGMENT_ROWS`` row numbers: gaps are found and summed within a range,
    the first row of a range looks back at the last row before it, and what came before is added per range. No task has
    more than a range, however many events a day has; the second level has a row a range.
    """
    rows = ev.select("event_id", "rn", "us", F.floor(F.col("rn") / SEGMENT_ROWS).alias("part"))
    spans = rows.groupBy("part").agg(F.max("us").alias("last"))
    spans = spans.withColumn("before", F.lag("last").over(Window.orderBy("part"))).select("part", "before")
    inside = Window.partitionBy("part").orderBy("rn")
    rows = rows.join(spans, "part")
    gap = F.col("us") - F.coalesce(F.lag("us").over(inside), F.col("before"))
    rows = rows.withColumn("new", F.when(gap > int(gap_minutes * 60_000_000), 1).otherwise(0))
    running = F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("running", running)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("part").agg(F.sum("new").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return rows.join(base, "part").select("event_id", "rn", "us", (F.col("base") + F.col("running")).alias("segment"))


def strong_components(ev: DataFrame, pairs: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """(rn, component): events that strong pairs of one segment connect; a component is named by its first row."""
    seg = segments(ev, cfg.gap_minutes)
    strong = pairs.where(F.col("score") >= cfg.strong_pair_score).select("i", "j")
    a = seg.select(F.col("rn").alias("i"), F.col("segment").alias("si"))
    b = seg.select(F.col("rn").alias("j"), F.col("segment").alias("sj"))
    edges = strong.join(a, "i").join(b, "j").where("si = sj").select("i", "j")
    return connected_components(edges, "i", "j", "rn", "component")


def resplit(members: DataFrame, ev: DataFrame, pairs: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Components of too many actors are split again by ever stricter pairs; events no stricter pair touches go.

    All thresholds cut one maximum spanning forest of the pairs within large components: it has fewer links than there
    are events, and what a threshold leaves of it connects the same events as what it leaves of the pairs.
    """
    actors = ev.select("rn", "actor_id")
    threshold, forest = cfg.strong_pair_score + 0.05, None
    while threshold < 0.85:
        size = members.join(actors, "rn").groupBy("component").agg(F.count_distinct("actor_id").alias("n"))
        large = stored(size.where(F.col("n") > cfg.max_agents).select("component"), "large-components")
        if large.isEmpty():
            break
        own = members.join(large, "component")
        kept = members.join(large, "component", "left_anti")
        ends = lambda c: own.select(F.col("rn").alias(c), F.col("component").alias(f"c{c}"))  # noqa: B023, E731
        inside = lambda links: links.join(ends("i"), "i").join(ends("j"), "j").where("ci = cj").select("i", "j", "score")  # noqa: B023, E731
        if forest is None:
            forest = spanning_forest(inside(pairs.where(F.col("score") >= threshold)))
        edges = inside(forest.where(F.col("score") >= threshold))
        members = stored(kept.select("rn", "component").unionByName(connected_components(edges, "i", "j", "rn", "component")), "components")
        threshold += 0.05
    return members


def split_long(members: DataFrame, ev: DataFrame, cfg: EpisodeConfig) -> DataFrame:
    """Components longer than ``max_hours`` are cut at their largest (first of equal) gap, again and again."""
    timed = stored(members.join(ev.select("rn", "us"), "rn"), "timed-components")
    while True:
        span = timed.groupBy("component").agg((F.max("us") - F.min("us")).alias("span"), F.count(F.lit(1)).alias("n"))
        long = stored(span.where((F.col("span") > int(cfg.max_hours * 3_600_000_000)) & (F.col("n") >= 4)).select("component"), "long-components")
        if long.isEmpty():
            return timed.select("rn", "component")
        inside = Window.partitionBy("component").orderBy("rn")
        own = timed.join(long, "component").withColumn("gap", F.lead("us").over(inside) - F.col("us"))
        cut = own.where("gap is not null").groupBy("component").agg(F.min_by("rn", F.struct(-F.col("gap"), "rn")).alias("cut"))
        own = own.drop("gap").join(cut, "component").withColumn("side", F.col("rn") > F.col("cut"))
        named = own.withColumn("component", F.min("rn").over(Window.partitionBy("component", "side")))
        timed = stored(timed.join(long, "component", "left_anti").select("rn", "component", "us").unionByName(named.select("rn", "component", "us")), "timed-components")


def episode_members(ev: DataFrame, pairs: DataFrame, cfg: EpisodeConfig | None = None) -> DataFrame:
    """(component, rn, event_id, actor_id): all groups that are large enough, before ranking."""
    cfg = cfg or EpisodeConfig()
    members = split_long(resplit(strong_components(ev, pairs, cfg), ev, pairs, cfg), ev, cfg)
    rows = members.join(ev.select("rn", "event_id", "actor_id", "action_type", "us", "timestamp", "res"), "rn")
    size = rows.groupBy("component").agg(F.count_distinct("actor_id").alias("a"), F.count(F.lit(1)).alias("n"))
    return rows.join(size.where((F.col("a") >= cfg.min_agents) & (F.col("n") >= cfg.min_events)).select("component"), "component")


def episode_pairs(members: DataFrame, pairs: DataFrame, key: str = "component") -> DataFrame:
    """Pairs with both ends in one episode, with that episode as their scope."""
    a = members.select(F.col(key).alias("scope"), F.col("rn").alias("i"))
    b = members.select(F.col(key).alias("scope_j"), F.col("rn").alias("j"))
    return scoped(pairs.join(a, "i").join(b, "j").where("scope = scope_j").drop("scope_j"))


def discover(ev: DataFrame, pairs: DataFrame, pair_cfg: PairConfig | None = None, cfg: EpisodeConfig | None = None) -> dict[str, DataFrame]:
    """Ranked episodes: ``episodes`` (one row each), ``members``, ``pairs`` and ``edges`` with the episode's id as scope."""
    cfg = cfg or EpisodeConfig()
    members = stored(episode_members(ev, pairs, cfg), "episode-members")
    own = stored(episode_pairs(members, pairs), "episode-pairs")
    edges = stored(collapse_agent_edges(own, pair_cfg), "episode-edges")
    hours = F.greatest((F.max("us") - F.min("us")) / 3_600_000_000.0, F.lit(1 / 60))
    stats = members.groupBy("component").agg(
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("n_events"), F.count_distinct("actor_id").alias("n_agents"),
        F.round(hours, 2).alias("duration_hours"), F.round(F.count(F.lit(1)) / hours, 1).alias("events_per_hour"), F.array_sort(F.collect_set("actor_id")).alias("agents"),
    )
    n_pairs = own.groupBy(F.col("scope").alias("component")).agg(F.count(F.lit(1)).alias("n_candidate_pairs"))
    n_edges = edges.groupBy(F.col("scope").alias("component")).agg(F.count(F.lit(1)).alias("n_agent_edges"), F.sum((F.col("confidence") == "strong").cast("int")).alias("n_strong_edges"))
    zero = {"n_candidate_pairs": 0, "n_agent_edges": 0, "n_strong_edges": 0}
    all_ = stats.join(n_pairs, "component", "left").join(n_edges, "component", "left").fillna(zero)
    order = (F.desc(F.col("n_agent_edges") + 2 * F.col("n_strong_edges")), F.desc("n_agents"), F.asc("component"))
    best = all_.orderBy(*order).limit(cfg.max_episodes)  # a top-k report, a few rows
    ranked = stored(best.withColumn("episode_id", F.format_string("EP%03d", F.row_number().over(Window.orderBy(*order)))), "episodes")
    names = ranked.select("component", "episode_id")
    rescope = lambda df: df.join(F.broadcast(names), df["scope"] == names["component"]).drop("scope", "component").withColumnRenamed("episode_id", "scope")
    return {"episodes": ranked, "members": members.join(F.broadcast(names), "component"), "pairs": rescope(own), "edges": rescope(edges)}


def top_counts(members: DataFrame, column: str, most: int, key: str = "episode_id") -> DataFrame:
    """The most frequent values of a column (arrays are exploded) in each episode; equal counts by first appearance."""
    value = F.explode(column) if dict(members.dtypes)[column].startswith("array") else F.col(column)
    counted = members.select(key, "rn", value.alias("value")).where(~F.col("value").startswith("room:")).groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("first"))
    place = Window.partitionBy(key).orderBy(F.desc("n"), "first", "value")
    return counted.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select(key, "value", "n", "place")
