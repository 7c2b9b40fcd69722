"""Candidate pairs of events and their scores.

Three generators propose earlier events for each later one: shared resources (the last 50 of each), direct addressing
(reply and inbox), and nearest vectors. All are equi-joins: time is cut into buckets of the look-back window and rows into
blocks of the most a window may hold, an earlier event enters its own and the next of either, and the exact bounds are
residual conditions; touches of a resource are numbered and meet in blocks of the last 50.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frame import COMPONENTS, READ_ONLY, PairConfig, is_said, text_key
from ..plans.shared import delete, ship, stored

#: Cosines that agree in so many places count as equal, whatever the order of adding; the earlier row then goes first.
TIE_DIGITS = 9
#: Rows of a later and of an earlier side that a matrix product takes at a time.
TILE, SPAN = 256, 4096
#: A row in a block, or the start of row j's window there.
MARK = "struct<block:bigint,at:bigint,row:bigint,j:bigint>"
#: Rows of a block that is searched for common causes, and pairs that are held against it in one task.
CAUSE_ROWS, CAUSE_PAIRS = 1024, 16_384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def with_text_flag(ev: DataFrame, cfg: PairConfig) -> DataFrame:
    """Add ``has_text``: normalised text that is not empty and that fewer than ``template_min_actors`` actors posted.

    The frame has texts (``content``) or their hashes (``text_key``).
    """
    ev = ev.withColumn("__text", F.col("text_key") if "text_key" in ev.columns else text_key(F.col("content")))
    templates = ev.where("__text is not null").groupBy("__text").agg(F.count_distinct("actor_id").alias("n")).where(F.col("n") >= cfg.template_min_actors).select("__text", F.lit(True).alias("__template"))
    return ev.join(templates, "__text", "left").withColumn("has_text", F.col("__text").isNotNull() & F.col("__template").isNull()).drop("__text", "__template")


def _sides(ev: DataFrame, cfg: PairConfig, src: list, dst: list) -> tuple[DataFrame, DataFrame]:
    """Earlier side in its own and the next bucket and row block, later side in its own; ``src``, ``dst``: more columns.

    A bucket is one look-back window of time, a block ``max_window_events`` rows: what meets in both is bounded by
    either, however busy a time is. Of two rows in reach exactly one combination meets.
    """
    b, k = F.floor(F.col("us") / cfg.window_us), F.floor(F.col("rn") / cfg.max_window_events)
    cell = lambda x, y: F.named_struct(F.lit("bucket"), x, F.lit("block"), y)
    earlier = ev.select(F.col("rn").alias("i"), F.col("us").alias("us_i"), F.explode(F.array(cell(b, k), cell(b, k + 1), cell(b + 1, k), cell(b + 1, k + 1))).alias("cell"), *src)
    later = ev.where(F.col("actor_type").isin(*cfg.actor_types)).select(F.col("rn").alias("j"), F.col("us").alias("us_j"), b.alias("bucket"), k.alias("block"), *dst)
    return earlier.select("i", "us_i", "cell.bucket", "cell.block", *[c for c in earlier.columns if c not in ("i", "us_i", "cell")]), later


def _met(earlier: DataFrame, later: DataFrame) -> Column:
    return (earlier["bucket"] == later["bucket"]) & (earlier["block"] == later["block"])


def _within(cfg: PairConfig) -> Column:
    return (F.col("i") < F.col("j")) & (F.col("us_j") - F.col("us_i") <= cfg.window_us) & (F.col("j") - F.col("i") <= cfg.max_window_events)


def band_pairs(ev: DataFrame, cfg: PairConfig) -> DataFrame:
    """(i, j): each eligible event with all rows before it in its window.

    Rows are numbered by time without a gap (the frame's contract; a frame with gaps raises), so a window is a range of
    numbers. Only its first number is looked for, among the rows of two blocks in the order of time; pairs arise where they
    are returned, none is proposed and dropped.
    """
    size = cfg.max_window_events
    k = F.floor(F.col("rn") / size)
    none = F.lit(None).cast("bigint")
    mark = lambda block, at, row, j: F.struct(block.alias("block"), at.alias("at"), row.alias("row"), j.alias("j"))
    placed = [mark(b, F.col("us"), F.col("rn"), none) for b in (k, k + 1)]
    asked = F.when(F.col("actor_type").isin(*cfg.actor_types), F.array(mark(k, F.col("us") - cfg.window_us, none, F.col("rn"))))
    marks = ev.select(F.inline(F.concat(F.array(*placed), F.coalesce(asked, F.array().cast(f"array<{MARK}>")))))
    by_time = Window.partitionBy("block").orderBy("at", F.col("row").isNotNull())  # rows at the very start of a window lie in it
    before, whole = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max("row").over(whole)
    missing = F.count("row").over(whole) != last - F.greatest(F.lit(0), (F.col("block") - 1) * size) + 1
    found = marks.select("j", F.greatest(F.col("j") - size, F.coalesce(F.max("row").over(before) + 1, F.lit(0))).alias("first"), missing.alias("missing"))
    first = F.when(F.col("missing"), F.raise_error(F.lit("band_pairs: rows are not numbered without gaps"))).otherwise(F.col("first"))
    reach = found.where("j is not null").select("j", first.alias("first")).where("first < j")
    return reach.select(F.explode(F.sequence("first", F.col("j") - 1)).alias("i"), "j")


def resource_pairs(ev: DataFrame, cfg: PairConfig, judge: Callable[[DataFrame], DataFrame] | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """(i, j, resource): for each resource of j the last ``last_per_resource`` events of the window that touch it.

    ``judge`` may drop pairs where they arise, before any are moved, by the columns ``carried`` of either side.
    """
    touches = numbered_touches(ev, cfg, *carried)
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in carried]
    block = F.floor(F.col("q") / cfg.last_per_resource)
    earlier = touches.select(F.col("rn").alias("i"), F.col("us").alias("us_i"), F.col("q").alias("q_i"), "resource", F.explode(F.array(block, block + 1)).alias("block"), *side("i"))
    later = touches.where(F.col("actor_type").isin(*cfg.actor_types)).select(F.col("rn").alias("j"), F.col("us").alias("us_j"), F.col("q").alias("q_j"), "resource", block.alias("block"), *side("j"))
    near = (F.col("q_j") - F.col("q_i")).between(1, cfg.last_per_resource)
    met = earlier.join(later, ["resource", "block"]).where(near & _within(cfg))
    return (judge(met) if judge else met).select("i", "j", "resource")


def numbered_touches(ev: DataFrame, cfg: PairConfig, *carried: str) -> DataFrame:
    """(rn, us, actor_type, resource, q, ``carried``): q numbers the touches of a resource by row.

    Rows are numbered within a resource's row block, and blocks by what came before, so that no task sorts all touches
    of a busy resource.
    """
    touch = ev.select("rn", "us", "actor_type", F.explode("res").alias("resource"), F.floor(F.col("rn") / cfg.max_window_events).alias("part"), *carried)
    inside = Window.partitionBy("resource", "part").orderBy("rn")
    before = Window.partitionBy("resource").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = touch.groupBy("resource", "part").agg(F.count(F.lit(1)).alias("n")).select("resource", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return touch.withColumn("nth", F.row_number().over(inside)).join(sizes, ["resource", "part"]).select("rn", "us", "actor_type", "resource", (F.col("base") + F.col("nth")).alias("q"), *carried)


def reply_pairs(ev: DataFrame, cfg: PairConfig) -> DataFrame:
    """(i, j): j mentions an actor; i is that actor's most recent eligible event, if it lies in the window."""
    eligible = ev.where(F.col("actor_type").isin(*cfg.actor_types))
    earlier, _ = _sides(eligible, cfg, [F.col("actor_id").alias("who")], [])
    _, later = _sides(ev, cfg, [], [F.explode(F.array_distinct("mentions")).alias("mention")])
    joined = earlier.join(later, _met(earlier, later) & (F.col("who") == F.col("mention")) & _within(cfg))
    return joined.groupBy("j", "mention").agg(F.max("i").alias("i")).select("i", "j")


def inbox_pairs(ev: DataFrame, cfg: PairConfig) -> DataFrame:
    """(i, j): i mentions j's actor, after that actor's previous event, at most ``inbox_rows`` rows back."""
    mine = Window.partitionBy("actor_id").orderBy("rn")
    eligible = ev.where(F.col("actor_type").isin(*cfg.actor_types)).withColumn("prev", F.coalesce(F.lag("rn").over(mine), F.lit(-1)))
    earlier, _ = _sides(ev, cfg, [F.explode(F.array_distinct("mentions")).alias("mention")], [])
    _, later = _sides(eligible, cfg, [], [F.col("actor_id").alias("who"), "prev"])
    on = _met(earlier, later) & (F.col("who") == F.col("mention")) & _within(cfg)
    return earlier.join(later, on & (F.col("i") > F.col("prev")) & (F.col("j") - F.col("i") <= cfg.inbox_rows)).select("i", "j")


def nearest(later: pa.Table, earlier: pa.Table, window_us: int, reach: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in ``later``, places in ``earlier``, cosine) of the ``most`` nearest rows in each later row's window.

    ``earlier`` is sorted by row. Products are taken tile by tile; what is best so far is merged with the best of the next
    tile, so that memory doesn't depend on the window.
    """
    out: list[tuple[np.ndarray, ...]] = []
    a, b = (np.stack(t.column("emb").to_numpy()) if len(t) else np.zeros((0, 1)) for t in (later, earlier))
    (j, us_j), (i, us_i) = ((t.column("rn").to_numpy(), t.column("us").to_numpy()) for t in (later, earlier))
    for x in range(0, len(later), TILE):
        rows = slice(x, x + TILE)
        best = np.full((len(j[rows]), 0), -np.inf)
        at = np.zeros((len(j[rows]), 0), np.int64)
        for y in range(0, len(earlier), SPAN):
            span = slice(y, y + SPAN)
            sim = a[rows].astype(np.float64) @ b[span].astype(np.float64).T
            ahead = j[rows, None] - i[None, span]
            sim[(ahead < 1) | (ahead > reach) | (us_j[rows, None] - us_i[None, span] > window_us)] = -np.inf
            best = np.concatenate([best, sim], 1)
            at = np.concatenate([at, np.broadcast_to(np.arange(y, y + sim.shape[1]), sim.shape)], 1)
            if best.shape[1] > most:  # the best, of equal ones the first
                value = np.round(best, TIE_DIGITS)
                least = -np.partition(-value, most - 1, 1)[:, most - 1 : most]
                more, equal = value > least, value == least
                kept = more | (equal & (np.cumsum(equal, 1) <= most - more.sum(1, keepdims=True)))
                best, at = best[kept].reshape(-1, most), at[kept].reshape(-1, most)
        order = np.lexsort((at, -np.round(best, TIE_DIGITS)), axis=1)
        best, at = np.take_along_axis(best, order, 1), np.take_along_axis(at, order, 1)
        row, place = np.nonzero(best > -np.inf)
        out.append((row + x, at[row, place], best[row, place]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([o[k] for o in out] or [none]) for k in range(3))


def semantic_pairs(ev: DataFrame, cfg: PairConfig) -> DataFrame:
    """(i, j, sim): of the 3k nearest rows of the window the first k by another actor with ``semantic_floor`` or more.

    Slots are taken before actors and eligibility are looked at: the 3k nearest may hold the actor's own rows. Rows are
    dealt into blocks of ``max_window_events``: a row is compared with those of its own block and the one before, so that
    each vector is sent twice, and a group has two blocks at most, however busy a time is. Rows without a vector are left
    out; vectors of different lengths never meet.
    """
    ship(ev.sparkSession)
    block = F.floor(F.col("rn") / cfg.max_window_events)
    asks = F.coalesce(F.col("has_text"), F.lit(False)) & F.col("actor_type").isin(*cfg.actor_types)
    rows = ev.where("emb is not null").select("rn", "us", "actor_id", "emb", F.size("emb").alias("width"), asks.alias("asks"), F.explode(F.array(block, block + 1)).alias("block"), block.alias("home"))
    slots, keep, floor, window, reach = 3 * cfg.semantic_top_k, cfg.semantic_top_k, cfg.semantic_floor, cfg.window_us, cfg.max_window_events

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("rn")
        home = group.column("home").to_numpy() == group.column("block").to_numpy()
        later = group.filter(pa.array(home & group.column("asks").to_numpy(zero_copy_only=False).astype(bool)))
        if not len(later):
            group = group.slice(0, 0)
        row, at, sim = nearest(later, group, window, reach, slots)
        who, asker = group.column("actor_id").to_numpy(zero_copy_only=False), later.column("actor_id").to_numpy(zero_copy_only=False)
        good = np.flatnonzero((sim >= floor) & (who[at] != asker[row])) if len(row) else np.zeros(0, np.int64)
        first = np.searchsorted(row[good], row[good]) if len(good) else good  # rows come in order, best first
        good = good[np.arange(len(good)) - first < keep]
        i, j = group.column("rn").to_numpy(), later.column("rn").to_numpy()
        return pa.table({"i": pa.array(i[at[good]], pa.int64()), "j": pa.array(j[row[good]], pa.int64()), "sim": pa.array(sim[good], pa.float64())})

    return rows.groupBy("block", "width").applyInArrow(compare, "i long, j long, sim double")


def resource_weights(ev: DataFrame, cfg: PairConfig) -> DataFrame:
    """(resource, n_agents, weight): everything many agents touch says little."""
    eligible = F.when(F.col("actor_type").isin(*cfg.actor_types), F.col("actor_id"))
    total = ev.agg(F.greatest(F.lit(1), F.count_distinct(eligible)).alias("total"))
    n = F.col("n_agents")
    share = n / F.col("total")
    base = F.when(share <= cfg.resource_share_cap, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), 1 - share))
    crowd = F.when(n > 7, F.least(F.lit(1.0), 3.0 / F.log2(n + 1))).otherwise(F.lit(1.0))
    room = F.when(F.col("resource").startswith("room:"), F.lit(0.2)).otherwise(F.lit(1.0))
    counted = ev.select(F.explode("res").alias("resource"), "actor_id").groupBy("resource").agg(F.count_distinct("actor_id").alias("n_agents"))
    return counted.join(F.broadcast(total)).select("resource", "n_agents", (base * crowd * room).alias("weight"))  # one row


def weighted_resources(ev: DataFrame, eligible: DataFrame, cfg: PairConfig) -> DataFrame:
    """(rn, weighted): what each event that can be a source touches, as array<struct<resource, weight>>.

    Weights come to events, not to pairs, which are many more.
    """
    touch = eligible.where(~F.col("action_type").isin(*READ_ONLY)).select("rn", F.explode("res").alias("resource"))
    return touch.join(resource_weights(ev, cfg).select("resource", "weight"), "resource").groupBy("rn").agg(F.collect_list(F.struct("resource", "weight")).alias("weighted"))


def candidates(ev: DataFrame, weighted_: DataFrame, cfg: PairConfig, semantic: bool) -> DataFrame:
    """(i, j, addressed): every proposal of any generator that can still be a pair, once; ``weighted_``: see :func:`weighted_resources`.

    Shared resources propose most, and most of these can't pass: they are judged where they arise, with the largest
    values that their semantic and resource components can have. A pair that only passes because it is addressed is
    proposed by the generators of direct addressing too.
    """
    plain = resource_pairs(ev, cfg)
    if min(cfg.weight(c) for c in COMPONENTS) >= 0:  # else a larger component might lower the score
        carried = ["event_id", "actor_id", "action_type", "target_id", "target_type", "tool", "reply_to", "goal_key", "has_text", "eligible", "most"]
        most = weighted_.select("rn", F.array_max(F.transform("weighted", lambda x: x["weight"])).alias("most"))
        rows = ev.withColumn("eligible", F.col("actor_type").isin(*cfg.actor_types)).join(most, "rn", "left")
        said = (F.col("has_text_i") & F.col("has_text_j")).cast("double") if semantic else F.lit(0.0)
        possible = lambda met: judged(met.where("eligible_i and actor_id_i <> actor_id_j"), cfg, said, F.coalesce("most_i", F.lit(0.0)), F.lit(0.0))
        plain = resource_pairs(rows, cfg, possible, carried)
    plain = plain.select("i", "j", F.lit(0.0).alias("addressed"))
    direct = reply_pairs(ev, cfg).unionByName(inbox_pairs(ev, cfg)).withColumn("addressed", F.lit(1.0))
    both = plain.unionByName(direct)
    if semantic:
        both = both.unionByName(semantic_pairs(ev, cfg).select("i", "j", F.lit(0.0).alias("addressed")))
    return both.groupBy("i", "j").agg(F.max("addressed").alias("addressed"))


def weighted(cfg: PairConfig, prefix: str = "") -> Column:
    """The weighted sum, always in the order of COMPONENTS."""
    total = F.lit(0.0)
    for c in COMPONENTS:
        total = total + F.lit(float(cfg.weight(c))) * F.col(prefix + c)
    return total


def judged(pair: DataFrame, cfg: PairConfig, semantic: Column, resource: Column, addressed: Column) -> DataFrame:
    """Add ``dt``, the components and their sum ``raw``; pairs stay that have a signal and reach ``min_pair_score``."""
    c = F.col
    pair = pair.withColumn("dt", (c("us_j") - c("us_i")) / 60_000_000.0).withColumn("temporal", F.exp(-c("dt") / max(1.0, cfg.window_minutes / 3.0)))
    pair = pair.withColumn("semantic", semantic).withColumn("resource", resource)
    structural = ((c("target_type_i") == "agent") & (c("target_id_i") == c("actor_id_j"))) | (c("reply_to_j") == c("event_id_i"))
    pair = pair.withColumn("direct", F.when((addressed > 0) | F.coalesce(structural, F.lit(False)), 1.0).otherwise(0.0))
    goal = F.when((c("action_type_j") == "goal_set") & (c("semantic") > 0), 1.0).when((c("goal_key_i") == c("goal_key_j")) & (c("goal_key_i") != ""), 0.5).otherwise(0.0)
    same_tool = (c("tool_i") == c("tool_j")) & (c("tool_i") != "")
    action = F.when(c("action_type_i") != c("action_type_j"), 0.0).when(same_tool, 1.0).when(c("action_type_i") == "message", 0.3).otherwise(0.6)
    pair = pair.withColumn("goal", goal).withColumn("action", action).withColumn("raw", weighted(cfg))
    return pair.where((c("semantic") != 0) | (c("resource") >= 0.15) | (c("direct") != 0) | (c("goal") != 0)).where(c("raw") >= cfg.min_pair_score)


def score_pairs(ev: DataFrame, cfg: PairConfig | None = None, semantic: bool = False) -> DataFrame:
    """All scored pairs; ``semantic``: the frame has vectors (``emb``). Common causes are a step of their own."""
    cfg = cfg or PairConfig()
    ev = with_text_flag(ev, cfg) if semantic else ev.withColumn("has_text", F.lit(False))
    names = ["event_id", "timestamp", "us", "actor_id", "action_type", "target_id", "target_type", "tool", "reply_to", "origin", "goal_key", "res", "has_text"]
    if semantic:  # vectors only count where there is text: those of templates are not moved with their pairs
        ev = ev.withColumn("said_emb", F.when(F.col("has_text"), F.col("emb")))
    side = lambda s: [F.col(n).alias(f"{n}_{s}") for n in names + ["said_emb"] * semantic]
    eligible = ev.where(F.col("actor_type").isin(*cfg.actor_types))
    weights = weighted_resources(ev, eligible, cfg)
    first = eligible.join(weights, "rn", "left").select(F.col("rn").alias("i"), *side("i"), "weighted")
    pair = candidates(ev, weights, cfg, semantic).join(first, "i").join(eligible.select(F.col("rn").alias("j"), *side("j")), "j")
    pair = pair.where(F.col("actor_id_i") != F.col("actor_id_j"))
    c = F.col
    close = F.lit(0.0)
    if semantic:
        pair = pair.withColumn("cos", F.when(c("has_text_i") & c("has_text_j"), dot(c("said_emb_i"), c("said_emb_j"))))
        scaled = (c("cos") - cfg.semantic_floor) / (1.0 - cfg.semantic_floor)
        close = F.when(c("cos") >= cfg.semantic_floor, scaled).otherwise(F.lit(0.0))
    shared = F.when(c("action_type_i").isin(*READ_ONLY), F.array().cast("array<string>")).otherwise(F.array_intersect("res_i", "res_j"))
    pair = pair.withColumn("shared_resources", shared)
    shared_weights = F.transform(F.filter("weighted", lambda x: F.array_contains(F.col("shared_resources"), x["resource"])), lambda x: x["weight"])
    pair = judged(pair, cfg, close, F.coalesce(F.array_max(shared_weights), F.lit(0.0)), c("addressed"))
    return pair.select(
        "i", "j", c("actor_id_i").alias("src_agent"), c("actor_id_j").alias("dst_agent"), c("event_id_i").alias("src_event"), c("event_id_j").alias("dst_event"),
        c("timestamp_i").alias("src_ts"), c("timestamp_j").alias("dst_ts"), F.round("dt", 2).alias("dt_minutes"), F.round("raw", 4).alias("score"),
        *[F.round(x, 4).alias(x) for x in COMPONENTS], "shared_resources", F.when((c("origin_i") == c("origin_j")) & (c("origin_i") != ""), c("origin_i")).alias("same_origin"),
    )


def rescore_pairs(pairs: DataFrame, cfg: PairConfig | None = None) -> DataFrame:
    """Scores from the (rounded) components as they are now; gate and threshold apply to what comes out."""
    cfg = cfg or PairConfig()
    gate = (F.col("semantic") > 0) | (F.col("resource") >= 0.15) | (F.col("direct") > 0) | (F.col("goal") > 0)
    # In whole ten-thousandths: halves are rounded up exactly, whatever the order of adding.
    total = sum(F.lit(round(cfg.weight(c) * 10_000)) * F.round(F.col(c) * 10_000).cast("bigint") for c in COMPONENTS)
    return pairs.withColumn("score", F.floor((total + 5_000) / 10_000) / 10_000).where(gate & (F.col("score") >= cfg.min_pair_score))


def latest_resembling(asked: pa.Table, rows: pa.Table, window_us: int, sim: float, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``asked``, places in ``rows``): each pair's last ``keep`` rows of a block that resemble both its ends."""
    order = np.argsort(-rows.column("rn").to_numpy())
    rows = rows.take(pa.array(order))
    k, us, who = rows.column("rn").to_numpy(), rows.column("us").to_numpy(), rows.column("actor_id").to_numpy(zero_copy_only=False)
    vectors = np.stack(rows.column("emb").to_numpy()).astype(np.float64).T
    out = []
    for x in range(0, len(asked), TILE):
        part = asked.slice(x, TILE)
        near = np.ones((len(part), len(rows)), bool)
        for end in ("emb_i", "emb_j"):
            near &= np.stack(part.column(end).to_numpy()).astype(np.float64) @ vectors >= sim
        near &= (k[None, :] < part.column("i").to_numpy()[:, None]) & (part.column("us_i").to_numpy()[:, None] - us[None, :] <= window_us)
        for end in ("src_agent", "dst_agent"):
            near &= who[None, :] != part.column(end).to_numpy(zero_copy_only=False)[:, None]
        pair, row = np.nonzero(near & (np.cumsum(near, 1) <= keep))
        out.append((pair + x, row))
    none = np.zeros(0, np.int64)
    pair, row = (np.concatenate([o[c] for o in out] or [none]) for c in range(2))
    return pair, order[row]


def common_causes(pairs: DataFrame, ev: DataFrame, cfg: PairConfig | None = None, keep: int = 3) -> DataFrame:
    """Add ``common_cause`` and ``common_cause_actors``: the last third-party events before i that resemble both ends.

    Only pairs with a semantic component are looked at. A third event lies in the window before i, has text, another
    actor than either end, and a cosine of ``common_cause_sim`` or more with both.

    Rows are searched backwards in blocks of ``CAUSE_ROWS``: first the block of i, then the one before, then two, then
    four, and so on; a pair that has found ``keep`` events, or whose window has ended, is done. A block that many pairs
    ask for is dealt to several groups, so a group is bounded on both sides, however many events fall into a window.
    """
    cfg = cfg or PairConfig()
    spark = ev.sparkSession
    ship(spark)
    block = F.floor(F.col("rn") / CAUSE_ROWS)
    width = F.size("emb")
    said = F.col("said") if "said" in ev.columns else is_said(F.col("content"))
    texts = ev.where(said & F.col("emb").isNotNull()).select("rn", "us", "event_id", "actor_id", "emb", width.alias("width"), block.alias("block"))
    spans = ev.groupBy(block.alias("block")).agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"))  # a row a block
    ends = ev.where("emb is not null").select("rn", "us", "emb")
    asked = pairs.where("semantic > 0").select("i", "j", "src_agent", "dst_agent")
    asked = asked.join(ends.select(F.col("rn").alias("i"), F.col("us").alias("us_i"), F.col("emb").alias("emb_i")), "i").join(ends.select(F.col("rn").alias("j"), F.col("emb").alias("emb_j")), "j")
    asked = asked.where(F.size("emb_i") == F.size("emb_j")).withColumns({"width": F.size("emb_i"), "next": F.floor(F.col("i") / CAUSE_ROWS), "found": F.lit(0).cast("long")})
    open_ = stored(asked, "open-pairs")
    hits, step, window, sim = [], 1, cfg.window_us, cfg.common_cause_sim

    def search(probes: pa.Table, rows: pa.Table) -> pa.Table:
        pair, row = latest_resembling(probes, rows, window, sim, keep) if len(rows) and len(probes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        p, r = probes.take(pa.array(pair)), rows.take(pa.array(row))
        return pa.table({"i": p.column("i"), "j": p.column("j"), "k": r.column("rn"), "event_k": r.column("event_id"), "actor_k": r.column("actor_id")})

    while not open_.isEmpty():
        each = open_.withColumn("block", F.explode(F.sequence(F.greatest(F.col("next") - (step - 1), F.lit(0)), F.col("next")))).join(spans, "block")
        each = each.where(F.col("us_i") - F.col("last_us") <= window)
        counts = each.groupBy("block", "width").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / CAUSE_PAIRS).cast("int")).select("block", "width", "parts")
        probes = each.join(counts, ["block", "width"]).withColumn("part", F.pmod(F.xxhash64("i", "j"), F.col("parts")).cast("int"))
        dealt = texts.join(counts, ["block", "width"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("block").alias("b"), F.col("width").alias("w"), F.col("part").alias("p"), "rn", "us", "event_id", "actor_id", "emb")
        met = probes.select("block", "width", "part", "i", "j", "us_i", "src_agent", "dst_agent", "emb_i", "emb_j").groupBy("block", "width", "part").cogroup(dealt.groupBy("b", "w", "p"))
        new = stored(met.applyInArrow(search, "i long, j long, k long, event_k string, actor_k string"), "common-causes")
        hits.append(new)
        # Open stays who has found too few and whose window reaches beyond the lowest block of this round.
        lowest = F.greatest(F.col("next") - (step - 1), F.lit(0))
        left = open_.withColumn("block", lowest).join(spans.select("block", "first_us"), "block").where((F.col("block") > 0) & (F.col("us_i") - F.col("first_us") <= window))
        left = left.join(new.groupBy("i", "j").agg(F.count(F.lit(1)).alias("more")), ["i", "j"], "left").withColumn("found", F.col("found") + F.coalesce("more", F.lit(0)))
        nxt = stored(left.where(F.col("found") < keep).withColumn("next", F.col("block") - 1).select(*open_.columns), "open-pairs")
        delete(spark, open_.scratch_path)
        # One block again before the rounds grow: most pairs are done by then.
        open_, step = nxt, max(1, 2 * step if len(hits) > 1 else 1)
    delete(spark, open_.scratch_path)
    every = hits[0] if hits else spark.createDataFrame([], "i long, j long, k long, event_k string, actor_k string")
    for more in hits[1:]:
        every = every.unionByName(more)
    last = Window.partitionBy("i", "j").orderBy(F.desc("k"))
    best = every.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= keep)
    found = best.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("k", "event_k", "actor_k"))).alias("x"))
    empty = F.array().cast("array<string>")
    out = pairs.join(found, ["i", "j"], "left")
    return out.withColumn("common_cause", F.coalesce("x.event_k", empty)).withColumn("common_cause_actors", F.coalesce("x.actor_k", empty)).drop("x")
