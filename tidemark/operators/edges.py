"""Agent-to-agent edges: the mean of the three best pairs, with confidence and competing explanations.

Every operator works on pairs with a ``scope`` column (the whole table, an episode, an episode under an intervention),
so that one plan serves all of them; edges of different scopes never meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frame import COMPONENTS, PairConfig
from ..plans.shared import ship, stored

KEY = ["scope", "src", "dst"]
GLOBAL = "*"
#: Links of a block of agents, ways that are followed at a time, and places of a table of a block's edges, about.
LEGS, WAYS, TABLE = 500_000, 2_000_000, 16_000_000


def scoped(pairs: DataFrame, scope: str = GLOBAL) -> DataFrame:
    """Pairs with a scope, and with the columns of common causes and origins where they lack them."""
    empty = F.array().cast("array<string>")
    for name, default in (("scope", F.lit(scope)), ("common_cause", empty), ("common_cause_actors", empty), ("same_origin", F.lit(None).cast("string"))):
        if name not in pairs.columns:
            pairs = pairs.withColumn(name, default)
    return pairs


def ranked(pairs: DataFrame) -> DataFrame:
    """Pairs with their place (from 1) among those of their edge: best score first, then by position."""
    best = Window.partitionBy("scope", "src_agent", "dst_agent").orderBy(F.desc("score"), "j", "i")
    return pairs.withColumn("nth", F.row_number().over(best))


#: How the alternatives begin that name another cause than influence along the edge.
STRUCTURAL = ("common cause", "same origin", "possibly indirect", "shared upstream")


def downgrade(confidence: Column) -> Column:
    return F.when(confidence == "strong", "moderate").otherwise("weak")


def rounded_mean(column: str, chosen: Column) -> Column:
    """The mean to four places of numbers that have four, from whole numbers: no order of adding changes it."""
    whole = F.round(F.col(column) * 10_000).cast("bigint")
    return F.round(F.sum(F.when(chosen, whole)) / F.count(F.when(chosen, F.lit(1)))) / 10_000


def collapse(pairs: DataFrame, cfg: PairConfig | None = None) -> DataFrame:
    """Edges before the structural rules: score, components, support, times, evidence, confidence, alternatives."""
    cfg = cfg or PairConfig()
    every = stored(scoped(pairs), "scoped-pairs")  # read three times below
    most = max(3, cfg.max_pairs_per_edge)
    # A bound on the place lets each task keep its own best pairs of an edge before any are moved.
    best = ranked(every).where(F.col("nth") <= most).withColumnsRenamed({"src_agent": "src", "dst_agent": "dst"})
    p = every.withColumnsRenamed({"src_agent": "src", "dst_agent": "dst"})
    top = F.col("nth") <= 3
    place = F.struct("nth", F.struct("src_event", "dst_event").alias("e"))
    evidence = F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= cfg.max_pairs_per_edge, place))), lambda x: x["e"])
    strongest = best.groupBy(*KEY).agg(
        F.avg(F.when(top, F.col("score"))).alias("mean"), rounded_mean("score", top).alias("score"), *[rounded_mean(c, top).alias(c) for c in COMPONENTS],
        F.avg(F.when(top, F.col("same_origin").isNotNull().cast("double"))).alias("origin_share"),
        F.min_by("same_origin", F.when(F.col("same_origin").isNotNull(), F.col("nth"))).alias("origin"), evidence.alias("evidence_pairs"),
        F.max(F.when(F.col("nth") == 1, F.struct("common_cause", "common_cause_actors"))).alias("best"),
    ).where(F.col("mean") >= cfg.min_edge_score)
    whole = p.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("support"), F.min("src_ts").alias("first_ts"), F.max("dst_ts").alias("last_ts"), F.median("dt_minutes").alias("dt_median"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("shared_resources")))).alias("shared_resources"),
    )
    edges = strongest.join(whole, KEY)
    # Whoever reaches src by address or resource is upstream of it, and no confounder.
    upstream = p.where((F.col("direct") > 0) | (F.col("resource") >= 0.15)).groupBy("scope", F.col("dst").alias("src")).agg(F.collect_set("src").alias("upstream"))
    edges = edges.join(upstream, ["scope", "src"], "left").withColumn("upstream", F.coalesce("upstream", F.array().cast("array<string>")))
    causes = F.filter(F.arrays_zip("best.common_cause", "best.common_cause_actors"), lambda x: ~F.array_contains(F.col("upstream"), x["common_cause_actors"]))
    edges = edges.withColumn("common_cause_events", F.array_sort(F.array_distinct(F.transform(causes, lambda x: x["common_cause"]))))
    c = F.col
    n = F.size("common_cause_events")
    has_origin = F.coalesce(c("origin_share") >= 0.5, F.lit(False))
    signals = sum((c(x) > 0).cast("int") for x in ("semantic", "resource", "direct", "goal"))
    level = F.when((c("mean") >= 0.55) & (signals >= 2) & (c("support") >= 2), 2).when((c("mean") >= 0.45) | ((signals >= 2) & (c("support") >= 2)), 1).otherwise(0)
    level = level - F.when((n > 0) | has_origin, 1).otherwise(0)
    rooms = (F.size("shared_resources") > 0) & F.forall("shared_resources", lambda r: r.startswith("room:"))
    clauses = [
        F.when(n > 0, F.concat(F.lit("common cause: "), n.cast("string"), F.lit(" message(s) of somebody else came first and read like both ("), F.array_join(F.slice("common_cause_events", 1, 2), ", "), F.lit(")"))),
        F.when((c("direct") == 0) & (c("resource") == 0), F.lit("wording only: a common task or instruction would look the same")),
        F.when(rooms, F.lit("same room only: being there together is no exchange")),
        F.when(has_origin, F.concat(F.lit("same origin ("), "origin", F.lit("): the two names may belong to one operator"))),
        F.when(c("goal") > 0, F.lit("assigned goal: both were set the same one")),
        F.when(c("dt_median") < 2, F.lit("under two minutes apart: one event may have set off both")),
    ]
    return edges.select(
        *KEY, "score", *COMPONENTS, "support", "first_ts", "last_ts", "dt_median", "evidence_pairs", "shared_resources",
        F.when(level >= 2, "strong").when(level == 1, "moderate").otherwise("weak").alias("confidence"),
        F.filter(F.array(*clauses), lambda x: x.isNotNull()).alias("alternatives"), explanation(c("src"), c("dst")).alias("explanation"), "common_cause_events",
    )


def explanation(src: Column, dst: Column) -> Column:
    """One sentence: who acted after whom, and the signals that link them."""
    c = F.col
    parts = F.array(
        F.when(c("direct") > 0, F.concat(src, F.lit(" and "), dst, F.lit(" are in direct exchange"))),
        F.when((c("resource") > 0) & (F.size("shared_resources") > 0), F.concat(F.lit("shared use of "), F.array_join(F.slice("shared_resources", 1, 2), ", "))),
        F.when(c("semantic") > 0, F.concat(F.lit("what "), dst, F.lit(" wrote reads like what "), src, F.lit(" wrote ("), F.format_string("%.2f", c("semantic")), F.lit(")"))),
        F.when(c("goal") > 0, F.lit("a goal in common")),
        F.when(c("action") >= 0.6, F.lit("the same kind of action")),
    )
    body = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "; ")
    body = F.when(body == "", F.lit("nothing but their order in time")).otherwise(body)
    return F.concat(src, F.lit(" came before "), dst, F.format_string(" (%d pairs, half of them within %.0f minutes): ", c("support"), c("dt_median")), body, F.lit("."))


def first_between(edges: DataFrame, into: DataFrame, onward: DataFrame, name: str) -> DataFrame:
    """(scope, src, dst, ``name``): the first agent by name on a way from src to dst that explains an edge.

    ``edges``: (scope, src, dst, score, t); ``into``: (scope, src, via, score, t), what links an edge's src to agents;
    ``onward``: (scope, via, dst, score, t), what links these to its dst. A way explains the edge if both its links score
    nine tenths of the edge at least, and the first is no later than the second and the edge.

    Ways are many more than edges and are never rows of a table: the agents of a scope are dealt into blocks, so that two
    blocks' links are at most about ``LEGS`` a side, and a block of sources meets a block of destinations in one group. It
    follows ``WAYS`` ways at a time, via by via, and leaves an edge alone once it is explained.
    """
    ship(edges.sparkSession)
    parts = edges.groupBy("scope").count().unionByName(onward.groupBy("scope").count()).groupBy("scope").agg(F.ceil(F.max("count") / LEGS).cast("int").alias("n"))
    at = lambda c: F.pmod(F.xxhash64(c), F.col("n")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    # A row a scope, sent to every task: joined by scope, all links of a scope would meet in one task.
    row = lambda df, kind, a, b, end, other: df.join(F.broadcast(parts), "scope").select("scope", a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"), F.col(end).alias("one"), F.col(other).alias("other"), "score", "t")
    rows = row(edges, 0, at("src"), at("dst"), "src", "dst").unionByName(row(into, 1, at("src"), every, "src", "via")).unionByName(row(onward.where("via != dst"), 2, every, at("dst"), "dst", "via"))

    def meet(group: pa.Table) -> pa.Table:
        kind = group.column("kind").to_numpy()
        names, code = ranks(group.column("one"), group.column("other"))
        one, other = code[: len(kind)], code[len(kind) :]
        score, t = group.column("score").to_numpy(), group.column("t").to_numpy()
        e, legs, ends = (np.flatnonzero(kind == k) for k in range(3))
        via = first_ways((one[e], other[e], score[e], t[e]), (one[legs], other[legs], score[legs], t[legs]), (one[ends], other[ends], score[ends], t[ends]), len(names))
        hit = np.flatnonzero(via >= 0)
        return pa.table({"scope": group.column("scope").take(pa.array(e[hit])), "src": names.take(pa.array(one[e[hit]])), "dst": names.take(pa.array(other[e[hit]])), name: names.take(pa.array(via[hit]))})

    return rows.groupBy("scope", "a", "b").applyInArrow(meet, f"scope {rows.schema['scope'].dataType.simpleString()}, src string, dst string, {name} string")


def ranks(*columns: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The different names in order, and each value's place among them, column after column."""
    coded = pa.chunked_array([c for x in columns for c in x.chunks], pa.string()).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)


def first_ways(edges: tuple[np.ndarray, ...], into: tuple[np.ndarray, ...], onward: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    """For each edge the smallest number of an agent between its ends, or -1; all are (end, other, score, t) in numbers."""
    (src, dst, score, t), found = edges, np.full(len(edges[0]), -1)
    by_via = np.argsort(into[1], kind="stable")
    a, via, sa, ta = (x[by_via] for x in into)
    by_via = np.argsort(onward[1], kind="stable")
    b, other, sb, tb = (x[by_via] for x in onward)
    low, count = np.searchsorted(other, via, "left"), np.searchsorted(other, via, "right") - np.searchsorted(other, via, "left")
    # Places of the edges by their ends: a table of the block's own ends.
    (rows, src_at), (cols, dst_at) = np.unique(src, return_inverse=True), np.unique(dst, return_inverse=True)
    row_of, col_of = np.full(n, -1), np.full(n, -1)
    row_of[rows], col_of[cols] = np.arange(len(rows)), np.arange(len(cols))
    key, wide = src_at * len(cols) + dst_at, len(cols)
    small = len(rows) * len(cols) <= TABLE
    if small:
        table = np.full(len(rows) * len(cols), -1, np.int32)
        table[key] = np.arange(len(key))
    else:
        order = np.argsort(key)
        sorted_key = key[order]
    keep = (count > 0) & (row_of[a] >= 0)
    a, via, sa, ta, low, count = (x[keep] for x in (a, via, sa, ta, low, count))
    col_b, need, ends = col_of[b], 0.9 * score, np.cumsum(count)
    x = 0
    while x < len(a):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + WAYS, "right")))
        leg = np.repeat(np.arange(x, y), count[x:y])
        way = np.arange(len(leg)) - np.repeat(ends[x:y] - count[x:y] - (ends[x - 1] if x else 0), count[x:y]) + low[leg]
        good = (ta[leg] <= tb[way]) & (col_b[way] >= 0)
        leg, way = leg[good], way[good]
        k = row_of[a[leg]] * wide + col_b[way]
        if small:
            at = table[k]
        else:
            spot = np.minimum(np.searchsorted(sorted_key, k), len(order) - 1)
            at = np.where(sorted_key[spot] == k, order[spot], -1)
            at[found[at] >= 0] = -1
        good = np.flatnonzero(at >= 0)
        at, leg, way = at[good], leg[good], way[good]
        good = (np.minimum(sa[leg], sb[way]) >= need[at]) & (ta[leg] <= t[at])
        at, leg = at[good][::-1], leg[good][::-1]
        found[at] = via[leg]  # backwards: the smallest stands
        if small:
            table[key[at]] = -1
        x = y
    return found


#: What any time and any score are below.
ALWAYS, ANY = (1 << 62), float("inf")


def indirect(edges: DataFrame) -> DataFrame:
    """(scope, src, dst, via): the first agent through whom a shortcut without direct addressing is explained."""
    e = edges.where("direct <= 0").select(*KEY, "score", F.lit(ALWAYS).alias("t"))
    ab = edges.select("scope", "src", F.col("dst").alias("via"), "score", F.unix_micros("first_ts").alias("t"))
    bc = edges.select("scope", F.col("src").alias("via"), "dst", "score", F.unix_micros("last_ts").alias("t"))
    return first_between(e, ab, bc, "via")


def siblings(edges: DataFrame) -> DataFrame:
    """(scope, src, dst, upstream): the first agent who reached both ends of an edge before it."""
    e = edges.where("direct <= 0").select(*KEY, "score", F.unix_micros("first_ts").alias("t"))
    strong = edges.where("direct > 0 or resource > 0")
    xs = strong.select("scope", F.col("dst").alias("src"), F.col("src").alias("via"), F.lit(ANY).alias("score"), F.unix_micros("first_ts").alias("t"))
    xd = strong.select("scope", F.col("src").alias("via"), "dst", "score", F.lit(ALWAYS).alias("t"))
    return first_between(e, xs, xd, "upstream")


def mark_indirect(edges: DataFrame) -> DataFrame:
    """Edges with structural alternatives: an indirect path, else a shared upstream; either lowers the confidence."""
    both = edges.join(indirect(edges), KEY, "left").join(siblings(edges), KEY, "left")
    c = F.col
    note = F.when(c("via").isNotNull(), F.concat(F.lit("possibly indirect: by way of "), F.concat_ws("→", "src", "via", "dst")))
    note = note.when(c("upstream").isNotNull(), F.concat(F.lit("shared upstream: "), "upstream", F.lit(" leads to "), "src", F.lit(" and "), "dst"))
    out = both.withColumn("alternatives", F.when(note.isNotNull(), F.concat("alternatives", F.array(note))).otherwise(c("alternatives")))
    return out.withColumn("confidence", F.when(note.isNotNull(), downgrade(c("confidence"))).otherwise(c("confidence"))).drop("via", "upstream")


def collapse_agent_edges(pairs: DataFrame, cfg: PairConfig | None = None) -> DataFrame:
    """Edges of all scopes, structural alternatives included.

    The edges are stored before they meet each other: six reads of a small table, not six runs of the pair scoring.
    """
    return mark_indirect(stored(collapse(pairs, cfg), "edges"))


def edges_frame(edges: DataFrame) -> DataFrame:
    """The flat form: best score first."""
    return edges.select(
        *KEY, "score", "confidence", "support", *[F.col(c).alias(f"c_{c}") for c in COMPONENTS],
        F.array_join(F.slice("shared_resources", 1, 3), ", ").alias("shared_resources"), F.array_join("alternatives", " | ").alias("alternatives"), "explanation",
    ).orderBy(F.desc("score"), "src", "dst")
