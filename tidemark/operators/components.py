"""Connected components by alternating large-star and small-star steps, each a pair of aggregate and join.

Every vertex ends up pointing at the smallest vertex of its component. A step never gathers a vertex's neighbours in
one task: minima are aggregated on the map side first and stored, so that the join back is one of two plain shuffles
(or a broadcast), which adaptive execution can split where a vertex is hot; a join that shared its shuffle with the
aggregate could not be split. Each round is written to the shared folder, so that lineage stays short and
a lost executor costs one round at most; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import delete, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", vertex: str = "vertex", component: str = "component") -> DataFrame:
    """Return (vertex, component) for each vertex that ``edges`` mention; the component is its smallest vertex.

    Edges are undirected and may repeat; self-loops make components of one; an edge with a null end is left out.
    An empty table gives an empty result.
    """
    spark = edges.sparkSession
    own = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    own = stored(own, "edges")
    state = own.where("u != v")
    seen, path = None, None
    while True:
        both = state.select("u", "v").unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")
        made = [low.scratch_path]
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stored(large, "large-star")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        made += [large.scratch_path, low.scratch_path]
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # A vertex above several lower ones keeps its own link to the smallest of them.
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = stored(small, "small-star")
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for done in made + [path] * bool(path):
            delete(spark, done)
        state, path = small, small.scratch_path
        if now == seen:
            break
        seen = now
    pointed = state.select(F.col("u").alias(vertex), F.col("v").alias(component))
    roots = state.select(F.col("v").alias(vertex), F.col("v").alias(component)).unionByName(own.where("u = v").select(F.col("u").alias(vertex), F.col("v").alias(component)))
    return pointed.unionByName(roots).groupBy(vertex).agg(F.min(component).alias(component))


def spanning_forest(edges: DataFrame, a: str = "i", b: str = "j", weight: str = "score") -> DataFrame:
    """Stored (a, b, weight): a maximum spanning forest, by Borůvka's rounds.

    In every round each part takes its heaviest edge to another (of equal ones that of the smallest ends), parts that are
    linked so become one, and edges within a part, or below another between the same two, are dropped. Parts at least
    halve in number, so rounds grow with the logarithm of the vertices. Whatever a threshold leaves of the edges, it
    connects the same vertices as what it leaves of the forest. Edges may repeat; one with a null end, without a weight
    or from a vertex to itself is left out.
    """
    spark = edges.sparkSession
    fine = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(weight).isNotNull()).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.col(weight).alias("w")).where("x != y")
    order = F.struct(-F.col("w"), "x", "y")  # the smallest is the heaviest
    left = stored(fine.groupBy("x", "y").agg(F.max("w").alias("w")).select(F.col("x").alias("p"), F.col("y").alias("q"), "x", "y", "w"), "forest-edges")
    chosen = []
    while not left.isEmpty():
        best = F.min_by(F.struct("p", "q", "x", "y", "w"), order).alias("e")
        ends = left.select("*", F.explode(F.array("p", "q")).alias("part"))
        taken = stored(ends.groupBy("part").agg(best).select("e.*").distinct(), "forest-taken")
        chosen.append(taken)
        merged = stored(connected_components(taken, "p", "q", "part", "whole"), "forest-parts")
        whole = lambda c: merged.select(F.col("part").alias(c), F.col("whole").alias(f"{c}_whole"))  # noqa: B023, E731
        moved = left.join(whole("p"), "p", "left").join(whole("q"), "q", "left")
        moved = moved.select(F.coalesce("p_whole", "p").alias("p"), F.coalesce("q_whole", "q").alias("q"), "x", "y", "w").where("p != q")
        moved = moved.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min_by(F.struct("x", "y", "w"), order).alias("e")).select("p", "q", "e.*")
        nxt = stored(moved, "forest-edges")
        for done in (left, merged):
            delete(spark, done.scratch_path)
        left = nxt
    every = left.select("x", "y", "w")
    for taken in chosen:
        every = every.unionByName(taken.select("x", "y", "w"))
    return stored(every.select(F.col("x").alias(a), F.col("y").alias(b), F.col("w").alias(weight)), "forest")
