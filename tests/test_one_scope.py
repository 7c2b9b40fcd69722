"""What would bring all rows of one scope to one task, or move them more than once."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark import queries as library
from tidemark.operators import edges, intervene, pairs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_are_not_joined_by_scope(spark):
    rows = [("*", f"a{k}", f"a{k + 1}", 0.5, 0.0, 1.0, k, k + 1) for k in range(9)] + [("*", "a0", "a2", 0.5, 0.0, 1.0, 0, 9)]
    e = spark.createDataFrame(rows, "scope string, src string, dst string, score double, direct double, resource double, f long, l long")
    e = e.selectExpr("scope", "src", "dst", "score", "direct", "resource", "timestamp_seconds(f) as first_ts", "timestamp_seconds(l) as last_ts")
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of a size
    try:
        assert "SortMergeJoin" not in plan(edges.indirect(e)) and "SortMergeJoin" not in plan(edges.siblings(e))
        assert [tuple(r) for r in edges.indirect(e).select("src", "dst", "via").collect()] == [("a0", "a2", "a1")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_vectors_of_templates_are_not_moved(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [(str(k), t + dt.timedelta(minutes=k), f"a{k}", "agent", "edit", k, 60_000_000 * k, ["resource:r"], "same" if k < 4 else f"own{k}", [1.0, 0.0]) for k in range(7)]
    ev = spark.createDataFrame(rows, "event_id string, timestamp timestamp, actor_id string, actor_type string, action_type string, rn long, us long, res array<string>, text_key string, emb array<float>")
    for name in ("target_id", "target_type", "tool", "reply_to", "origin", "goal_key"):
        ev = ev.withColumn(name, F.lit(None).cast("string"))
    ev = ev.withColumn("mentions", F.array().cast("array<string>"))
    cfg = library.PLAIN
    df = pairs.score_pairs(ev, cfg, semantic=True)
    moved = [x for x in plan(df).splitlines() if "emb AS emb_" in x or "emb#" in x and " AS emb_" in x]
    assert not [x for x in moved if "AS emb_i" in x or "AS emb_j" in x]
    assert {(r.i, r.j) for r in df.where("semantic > 0").collect()} == {(a, b) for a in range(4, 7) for b in range(a + 1, 7)}


def test_common_causes_score_once(spark, sf_dir):
    assert "arrow" not in plan(library.QUERIES["common_cause_templates"](spark, sf_dir)).lower()  # pairs and finds are read back


def test_controls_dont_follow_ways(spark, sf_dir, monkeypatch):
    def refuse(*_):
        raise AssertionError("ways between the ends of edges are followed")

    monkeypatch.setattr(edges, "first_between", refuse)
    for name in ("intervention_candidates", "collateral", "counterfactual_pairs"):
        assert library.QUERIES[name](spark, sf_dir).count()


def test_sources_are_joined_before_candidates(spark):
    c = spark.createDataFrame([("*", "limit_tool", f"a{k}|t", k) for k in range(3)], "scope string, kind string, target string, cand_ord int")
    p = spark.createDataFrame([("*", f"a{k}", "b", f"e{k}", f"f{k}", 1.0, 0.0, ["resource:r"]) for k in range(3)], "scope string, src_agent string, dst_agent string, src_event string, dst_event string, resource double, direct double, shared_resources array<string>")
    ev = spark.createDataFrame([(f"e{k}", "edit", "t") for k in range(3)], "event_id string, action_type string, tool string")
    df = intervene.edited_pairs(c, p, ev)
    joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert "Inner" in joins[0] and "LeftOuter" in joins[1]  # the outermost first
    assert sorted((r.target, r.src_agent) for r in df.collect()) == [(f"a{k}|t", f"a{x}") for k in range(3) for x in range(3) if x != k]
