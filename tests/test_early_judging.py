"""Pairs of shared resources that can't pass are dropped where they arise; what is left is scored as before."""

from pyspark.sql import functions as F

from tidemark import queries as library
from tidemark.operators import pairs


def test_what_cant_pass_is_never_moved(spark, sf_dir, monkeypatch):
    ev = library.events(spark, sf_dir).withColumn("has_text", F.lit(False))
    cfg = library.PLAIN
    weights = pairs.weighted_resources(ev, ev.where(F.col("actor_type").isin(*cfg.actor_types)), cfg)
    moved = pairs.candidates(ev, weights, cfg, False)
    scored = {(r.i, r.j) for r in pairs.score_pairs(ev, cfg).select("i", "j").collect()}
    plain = {(r.i, r.j) for r in moved.where("addressed = 0").collect()}
    assert plain <= scored  # an event has one resource here, so the bound is the score itself
    every = {(r.i, r.j) for r in pairs.resource_pairs(ev, cfg).collect()}
    assert plain < every

    def unjudged(ev, weighted_, cfg, semantic):
        direct = pairs.reply_pairs(ev, cfg).unionByName(pairs.inbox_pairs(ev, cfg)).withColumn("addressed", F.lit(1.0))
        return pairs.resource_pairs(ev, cfg).select("i", "j", F.lit(0.0).alias("addressed")).unionByName(direct).groupBy("i", "j").agg(F.max("addressed").alias("addressed"))

    monkeypatch.setattr(pairs, "candidates", unjudged)
    assert {(r.i, r.j) for r in pairs.score_pairs(ev, cfg).select("i", "j").collect()} == scored
