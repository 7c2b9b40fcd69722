"""Operators that work in blocks, against brute force, with blocks so small that every border is crossed."""

import math
import random
from collections import defaultdict
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_library import T0, hand_pairs
from test_whole import plain_groups

from tidemark import queries as library
from tidemark.operators import components, edges, episodes, pairs, reach
from tidemark.plans.frame import PairConfig


def vector_frame(spark, n=160, seed=1, actors=6, gap=(0, 4)):
    """Events with vectors of two lengths, some missing, many equal; some without text."""
    rng = random.Random(seed)
    minute, rows = 0, []
    for k in range(n):
        minute += rng.randint(*gap)
        v = [round(rng.choice([-1, 1]) * rng.random(), 1) for _ in range(2)]
        size = math.hypot(*v) or 1.0
        emb = None if k % 17 == 0 else [1.0, 0.0, 0.0] if k % 11 == 0 else [x / size for x in v]
        rows.append((f"{k:04d}", minute, f"a{rng.randrange(actors)}", "human" if k % 13 == 0 else "agent", "" if k % 9 == 0 else f"text {k}", emb))
    raw = [(i, T0 + timedelta(minutes=m), a, t, c, e, k, int((T0 + timedelta(minutes=m)).timestamp() * 1_000_000)) for k, (i, m, a, t, c, e) in enumerate(rows)]
    return spark.createDataFrame(raw, "event_id string, timestamp timestamp, actor_id string, actor_type string, content string, emb array<double>, rn long, us long")


def cosine(a, b):
    return None if a is None or b is None or len(a) != len(b) else float(np.dot(a, b))


@pytest.mark.parametrize("tile,span,reach_rows", [(1, 1, 7), (3, 5, 25), (256, 4096, 1500)])
def test_nearest_vectors(spark, monkeypatch, tile, span, reach_rows):
    monkeypatch.setattr(pairs, "TILE", tile)
    monkeypatch.setattr(pairs, "SPAN", span)
    cfg = PairConfig(window_minutes=40, max_window_events=reach_rows, semantic_top_k=2, semantic_floor=0.3)
    ev = vector_frame(spark).withColumn("has_text", F.col("content") != "")
    rows, want = sorted(ev.collect(), key=lambda r: r.rn), set()
    for j in rows:
        if not j.has_text or j.actor_type != "agent":
            continue
        sims = [(-round(c, 9), i.rn, c, i.actor_id) for i in rows if j.rn - reach_rows <= i.rn < j.rn and j.us - i.us <= cfg.window_us and (c := cosine(i.emb, j.emb)) is not None]
        good = [(x[1], j.rn) for x in sorted(sims)[:6] if x[2] >= 0.3 and x[3] != j.actor_id][:2]
        want.update(good)
    got = [(r.i, r.j) for r in pairs.semantic_pairs(ev, cfg).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    assert pairs.semantic_pairs(ev.where("false"), cfg).count() == 0


@pytest.mark.parametrize("block,most", [(4, 3), (9, 1000), (1024, 16)])
def test_common_causes_searched_backwards(spark, monkeypatch, block, most):
    monkeypatch.setattr(pairs, "CAUSE_ROWS", block)
    monkeypatch.setattr(pairs, "CAUSE_PAIRS", most)
    monkeypatch.setattr(pairs, "TILE", 2)
    cfg = PairConfig(window_minutes=60, common_cause_sim=0.9)
    ev = vector_frame(spark, n=120, seed=3, gap=(0, 2))
    rows, rng = sorted(ev.collect(), key=lambda r: r.rn), random.Random(4)
    asked = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(150)})
    frame_ = spark.createDataFrame([(i, j, rows[i].actor_id, rows[j].actor_id, 0.0 if k % 10 == 0 else 0.5) for k, (i, j) in enumerate(asked)], "i long, j long, src_agent string, dst_agent string, semantic double")
    want = {}
    for k, (i, j) in enumerate(asked):
        near = [r for r in rows[:i] if rows[i].us - r.us <= cfg.window_us and r.content and r.actor_id not in (rows[i].actor_id, rows[j].actor_id) and all((cosine(r.emb, rows[x].emb) or -9) >= 0.9 for x in (i, j))]
        want[i, j] = ([], []) if k % 10 == 0 or len(rows[i].emb or []) != len(rows[j].emb or []) else ([r.event_id for r in near[-3:]], [r.actor_id for r in near[-3:]])
    got = {(r.i, r.j): (r.common_cause, r.common_cause_actors) for r in pairs.common_causes(frame_, ev, cfg).collect()}
    assert got == want and sum(len(x[0]) == 3 for x in want.values()) > 3 and sum(0 < len(x[0]) < 3 for x in want.values()) > 3
    assert pairs.common_causes(frame_.where("false"), ev, cfg).count() == 0


@pytest.mark.parametrize("part", [1, 7, 65_536])
def test_segments_over_ranges_of_rows(spark, monkeypatch, part):
    monkeypatch.setattr(episodes, "SEGMENT_ROWS", part)
    rng, minute, at, want = random.Random(2), 0, [], []
    for k in range(90):
        step = rng.choice([0, 1, 5, 46, 45, 3000])
        minute += step if k else 0
        at.append(minute)
        want.append((want[-1] if want else 0) + (k > 0 and step > 45))
    ev = spark.createDataFrame([(f"{k:03d}", k, m * 60_000_000) for k, m in enumerate(at)], "event_id string, rn long, us long")
    assert [r.segment for r in sorted(episodes.segments(ev, 45).collect(), key=lambda r: r.rn)] == want


@pytest.mark.parametrize("piece", [1, 60_000_000, 10**15])
def test_suffix_minima_of_one_busy_edge(spark, monkeypatch, piece):
    """Four fifths of the pairs on one edge; many equal begins and arrivals."""
    monkeypatch.setattr(reach, "SUFFIX_US", piece)
    rng = random.Random(6)
    rows = [("A", "B", s := rng.randrange(40), s + rng.randrange(25), None) for _ in range(200)] + [(rng.choice("CDE"), rng.choice("FG"), s := rng.randrange(40), s + rng.randrange(9), None) for _ in range(50)]
    df = hand_pairs(spark, rows)
    by_edge, want = defaultdict(list), []
    for r in df.collect():
        by_edge[r.src_agent, r.dst_agent].append((r.src_ts, r.src_event, r.dst_event, r.dst_ts))
    for (u, v), own in by_edge.items():
        own.sort(key=lambda x: x[:3])
        for k, x in enumerate(own):
            least = min(y[3] for y in own[k:])
            last = max(n for n, y in enumerate(own) if n >= k and y[3] == least)
            want.append((u, v, x[0], least, own[last][1], own[last][2]))
    got = reach.suffix_minimum(df).withColumns({"s": F.timestamp_micros("s"), "d": F.timestamp_micros("d")})
    assert sorted((r.u, r.v, r.s, r.d, r.src_event, r.dst_event) for r in got.collect()) == sorted(want)


def plain_arrivals(rows):
    """Label-setting over all pairs, arrivals only."""
    found = {}
    for source in {r[0] for r in rows}:
        best, changed = {source: -1}, True
        while changed:
            changed = False
            for u, v, s, d in rows:
                if u in best and s >= best[u] and d < best.get(v, 10**9):
                    best[v], changed = d, True
        found |= {(source, v): d for v, d in best.items() if v != source}
    return found


def test_arrivals_of_random_graphs_and_their_trees(spark):
    rng = random.Random(12)
    rows = list({(*rng.sample("ABCDEFGHIJ", 2), s := rng.randrange(30), s + rng.choice([0, 0, 1, 4])) for _ in range(70)})
    df = hand_pairs(spark, [(*r, None) for r in rows])
    arrivals = reach.earliest_arrival(df)
    got = {(r.source, r.node): r for r in arrivals.withColumn("at", F.timestamp_micros("arrival")).collect()}
    want = plain_arrivals(rows)
    assert {k: r["at"] for k, r in got.items()} == {k: (T0 + timedelta(minutes=d)).replace(tzinfo=None) for k, d in want.items()}
    for (source, node), r in got.items():  # every tree leads back to its source
        steps = 0
        while node != source:
            node, steps = got[source, node].pred, steps + 1
            assert steps <= 10
    few = spark.createDataFrame([("*", "A"), ("*", "C")], "scope string, source string")
    assert {(r.source, r.node) for r in reach.earliest_arrival(df, few).collect()} == {k for k in want if k[0] in "AC"}


def test_sources_followed_again_reach_what_all_would(spark):
    """Controls that take pairs, take none, and bring a new one."""
    rng = random.Random(13)
    rows = [(*rng.sample("ABCDEFGH", 2), s := rng.randrange(40), s + rng.choice([0, 1, 5]), None) for _ in range(60)]
    before = hand_pairs(spark, rows).cache()
    taken = [before.where(F.pmod(F.xxhash64("src_event", "dst_event"), F.lit(5)) != k).withColumn("scope", F.lit(f"c{k}")) for k in range(4)]
    extra = hand_pairs(spark, [("H", "A", 0, 1, None), ("B", "H", 0, 0, None)]).withColumns({"scope": F.lit("c4"), "src_event": F.concat(F.lit("new"), "src_event")})
    after = extra.unionByName(before.withColumn("scope", F.lit("c4"))).unionByName(before.withColumn("scope", F.lit("c5")))
    for t in taken:
        after = after.unionByName(t)
    named = spark.createDataFrame([("*", f"c{k}") for k in range(6)], "scope string, name string")
    got = {tuple(r) for r in reach.still_reached(reach.earliest_arrival(before), before, after, named).collect()}
    assert got == {tuple(r) for r in reach.reachable_pairs(after).collect()}


def test_forest_connects_what_the_pairs_connect(spark):
    rng = random.Random(14)
    links = [(a, b, round(rng.random(), 1)) for a, b in (rng.sample(range(60), 2) for _ in range(140))] + [(1, 1, 0.9), (None, 2, 0.9), (3, 4, None)]
    df = spark.createDataFrame(links, "i long, j long, score double")
    forest = components.spanning_forest(df)
    rows = forest.collect()

    def parts(edges_):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges_:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {x: find(x) for x in list(root)}

    fine = [(a, b, w) for a, b, w in links if None not in (a, b, w) and a != b]
    for k in range(11):
        assert parts([(a, b) for a, b, w in fine if w >= k / 10]) == parts([(r.i, r.j) for r in rows if r.score >= k / 10])
    own = parts([(a, b) for a, b, _ in fine])
    assert len(rows) == len(own) - len(set(own.values()))
    assert components.spanning_forest(df.where("false")).count() == 0


def test_limits_fire_in_a_query(spark, sf_dir):
    """Components of the table are split and cut in a registered query, as brute force does it."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    cfg = library.SPLIT
    ev = library.events(spark, sf_dir)
    rows = sorted(ev.select("rn", "actor_id", "us").collect(), key=lambda r: r.rn)
    segment = {r.rn: r.segment for r in episodes.segments(ev, cfg.gap_minutes).collect()}
    scored = [(r.i, r.j, r.score) for r in pairs.score_pairs(ev, library.PLAIN).collect() if segment[r.i] == segment[r.j]]
    actor, us = [r.actor_id for r in rows], [r.us for r in rows]
    large, want = plain_groups(len(rows), actor, us, scored, cfg)
    whole, _ = plain_groups(len(rows), actor, us, scored, library.EPISODES)
    assert len(large) > len(whole) and any(len({actor[x] for x in p}) > cfg.max_agents for p in whole) and any(max(us[x] for x in p) - min(us[x] for x in p) > cfg.max_hours * 3.6e9 for p in large)
    got = {r.component: (r.n_events, r.n_agents, r.span_us) for r in library.QUERIES["episode_groups_split"](spark, sf_dir).collect()}
    assert got == {min(g): (len(g), len({actor[x] for x in g}), max(us[x] for x in g) - min(us[x] for x in g)) for g in want}


def test_edges_of_one_busy_edge(spark):
    """Means, evidence and supports of an edge with most of the pairs."""
    rng = random.Random(15)
    rows = [("A", "B", s := rng.randrange(100), s + rng.randrange(9), None) for _ in range(120)] + [("B", "C", 1, 2, None)]
    df = hand_pairs(spark, rows).withColumn("score", F.round(F.lit(0.5) + F.pmod(F.xxhash64("src_event", "dst_event"), F.lit(40)) / 100, 4))
    found = {(r.src, r.dst): r for r in edges.collapse(df).collect()}
    own = sorted((r for r in df.collect() if r.src_agent == "A"), key=lambda r: (-r.score, r.j, r.i))
    busy = found["A", "B"]
    assert busy.support == 120 and [tuple(e) for e in busy.evidence_pairs] == [(r.src_event, r.dst_event) for r in own[:25]]
    assert busy.score == pytest.approx(sum(r.score for r in own[:3]) / 3, abs=6e-5)
    assert busy.first_ts == min(r.src_ts for r in own) and busy.last_ts == max(r.dst_ts for r in own)
