"""Queries that must cover their whole input, against brute force."""

import random
from collections import Counter, defaultdict
from datetime import timedelta

from test_library import T0, frame, hand_pairs

from tidemark import queries as library
from tidemark.operators import episodes, reach


def test_graph_components(spark, tmp_path):
    rows = [(k, k % 25) for k in range(1, 1201)]
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int").write.parquet(f"{path}/customer.parquet")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, n in rows:
        a, b = sorted((find(k), find(7 * k + n)))
        root[b] = a
    got = library.QUERIES["graph_components"](spark, path).collect()
    assert {r.vertex: r.component for r in got} == {x: find(x) for x in list(root)} and len(got) == len(root) > 1200


def test_interventions_are_scored_for_each_episode(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has no episodes
    got = library.QUERIES["intervention_scores"](spark, sf_dir).collect()
    ev, _, found = library.found_episodes(spark, sf_dir)
    total = Counter(r.actor_id for r in ev.select("actor_id").collect())
    inside = Counter((r.episode_id, r.actor_id) for r in found["members"].select("episode_id", "actor_id").collect())
    edges = {r.scope for r in found["edges"].select("scope").distinct().collect()}
    assert {r.scope for r in got} == edges and len(edges) > 1
    for r in got:
        if r.kind == "quarantine_agent":
            assert r.collateral_events == total[r.target] - inside[r.scope, r.target]


def dense_table(spark, path):
    """150 edits, two minutes apart, of five resources: five components of nearly five hours, with repeated texts."""
    rows = [(k, T0 + timedelta(minutes=2 * k), k % 59 + 1, "purchase", f'{{"k": {(k % 59) % 5}}}') for k in range(150)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{path}/events.parquet")
    texts = [(k, "the same text" if k % 2 else f"text {k}") for k in range(150)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    vectors = [(k, [1.0, k / 100]) for k in range(50)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")


def test_limits_and_templates_hold_in_queries(spark, tmp_path):
    path = f"file://{tmp_path}"
    dense_table(spark, path)
    assert max(r.span_us for r in library.QUERIES["episode_groups"](spark, path).collect()) > 4 * 3_600_000_000
    assert 0 < max(r.span_us for r in library.QUERIES["episode_groups_limited"](spark, path).collect()) <= 4 * 3_600_000_000
    assert 0 < max(r.duration_hours for r in library.QUERIES["ranked_episodes"](spark, path).collect()) <= 4
    later = [r.j for r in library.QUERIES["semantic_topk_templates"](spark, path).collect()]
    assert later and all(j % 2 == 0 for j in later)


def plain_groups(n, actor, us, pairs, cfg):
    """The reference's components, re-split while too many actors, then cut at the largest gap; no segments."""

    def parts(members, threshold):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for i, j, score in pairs:
            if score >= threshold and i in members and j in members:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        out = defaultdict(set)
        for x in list(root):
            out[find(x)].add(x)
        return list(out.values())

    def resplit(members, threshold):
        if len({actor[x] for x in members}) <= cfg.max_agents or threshold >= 0.85:
            return [members]
        return [q for p in parts(members, threshold) for q in resplit(p, threshold + 0.05)]

    def split_long(members):
        m = sorted(members)
        if us[m[-1]] - us[m[0]] <= cfg.max_hours * 3_600_000_000 or len(m) < 4:
            return [m]
        gaps = [us[b] - us[a] for a, b in zip(m, m[1:])]
        cut = gaps.index(max(gaps)) + 1
        return split_long(m[:cut]) + split_long(m[cut:])

    large = [q for p in parts(set(range(n)), cfg.strong_pair_score) for q in resplit(p, cfg.strong_pair_score + 0.05)]
    found = [g for p in large for g in split_long(p)]
    return large, {tuple(g) for g in found if len({actor[x] for x in g}) >= cfg.min_agents and len(g) >= cfg.min_events}


def test_limited_members_equal_brute_force(spark):
    rng, n, cfg = random.Random(5), 240, library.LIMITED
    minutes = [0]
    for _ in range(n - 1):
        minutes.append(minutes[-1] + rng.randint(1, 5))
    actor = [f"a{rng.randrange(70)}" for _ in range(n)]
    scored = [(i, j, round(rng.uniform(0.1, 0.6), 4)) for j in range(1, n) for i in sorted({rng.randrange(max(0, j - 12), j) for _ in range(2)})]
    us = [int(T0.timestamp() * 1e6) + m * 60_000_000 for m in minutes]
    large, want = plain_groups(n, actor, us, scored, cfg)
    assert (cfg.max_agents, cfg.max_hours) == (40, 4) and len(large) > 1 and len(want) > 1
    ev = frame(spark, [(f"{k:03d}", m, a, "x", {}) for k, (m, a) in enumerate(zip(minutes, actor))])
    got = defaultdict(list)
    for r in episodes.episode_members(ev, spark.createDataFrame(scored, "i long, j long, score double"), cfg).collect():
        got[r.component].append(r.rn)
    assert {tuple(sorted(g)) for g in got.values()} == want


def test_paths_of_any_length(spark):
    n = 71
    names = [f"n{k:02d}" for k in range(n + 1)]
    schema = "scope string, source string, node string, arrival long, pred string, src_event string, dst_event string"
    rows = [("*", names[0], names[k], k, names[k - 1], f"s{k}", f"d{k}") for k in range(1, n + 1)]
    got = {r.node: [(h["from"], h["to"], h.src_event) for h in r.hops] for r in reach.paths(spark.createDataFrame(rows, schema)).collect()}
    assert got == {names[k]: [(names[x - 1], names[x], f"s{x}") for x in range(1, k + 1)] for k in range(1, n + 1)}


def test_instant_hops_make_no_circle(spark):
    rows = [("X", "Z", 0, 5, None), ("Z", "B", 5, 5, None), ("Z", "C", 5, 5, None), ("B", "C", 5, 5, None), ("C", "B", 5, 5, None)]
    got = {(r.source, r.node): [h["from"] for h in r.hops] for r in reach.paths(reach.earliest_arrival(hand_pairs(spark, rows))).collect()}
    assert got[("X", "B")] == got[("X", "C")] == ["X", "Z"] and got[("B", "C")] == ["B"]
