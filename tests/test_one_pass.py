"""Arrivals in one pass over the pairs, a bit a source: as they are followed way by way."""

import numpy as np
import pytest

from tidemark import queries as library
from tidemark.operators import reach


def some_pairs(spark, seed=3):
    r, rows = np.random.default_rng(seed), []
    for scope, n in (("x", 12), ("y", 7)):
        for k in range(300):
            u, v = r.integers(0, n, 2)
            s = int(r.integers(0, 40)) * 30
            if u != v:
                rows.append((scope, f"a{u}", f"a{v}", s, s + int(r.integers(0, 3)) * 30, f"s{k}", f"d{k}"))
    df = spark.createDataFrame(rows, "scope string, src_agent string, dst_agent string, s long, d long, src_event string, dst_event string")
    return df.selectExpr("scope", "src_agent", "dst_agent", "timestamp_seconds(s) as src_ts", "timestamp_seconds(d) as dst_ts", "src_event", "dst_event")


@pytest.mark.parametrize("bits, sources, told", [(8192, 128, 2048), (3, 1, 4)])
def test_as_way_by_way(spark, monkeypatch, bits, sources, told):
    for name, value in (("BITS", bits), ("SOURCES", sources), ("TOLD", told)):
        monkeypatch.setattr(reach, name, value)
    df = some_pairs(spark)
    want = {(r.scope, r.source, r.node, r.arrival) for r in reach.earliest_arrival(df).collect()}
    got = [tuple(r) for r in reach.arrivals(df).collect()]
    assert len(got) == len(want) and set(got) == want and want
    counts = {(r.scope, r.source): r.reach for r in reach.reach_counts(df).collect()}
    assert counts == {k: sum(w[:2] == k for w in want) for k in {w[:2] for w in want}}
    assert [tuple(r) for r in reach.rooted(df, reach.reach_counts(df)).orderBy("scope").collect()] == [tuple(r) for r in reach.roots(df, reach.earliest_arrival(df)).orderBy("scope").collect()]


@pytest.mark.parametrize("name", ["earliest_arrival", "reachable_pairs"])
def test_arrivals_are_never_moved(spark, sf_dir, name):
    plan = library.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    after = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Join" not in after and "Aggregate" not in after and "Repartition" not in after
