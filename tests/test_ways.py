"""Ways between the ends of edges, block by block, against every way one by one."""

import numpy as np
import pytest

from tidemark.operators import edges as E


def graph(seed, n=14, links=90):
    r = np.random.default_rng(seed)
    ends = sorted({(int(a), int(b)) for a, b in r.integers(0, n, (links, 2)) if a != b})
    return [(f"a{u}", f"a{v}", float(r.integers(1, 9)) / 10, float(r.integers(0, 2)), float(r.integers(0, 2)), int(r.integers(0, 50)), int(r.integers(20, 90))) for u, v in ends]


def wanted(rows):
    at, via, up = {(r[0], r[1]): r for r in rows}, {}, {}
    for (u, v), e in at.items():
        if e[3] > 0:
            continue
        for w in sorted({x for k in at for x in k}):
            a, b = at.get((u, w)), at.get((w, v))
            if a and b and w != v and a[5] <= b[6] and min(a[2], b[2]) >= 0.9 * e[2]:
                via.setdefault((u, v), w)
            a = at.get((w, u))
            if a and b and w != v and max(a[3:5]) > 0 and max(b[3:5]) > 0 and a[5] <= e[5] and b[2] >= 0.9 * e[2]:
                up.setdefault((u, v), w)
    return via, up


@pytest.mark.parametrize("legs", [500_000, 20])
def test_blocks(spark, monkeypatch, legs):
    monkeypatch.setattr(E, "LEGS", legs)
    scopes = {"x": graph(1), "y": graph(2, 9, 40)}
    df = spark.createDataFrame([(s, *r) for s, rows in scopes.items() for r in rows], "scope string, src string, dst string, score double, direct double, resource double, f long, l long")
    df = df.selectExpr("scope", "src", "dst", "score", "direct", "resource", "timestamp_seconds(f) as first_ts", "timestamp_seconds(l) as last_ts")
    via, up = E.indirect(df), E.siblings(df)
    assert "Join" not in via._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    for s, rows in scopes.items():
        want = wanted(rows)
        assert want[0] and want[1]
        assert {(r.src, r.dst): r.via for r in via.where(f"scope = '{s}'").collect()} == want[0]
        assert {(r.src, r.dst): r.upstream for r in up.where(f"scope = '{s}'").collect()} == want[1]


@pytest.mark.parametrize("table", [16_000_000, 0])
def test_few_ways_at_a_time(monkeypatch, table):
    r = np.random.default_rng(5)
    ends = np.array(sorted({(a, b) for a, b in r.integers(0, 30, (400, 2)).tolist() if a != b}))
    side = lambda: (ends[:, 0], ends[:, 1], r.integers(1, 9, len(ends)) / 10, r.integers(0, 50, len(ends)))
    e, into, onward = side(), side(), side()
    onward = (onward[1], onward[0], *onward[2:])
    whole = E.first_ways(e, into, onward, 30)
    monkeypatch.setattr(E, "WAYS", 7)
    monkeypatch.setattr(E, "TABLE", table)
    assert (E.first_ways(e, into, onward, 30) == whole).all() and (whole >= 0).any() and (whole < 0).any()
