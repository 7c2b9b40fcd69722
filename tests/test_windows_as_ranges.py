"""All pairs of a window come from ranges of row numbers, without a join; the same as brute force, ties and ends included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import pairs
from tidemark.plans.frame import PairConfig


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(5)
    us = np.sort(np.concatenate([r.integers(0, 600, 90), r.integers(2000, 2060, 110), r.integers(5000, 5003, 60)])) * 60_000_000 - 40_000_000_000
    rows = [(k, int(t), ("agent", "human", "tool")[int(r.integers(0, 3))]) for k, t in enumerate(us)]
    return rows, spark.createDataFrame(rows, "rn long, us long, actor_type string").repartition(7)


@pytest.mark.parametrize(("minutes", "most"), [(120, 1500), (20, 13), (1, 40), (0, 40), (100_000, 7), (100_000, 1500), (20, 1)])
def test_against_brute_force(frame, minutes, most):
    rows, df = frame
    cfg = PairConfig(window_minutes=minutes, max_window_events=most, actor_types=("agent", "tool"))
    found = pairs.band_pairs(df, cfg)
    want = sorted((i, j) for j, t, kind in rows if kind != "human" for i in range(max(0, j - most), j) if t - rows[i][1] <= cfg.window_us)
    assert sorted(tuple(x) for x in found.collect()) == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_gaps_are_refused(frame):
    _, df = frame
    with pytest.raises(Exception, match="without gaps"):
        pairs.band_pairs(df.where(F.col("rn") % 10 != 3), PairConfig(max_window_events=40)).collect()


def test_empty(frame):
    _, df = frame
    assert pairs.band_pairs(df.limit(0), PairConfig()).collect() == []
    assert pairs.band_pairs(df.where("rn = 0"), PairConfig()).collect() == []
