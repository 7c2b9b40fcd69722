"""Streaming forms: session windows of activity and resource hand-overs within a time range.

The batch operators define the semantics; these keep bounded state under a watermark and drop later data. Distinct actors
are counted from a set kept in the window's state, so the numbers are the batch's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_sessions(events: DataFrame, key: str = "source", gap: str = "45 minutes", late: str = "2 hours") -> DataFrame:
    """(key, start, end, n_events, n_agents): activity of each key separated by gaps longer than ``gap``.

    A key is required: streams have no session windows without one.
    """
    w = F.session_window("timestamp", gap)
    sessions = events.withWatermark("timestamp", late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.size(F.collect_set("actor_id")).alias("n_agents"))
    return sessions.select(key, "w.start", "w.end", "n_events", "n_agents")


def hourly_pairs(pairs: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, n): pairs an hour, the stream behind the burst baseline."""
    counted = pairs.withWatermark("dst_ts", late).groupBy(F.window("dst_ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("hour"), "n")


def resource_handovers(events: DataFrame, other: DataFrame, window: str = "120 minutes", late: str = "2 hours") -> DataFrame:
    """(resource, src_event, dst_event): a later event on a resource that another actor wrote to within ``window``.

    A stream-stream interval join; ``other`` is the same stream read a second time.
    """
    a = events.withWatermark("timestamp", late).where("action_type not in ('memory_read', 'visit')").select(F.explode("res").alias("resource"), F.col("event_id").alias("src_event"), F.col("actor_id").alias("src_agent"), F.col("timestamp").alias("src_ts"))
    b = other.withWatermark("timestamp", late).select(F.explode("res").alias("resource_b"), F.col("event_id").alias("dst_event"), F.col("actor_id").alias("dst_agent"), F.col("timestamp").alias("dst_ts"))
    on = (F.col("resource") == F.col("resource_b")) & (F.col("dst_ts") > F.col("src_ts")) & (F.col("dst_ts") <= F.col("src_ts") + F.expr(f"interval {window}")) & (F.col("src_agent") != F.col("dst_agent"))
    return a.join(b, on).select("resource", "src_event", "dst_event", "src_agent", "dst_agent", "src_ts", "dst_ts")


def sliding_activity(events: DataFrame, length: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """(start, end, n_events, n_agents) of overlapping windows."""
    w = F.window("timestamp", length, step).alias("w")
    counted = events.withWatermark("timestamp", late).groupBy(w).agg(F.count(F.lit(1)).alias("n_events"), F.size(F.collect_set("actor_id")).alias("n_agents"))
    return counted.select("w.start", "w.end", "n_events", "n_agents")


def last_writers(events: DataFrame, idle: str = "24 hours", late: str = "2 hours") -> DataFrame:
    """(resource, src_agent, dst_agent, src_event, dst_event): each touch with the last write by somebody else before it.

    State is the newest write of the two newest writers of a resource. A resource is forgotten after ``idle`` of event
    time without a touch: by a timer, and before a later touch that comes ahead of the watermark. Rows of a batch are
    taken in the order of time, then id; a row later than the watermark is dropped. The session needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``).
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    hold = int(pd.Timedelta(idle).total_seconds() * 1000)
    columns = ["resource", "src_agent", "dst_agent", "src_event", "dst_event"]

    class LastWriters(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.kept = handle.getValueState("kept", "a string, ae string, b string, be string, touched long")

        def handleInputRows(self, key, rows, timer_values):
            flat, before = (tuple(self.kept.get()), True) if self.kept.exists() else ((None,) * 5, False)
            writers, touched, out = [(flat[k], flat[k + 1]) for k in (0, 2) if flat[k] is not None], flat[4], []
            for r in pd.concat(list(rows)).sort_values(["timestamp", "event_id"]).itertuples():
                if touched is not None and r.ms - touched > hold:
                    writers = []
                touched = r.ms if touched is None else max(touched, r.ms)
                other = next((w for w in writers if w[0] != r.actor_id), None)
                if other:
                    out.append((key[0], other[0], r.actor_id, other[1], r.event_id))
                if r.writes:
                    # The two newest writers are enough: of two different ones, one isn't the next row's actor.
                    writers = [(r.actor_id, r.event_id), *[w for w in writers if w[0] != r.actor_id]][:2]
            if before and flat[4] != touched:
                self.handle.deleteTimer(int(flat[4]) + hold)
            self.kept.update((*[x for w in [*writers, (None, None), (None, None)][:2] for x in w], int(touched)))
            self.handle.registerTimer(int(touched) + hold)
            yield pd.DataFrame(out, columns=columns)

        def handleExpiredTimer(self, key, timer_values, expired):
            self.kept.clear()
            yield pd.DataFrame([], columns=columns)

        def close(self):
            pass

    touch = events.withWatermark("timestamp", late).select("timestamp", F.unix_millis("timestamp").alias("ms"), "event_id", "actor_id", (~F.col("action_type").isin("memory_read", "visit")).alias("writes"), F.explode("res").alias("resource"))
    return touch.groupBy("resource").transformWithStateInPandas(LastWriters(), ", ".join(f"{c} string" for c in columns), "append", "EventTime")
