"""Streams read file by file: late rows go, all else equals the batch; state that timers forget; the command line."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_library import write_lines

import tidemark.__main__ as shell
from tidemark.operators import graph
from tidemark.sources import tables, village
from tidemark.streaming import windows

COLUMNS = "event_id string, timestamp timestamp, actor_id string, action_type string, res array<string>"
MINUTE = 60_000_000
#: Times begin a day after the epoch: a row at the epoch itself is not later than the first watermark, and goes.
FIRST = 24 * 60


def files(spark, folder, parts, schema=COLUMNS, time="timestamp"):
    """One Parquet file a part, the first the oldest; minutes become times."""
    folder.mkdir()
    for k, part in enumerate(parts):
        at = [f.split()[0] for f in schema.split(", ")].index(time)
        df = spark.createDataFrame([(*r[:at], (FIRST + r[at]) * MINUTE, *r[at + 1 :]) for r in part], schema.replace(f"{time} timestamp", f"{time} long"))
        df.withColumn(time, F.timestamp_micros(time)).coalesce(1).write.parquet(f"file://{folder}-{k}")
        (made,) = Path(f"{folder}-{k}").glob("*.parquet")
        os.rename(made, folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    path = f"file://{folder}"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.schema(schema).parquet(path)


def run(spark, df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.table(name).collect())


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_handovers_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    rng = random.Random(3)
    early = [(f"e{k}", rng.randrange(300), f"a{k % 4}", rng.choice(["edit", "visit"]), [f"p{rng.randrange(3)}"]) for k in range(40)]
    later = [(f"f{k}", 700 + rng.randrange(200), f"a{k % 4}", "edit", [f"p{rng.randrange(3)}"]) for k in range(20)]
    late = [("late", 10, "a9", "edit", ["p0"]), ("held", 790, "a9", "edit", ["p0"])]
    stream, batch = files(spark, tmp_path / "in", [early, later, [("n", 900, "a1", "visit", ["q"])], late, [("z", 5000, "a0", "edit", ["q"])]])
    kept = batch.where("event_id <> 'late'")
    got = run(spark, windows.resource_handovers(stream, stream), "handovers")
    assert got == rows(windows.resource_handovers(kept, kept))
    every = early + later + late[1:]
    want = {(r, x[0], y[0]) for x in every for y in every for r in x[4] if r in y[4] and x[3] != "visit" and x[2] != y[2] and x[1] < y[1] <= x[1] + 120}
    assert {g[:3] for g in got} == want and any("held" in g for g in got) and len(got) == len(want)


def test_hourly_pairs_drop_late_rows_only(spark, tmp_path):
    parts = [[(k, 7 * k) for k in range(60)], [(100, 1000)], [(101, 5), (102, 950), (103, 1010)], [(104, 9000)]]
    stream, batch = files(spark, tmp_path / "in", parts, "i int, dst_ts timestamp", "dst_ts")
    want = rows(windows.hourly_pairs(batch.where("i not in (101, 104)")))
    assert run(spark, windows.hourly_pairs(stream), "hourly") == want and sum(n for _, n in want) == 63


def test_last_writers_of_a_stream(spark, tmp_path):
    """State goes on from file to file; what a day has not touched is forgotten, by its timer or ahead of the watermark."""
    day = 24 * 60
    parts = [
        [("e1", 0, "A", "edit", ["d", "x"]), ("e2", 5, "B", "visit", ["d"])],
        [("e4", 20, "C", "edit", ["d"]), ("e3", 10, "B", "edit", ["d"])],
        [("e5", 30, "C", "visit", ["d"]), ("e6", day + 40, "D", "visit", ["d"]), ("e7", day, "D", "visit", ["x"])],
        [("late", 40, "Z", "visit", ["d"]), ("e8", 4 * day, "E", "edit", ["y"])],
        [("e9", 5 * day, "F", "visit", ["y", "x"]), ("g1", 5 * day + 1, "F", "edit", ["d"])],
        [("g2", 5 * day + 2, "A", "edit", ["d"])],
    ]
    stream, _ = files(spark, tmp_path / "in", parts)
    got = run(spark, windows.last_writers(stream), "last_writers")
    assert got == sorted([
        ("d", "A", "B", "e1", "e2"), ("d", "A", "B", "e1", "e3"), ("d", "B", "C", "e3", "e4"), ("d", "B", "C", "e3", "e5"),
        ("x", "A", "D", "e1", "e7"), ("y", "E", "F", "e8", "e9"), ("d", "F", "A", "g1", "g2"),
    ])


def test_shell_lists_days_and_analyses_a_window(spark, tmp_path, capsys, monkeypatch):
    """What reaches the analysis; the analysis and its reports have tests of their own."""
    said = [(1, "2026-07-06 10:00:00"), (2, "2026-07-06 11:00:00"), (3, "2026-07-07 10:00:00")]
    (tmp_path / "v").mkdir()
    write_lines(tmp_path / "v" / "agents.jsonl.gz", [{"id": f"u{k}", "name": f"N{k}"} for k in (1, 2)])
    write_lines(tmp_path / "v" / "chat_messages.jsonl.gz", [{"id": f"c{k}", "created_at": at, "speaker_type": "agent", "agent_speaker_id": f"u{1 + k % 2}", "room_id": "r1", "content": f"rota https://rota.gitlab.io/page @N{2 - k % 2}"} for k, at in said])
    (tmp_path / "v" / "CHANGELOG.md").write_text("## 2026-07-06\nA new  room\n\n## 2026-01-01\nOld\n")
    source = ["village", "--dir", f"file://{tmp_path}/v"]
    assert shell.main([*source, "--list-days"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["2026-07-06  2 messages, 2 with links, 2 speakers", "2026-07-07  1 messages, 1 with links, 1 speakers"]
    args = shell.arguments([*source, "--start", "2026-07-06", "--end", "2026-07-07", "--max-events", "1"])
    ev, known = shell.load(spark, args)
    assert ev.count() == 1 and known["truncated_to_max_events"] and [c["body"] for c in known["nearby_changes"]] == ["A new room"]
    given = []
    monkeypatch.setattr(shell.analysis, "run_pipeline", lambda ev, cfg, known: given.append((sorted(r.event_id for r in ev.select("event_id").collect()), cfg.pairs.window_minutes, known)))
    monkeypatch.setattr(shell.analysis, "write_report", lambda result, out, name: (Path(out) / f"{name}.json",))
    assert shell.main([*source, "--start", "2026-07-06", "--end", "2026-07-07", "--window-minutes", "30", "--out", "o"], spark) == 0
    assert capsys.readouterr().out.split() == ["o/village-2026-07-06-2026-07-07.json"]
    village.load_window(village.read(spark, f"file://{tmp_path}/v"), "2026-07-06", "2026-07-08").write.parquet(f"file://{tmp_path}/t")
    assert shell.main(["table", "--dir", f"file://{tmp_path}/t", "--start", "2026-07-06 10:30", "--max-events", "2"], spark) == 0
    assert [(len(g[0]), g[1]) for g in given] == [(2, 30), (2, 120)] and not given[0][2]["truncated_to_max_events"] and given[1][2] == {"table": f"file://{tmp_path}/t"}


def test_change_log_and_inferred_graph(spark, tmp_path):
    (tmp_path / "log.md").write_text("# Log\nintro\n\n## 2026-07-06 (Mon)\nA new\n\n  room  \n### inner\n## not a day\n## 2026-07-01\n" + "x" * 400 + "\n## 2026-06-30\n")
    got = {str(r.day): r.body for r in tables.changelog(spark, f"file://{tmp_path}/log.md").collect()}
    assert got == {"2026-07-06": "A new room ### inner", "2026-07-01": "x" * 300, "2026-06-30": ""}
    found = spark.createDataFrame([("A", "B", 0.5), ("B", "A", 0.2), ("A", "C", 0.3)], "src string, dst string, score double")
    assert rows(graph.propagation_edges(found, 0.3)) == [("agent:A", f"agent:{b}", f"prop:A->{b}", "candidate_propagation", x) for b, x in (("B", 0.5), ("C", 0.3))]
    assert graph.propagation_edges(found).count() == 3 and graph.propagation_edges(found, 0.9).count() == 0


@pytest.mark.parametrize("argv", [["village", "--dir", "x"], ["wiki", "--dir", "x", "--list-days"], ["wiki"], ["other", "--dir", "x"], ["wiki", "--dir", "x", "--mode", "all"]])
def test_shell_refuses(argv):
    with pytest.raises(SystemExit):
        shell.arguments(argv)
