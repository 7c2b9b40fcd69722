"""The whole analysis on a log with known truth, its report, and the operators on words and shapes against plain Python."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import synthetic
from pyspark.sql import functions as F
from test_library import frame

from tidemark.functions.text import stop_words
from tidemark.operators import labels, shape
from tidemark.plans import analysis
from tidemark.plans.shared import stored
from tidemark.sources import tables


@pytest.fixture(scope="module")
def result(spark):
    ev, truth = synthetic.benchmark(spark)
    return analysis.run_pipeline(ev, context={"dataset": "synthetic"}), truth


def test_truth_is_recovered(result):
    m = analysis.evaluate(*result)
    assert m["control_rank"] == 1 and m["confounder_handled"] and m["episode_jaccard"] >= 0.7, m
    assert not m["includes_separate_group"] and m["edge_recall_any"] == 1.0 and m["primary_precision"] >= 0.8, m


def test_report(result, tmp_path):
    js, md = analysis.write_report(result[0], str(tmp_path))
    report, text = json.loads(js.read_text()), md.read_text()
    first = report["episodes"][0]
    assert first["controls"] and "removes" in first["controls"][0]["headline"] and len(first["edges"]) <= 6
    best = first["controls"][0]
    assert f"({best['n_paths_removed']} of {best['n_paths_before']})" in best["headline"] and best["paths_removed_pct"] == round(100 * best["paths_removed"], 1)
    assert 0 < len(best["examples"]) <= 5 and all(len(x["path"]) == len(x["evidence"]) > 0 for x in best["examples"])
    assert all(d["does_not_prove"] and len(d["evidence"]) <= 6 for d in first["detectors"]) and len(first["detectors"]) == 4
    assert all(len(e["evidence"]) <= 4 for e in first["edges"]) and first["label"] != "no words in common"
    assert "Not shown" in text and analysis.NOTES[0] in text and first["sentence"] in text
    assert first["shape"]["shape"] in ("chain", "board", "conversation", "cluster") and first["shape"]["verdict"] in ("solid", "mixed", "thin")


def test_equal_seeds_equal_logs(spark):
    rows = lambda seed: synthetic.benchmark(spark, seed)[0].orderBy("rn").select("event_id", "timestamp", "content").collect()
    assert rows(3) == rows(3) != rows(4)


def test_arrival_and_use(result):
    r = result[0]
    order = defaultdict(list)
    for x in shape.arrival_order(r.found["members"], r.detections).orderBy("episode_id", "place").collect():
        order[x.episode_id].append(x)
    for own in order.values():
        keys = [(not x.on_chain, x.arrival) for x in own]
        assert keys == sorted(keys) and len({x.actor_id for x in own}) == len(own)
    assert shape.who_used_what(r.found["members"]).where("resource like '%harvest%'").count() >= 4


def words(text):
    return [w for w in re.findall(r"\b\w\w+\b", (text or "").lower()) if w not in stop_words()]


TEXTS = ["the river rises, the river falls", "boats on the river and a bridge", None, "   ", "and the of", "bridge bridge bridge toll", "Ünïcode bridge 42 x"]


def test_tfidf(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = defaultdict(dict)
    for r in labels.tfidf(df).collect():
        got[r.id][r.term] = r.weight
    df_ = Counter(w for t in TEXTS for w in set(words(t)))
    for i, t in enumerate(TEXTS):
        raw = {w: (1 + math.log(n)) * (math.log((1 + len(TEXTS)) / (1 + df_[w])) + 1) for w, n in Counter(words(t)).items()}
        length = math.sqrt(sum(v * v for v in raw.values()))
        assert got[i].keys() == raw.keys() and all(math.isclose(got[i][w], v / length) for w, v in raw.items())
    assert len({r.term for r in labels.tfidf(df, 2).collect()}) == 2 and labels.tfidf(df.where("false")).count() == 0
    dense = {r.id: r.emb for r in labels.encode(df).collect()}
    assert len(dense) == len(TEXTS) and dense[2] == [0.0] * len(dense[2]) and math.isclose(sum(x * x for x in dense[0]), 1)
    cos = lambda a, b: sum(x * y for x, y in zip(dense[a], dense[b]))
    assert cos(1, 5) > cos(0, 5)
    assert {tuple(r.emb) for r in labels.encode(df.where("id in (2, 3)")).collect()} == {(0.0,)}


def test_vectors_of_length_one(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(labels.normalised(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def test_group_labels(spark):
    rng = random.Random(4)
    common = "orchard gate ladder".split()
    groups = {f"g{k}": " ".join(rng.choice(common + [f"plum{'abcdef'[k]}", f"pear{'abcdef'[k]} tree"]) for _ in range(60)) for k in range(5)} | {"none": "of the and 12"}
    got = {r.episode_id: list(r.terms) for r in labels.group_labels(spark.createDataFrame(list(groups.items()), "episode_id string, text string")).collect()}
    assert got["none"] == [] and set(got) == set(groups)
    for k in range(5):
        terms = got[f"g{k}"]
        assert 0 < len(terms) <= 4 and any("abcdef"[k] in t for t in terms) and not any(a != b and a in b for a in terms for b in terms)
        assert not any(t in common for t in terms)  # in five of six groups: over 80 %


def plain_terms(a, b, common=(), limit=10):
    token = re.compile(labels.TOKEN)
    ta, other = token.findall(a or ""), {t.lower().rstrip("/") for t in token.findall(b or "")}
    out_of = {*stop_words(), *common}
    tells = lambda t: "://" in t or (t.lower() not in out_of and len(t) >= (2 if re.search("[0-9]", t) else 4))
    pairs = [f"{x} {y}" for x, y in zip(ta, ta[1:]) if f"{x} {y}".lower() in (a or "").lower() and f"{x} {y}".lower() in (b or "").lower() and tells(x) and tells(y)]
    out = []
    for t in [*sorted(pairs, key=lambda p: -len(p)), *[t for t in ta if t.lower().rstrip("/") in other and tells(t)]]:
        if len(out) < limit and not any(t.lower() in o.lower() for o in out):
            out.append(t)
    return out


def test_shared_terms_and_snippets(spark):
    a = "See https://pad.example.net/x/ for the Harvest tables of Plot 7b, the ladder and ladder stand near gate"
    b = "the harvest tables (plot 7b) moved to https://pad.example.net/x, take a ladder"
    cases = [(a, b), (b, a), (None, a), ("", ""), (a, a), ("7b 7b 7b", "7b"), ("same words again", "again same words")]
    df = spark.createDataFrame(cases, "a string, b string")
    common = F.array(F.lit("ladder"))
    got = df.select(labels.shared_terms(F.col("a"), F.col("b"), common).alias("t"), labels.snippet(F.col("b"), F.array(F.lit("LADDER")), 30).alias("s")).collect()
    assert [list(r.t) for r in got] == [plain_terms(x, y, ("ladder",)) for x, y in cases]
    flat, at = b, b.index("ladder")
    start = max(0, min(at - 10, len(flat) - 30))
    assert got[0].s == "…" + flat[start : start + 30] and got[2].s.startswith("…") and got[3].s == ""


def test_common_words(spark):
    ev = frame(spark, [(str(k), k, "Old Mill@x" if k else "B", "shared word " + ("rare" if k == 3 else "other"), {}) for k in range(100)])
    got = {r.word for r in labels.common_words(ev).collect()}
    assert {"shared", "word", "other", "old", "mill", "x", "b"} == got


def test_lags_and_days(spark):
    rows = [("w1", 0, "A", "", {"action": "edit", "target": "p"}), ("w2", 60, "A", "", {"action": "create", "target": "q"}), ("d1", 60 * 30, "h", "", {"action": "delete", "target": "p", "kind": "human"}), ("d2", 60 * 60 * 24, "h", "", {"action": "delete", "target": "q", "kind": "human"}), ("d3", 5, "h", "", {"action": "delete", "target": "r"})]
    ev = frame(spark, rows)
    got = {r.lag_days: (r.n, r.median_hours) for r in shape.deletion_lags(ev).collect()}
    middle = (30 + (60 * 60 * 24 - 60) / 60) / 2
    assert got == {1: (1, middle), 30: (1, middle)}
    days = sorted(((r.writes, r.deletions) for r in shape.daily_writes(ev).collect()))
    assert sum(w for w, _ in days) == 2 and sum(d for _, d in days) == 3


def test_quality_measures(spark):
    found, truth = spark.createDataFrame([("a", "b"), ("a", "b"), ("x", "y")], "src string, dst string"), spark.createDataFrame([("a", "b"), ("c", "d")], "src string, dst string")
    assert tuple(analysis.edge_quality(found, truth).first()) == (0.5, 0.5) and tuple(analysis.edge_quality(found.where("false"), truth).first()) == (0.0, 0.0)
    m = spark.createDataFrame([("E", "1"), ("E", "2"), ("F", "9")], "episode_id string, event_id string")
    assert {tuple(r) for r in analysis.event_set_jaccard(m, spark.createDataFrame([("2",), ("3",)], "event_id string")).collect()} == {("E", 1 / 3), ("F", 0.0)}


def test_schema_profile_and_vector_cache(spark, tmp_path):
    rows = [{"a": 1, "b": {"c": "x", "d": [1, 2]}}, {"a": None, "b": {"c": "y"}}, {"b": None, "e": True}]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    got = {(r.path, r.type): r.n for r in tables.profile_json(spark, f"file://{path}").collect()}
    assert got == {("a", "int"): 1, ("a", "null"): 1, ("b", "object"): 2, ("b", "null"): 1, ("b.c", "string"): 2, ("b.d", "array"): 1, ("b.d[]", "int"): 2, ("e", "bool"): 1}
    cache = f"file://{tmp_path}/cache"
    texts = spark.createDataFrame([("one",), ("two",), ("two",), (None,)], "text string")
    make = lambda df: df.select("key", F.array(F.length("text").cast("float"), F.lit(0.5).cast("float")).alias("emb"))
    first = tables.cached_vectors(texts, cache, make)
    assert {(r.text, tuple(r.emb)) for r in first.collect()} == {("one", (3.0, 0.5)), ("two", (3.0, 0.5))}
    again = tables.cached_vectors(texts.unionByName(spark.createDataFrame([("three",)], "text string")), cache, lambda df: make(stored(df, "wanted").where("text = 'three'")))
    assert again.count() == 3 and spark.read.parquet(cache).count() == 3


def test_profile_of_paths_in_one_scan(spark, tmp_path):
    """Presence, types and values of every path; ids and long texts are no categories."""
    rng = random.Random(3)
    rows = [{"id": k, "kind": rng.choice("abc"), "b": {"on": k % 3 == 0, "note": "x" * (30 + k % 30)}, "tags": ["t"] * (k % 3), "n": [1, 2.5, None][k % 3]} | ({"rare": 1} if k < 5 else {}) for k in range(200)]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    got = {r.path: r for r in tables.profile_paths(spark, f"file://{path}", most=2).collect()}
    assert got["id"].n == 200 and got["id"].types == {"int": 200} and got["id"].top is None
    assert got["n"].types == {"int": 67, "float": 67, "null": 66} and got["rare"].top is None and got["b.note"].top is None
    kinds = Counter(r["kind"] for r in rows)
    assert [(x.value, x.n) for x in got["kind"].top] == sorted(kinds.items(), key=lambda x: (-x[1], x[0]))[:2]
    assert [(x.value, x.n) for x in got["b.on"].top] == [("false", 133), ("true", 67)]
    assert got["tags"].types == {"array": 200} and got["tags[]"].n == sum(k % 3 for k in range(200)) and got["b"].types == {"object": 200}


def test_runs_at_once_add_to_a_cache(spark, tmp_path):
    """Two runs find the same texts missing; both add them, and each text has one vector, that of the last."""
    cache = f"file://{tmp_path}/cache"
    texts = spark.createDataFrame([("one",), ("two",)], "text string")
    vector = lambda df, x: df.select("key", F.array(F.lit(x).cast("float")).alias("emb"))

    def slow(df):
        inner = tables.cached_vectors(texts, cache, lambda d: vector(d, 1.0))  # another run ends meanwhile
        assert {(r.text, r.emb[0]) for r in inner.collect()} == {("one", 1.0), ("two", 1.0)}
        return vector(stored(df, "wanted"), 2.0)

    got = tables.cached_vectors(texts, cache, slow)
    assert {(r.text, r.emb[0]) for r in got.collect()} == {("one", 2.0), ("two", 2.0)} and got.count() == 2
    turns = spark.createDataFrame([("s1", 1, "a"), ("s1", 2, "b")], "session_id string, created_at long, text string")
    wanted = turns.select("session_id")
    own = f"file://{tmp_path}/turns"
    tables.add_batch(turns, own, "session_id")
    tables.add_batch(turns.where("created_at = 2"), own, "session_id")
    assert [r.text for r in tables.cached_turns(turns, wanted, own).collect()] == ["b"]
    assert not [x for x in (tmp_path / "turns").iterdir() if x.name.startswith("_adding")]


def test_subspace_of_the_encoder(spark, monkeypatch):
    """The projection is that onto numpy's first right singular vectors."""
    rng = random.Random(9)
    topics = [[f"{t}{k}" for k in range(8)] for t in ("oak", "bay", "fir", "elm", "ash", "yew")]
    texts = [(k, " ".join(rng.choice(topics[k % 6]) if rng.random() < 0.9 else rng.choice(topics[rng.randrange(6)]) for _ in range(40))) for k in range(120)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(5)
    weights = labels.tfidf(df).collect()
    terms = sorted({r.term for r in weights})
    a = np.zeros((120, len(terms)))
    for r in weights:
        a[r.id, terms.index(r.term)] = r.weight
    _, s, v = np.linalg.svd(a)
    assert s[5] > 1.5 * s[6]
    got = {r.id: np.array(r.emb) for r in labels.encode(df, size=6).collect()}
    want = a @ v[:6].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    assert all(len(e) == 6 for e in got.values())
    for i in range(0, 120, 7):
        for j in range(120):
            assert abs(got[i] @ got[j] - want[i] @ want[j]) < 1e-6


def test_unknown_controls_are_refused(spark):
    from tidemark.operators import intervene

    bad = spark.createDataFrame([("*", "wishful_thinking", "x", 1)], "scope string, kind string, target string, cand_ord int")
    with pytest.raises(ValueError, match="wishful_thinking"):
        intervene.checked(bad)
    assert intervene.checked(bad.withColumn("kind", F.lit("limit_tool"))).count() == 1


def test_sessions_drill_down(spark, tmp_path):
    turns = spark.createDataFrame([("s1", 2, "b"), ("s1", 1, "a"), ("s2", 3, "c"), ("s3", 4, "d")], "session_id string, created_at long, text string")
    wanted = lambda *s: spark.createDataFrame([(x,) for x in s], "session_id string")
    cache = f"file://{tmp_path}/turns"
    assert [r.text for r in tables.cached_turns(turns, wanted("s1"), cache).collect()] == ["a", "b"]
    assert [r.text for r in tables.cached_turns(turns.where("session_id != 's1'"), wanted("s1", "s2", "s9"), cache).collect()] == ["a", "b", "c"]


def test_first_rows_of_a_window(spark):
    df = spark.createDataFrame([(k, k) for k in range(100)], "id long, ts long")
    assert tables.first_rows(df, F.col("ts") >= 90, 3).count() == 9 and tables.first_rows(df, F.col("ts") >= 98, 3).count() == 2


def test_streaming_windows_and_state(spark, tmp_path):
    from tidemark.streaming import windows

    ev = frame(spark, [(f"e{k}", m, who, "x", {"resources": ["d"], "action": act}) for k, (m, who, act) in enumerate([(0, "A", "edit"), (5, "A", "edit"), (10, "B", "visit"), (20, "B", "edit"), (70, "A", "visit"), (75, "C", "edit"), (300, "C", "edit")])])
    path = f"file://{tmp_path}/events"
    ev.select("event_id", "timestamp", "actor_id", "action_type", "source", "res").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    def run(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    slid = {r.start.minute + 60 * r.start.hour: (r.n_events, r.n_agents) for r in run(windows.sliding_activity(stream, "1 hour", "30 minutes"), "slid")}
    first = min(slid)
    assert slid[first + 30] == (4, 2) and slid[first] == (4, 2)
    assert {tuple(r)[1:] for r in run(windows.last_writers(stream), "writers")} == {("A", "B", "e1", "e2"), ("A", "B", "e1", "e3"), ("B", "A", "e3", "e4"), ("B", "C", "e3", "e5"), ("B", "C", "e3", "e6")}
