"""Induced sorting and suffix deduplication against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import induced_sort, suffix_dedup

SCHEMA = "doc_id long, text string, n_bytes string, begins string, anchor string"


def common(t, a, b, depth):
    k = 0
    while k < depth and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
        k += 1
    return k


@pytest.mark.parametrize("small", [0, 2, 1 << 20])
@pytest.mark.parametrize("held", [1, 4, 1 << 20])
def test_induced_order_and_prefixes(tmp_path, monkeypatch, small, held):
    rng = random.Random(small + held)
    for trial in range(60):
        monkeypatch.setattr(induced_sort, "FAN", rng.choice([2, 3, 256]))
        monkeypatch.setattr(induced_sort, "BATCH", rng.choice([1, 3, 2048]))
        t = bytes(rng.randrange(97, 97 + rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 80)))
        if rng.random() < 0.4:
            t = (t * 5)[: rng.randint(1, 200)]
        depth = rng.choice([3, 6, 10, 300])
        got = list(induced_sort.induced(np.frombuffer(t, np.uint8), depth, induced_sort.Store(str(tmp_path), held), small))
        p = np.concatenate([g[0] for g in got]).tolist()[::-1]
        assert sorted(p) == list(range(len(t)))
        assert [t[i : i + depth] for i in p] == sorted(t[i : i + depth] for i in p)
        assert np.concatenate([g[1] for g in got]).tolist() == [0] + [common(t, a, b, depth) for a, b in zip(p, p[1:])][::-1]


def plain_removal(texts, length):
    seen = Counter()
    for t in texts:
        seen.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def compare(df, length, gram, **bounds):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    want = Counter((i, *x) for (i, _), x in zip(rows, plain_removal([t for _, t in rows], length)))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=length, gram=gram, **bounds).collect())
    assert got == want
    return got


def test_random_repeats(spark):
    rng = random.Random(7)
    for length, gram in ((12, 5), (10, 10), (16, 1)):
        passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(8, 40))) for _ in range(6)]
        texts = []
        for _ in range(120):
            parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
            texts.append("".join(parts))
        texts += ["a" * 300, "ab" * 90, "", None, texts[3], texts[3] + "x", "=" * 11, "=" * 12, "=" * 13]
        df = spark.createDataFrame([(i if i % 50 else None, t, "x", "y", "z") for i, t in enumerate(texts)] + [(7, texts[7], "x", "y", "z")], SCHEMA)
        compare(df, length, gram)
        compare(df, length, gram, shard_bytes=2000, hot_bytes=150)


def test_a_hot_anchor_is_split(spark):
    """One passage, shorter or longer than a window, in a third of the texts: blocks of places, then single windows."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for size in (30, 47, 60):
        passage = word(size)
        texts = [word(rng.randint(0, 60)) + passage + word(rng.randint(0, 60)) if i % 3 == 0 else word(80) for i in range(240)]
        texts += [passage[:40] + "x", "y" + passage, "x" * 5 + passage + "x" * 5, "x" * 5 + passage + "x" * 5]
        df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)
        for hot_bytes in (1, 600, 1 << 30):
            compare(df, 48, 20, hot_bytes=hot_bytes)


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = compare(df, 400, 128)
    assert sum(r[2] for r in got) > 0
    assert suffix_dedup.remove_repeats(df.where("false")).count() == 0


def test_kept_text_has_whole_characters(spark):
    t = "é" * 30
    df = spark.createDataFrame([(1, "a" + t + "b"), (2, "ñ" + t + "ò"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in suffix_dedup.remove_repeats(df, length=13, gram=6, text=True).collect()}
    assert got == {1: "ab", 2: "ñò", 3: "x"}


def test_blocks_don_t_change_pieces(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.randrange(97, 100) for _ in range(5000))
    by_window = lambda p: [x for c in p for n, a, times in c[[1, 3, 6]].T.tolist() for x in [a] * n * times]
    whole = by_window(suffix_dedup.pieces(data, 40, 9))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    assert whole == by_window(suffix_dedup.pieces(data, 40, 9)) and len(whole) == 5000 - 39


def test_texts_that_repeat_themselves_take_bounded_memory(monkeypatch):
    """Equal pieces that follow each other are one row, and memory depends on the block, not on the text."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 16)
    for unit in (b"a", b"abcdefg"):
        peaks = []
        for size in (1 << 18, 1 << 20):
            data = unit * (size // len(unit))
            tracemalloc.start()
            found = [(c.shape[1], int((c[1] * c[6]).sum())) for c in suffix_dedup.pieces(data)]
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            assert sum(n for _, n in found) == len(data) - 399 and max(n for n, _ in found) < 100
        assert peaks[1] < 25e6 and peaks[1] < 1.2 * peaks[0], (unit, peaks)


def test_repetitive_texts_are_cut_exactly(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = ["a" * 900, "abcdefg" * 70 + noise(30), noise(20) + "abcdefg" * 30 + noise(9) + "abcdefg" * 9, noise(50) + "xy" * 8, "xyz" * 6, noise(100) * 2, "b" * 21, "a" * 19 + noise(5)]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)
    for length, gram in ((20, 8), (20, 20), (24, 3)):
        compare(df, length, gram)
        compare(df, length, gram, shard_bytes=500, hot_bytes=60)


def test_texts_meet_their_spans_in_one_way(spark):
    docs = spark.createDataFrame([(k, "one and the same long line " * 3 + str(k)) for k in range(4)], "doc_id long, text string")
    cut = suffix_dedup.remove_repeats(docs, length=20, gram=6)
    assert cut.where("n_removed > 0").count() == 4
    assert "BroadcastHashJoin" not in cut._jdf.queryExecution().executedPlan().toString()


def test_hot_anchors_read_no_text_again(spark):
    """Texts are read for their pieces and once for the bytes of cuts, whatever number of anchors is split, and blocks after that."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passages = [word(40), word(60)]
    texts = [word(rng.randint(0, 60)) + passages[i % 2] + word(rng.randint(0, 60)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(7, texts[7], "x", "y", "z")] * 5, SCHEMA)
    read, found = spark.sparkContext.accumulator(0), {}

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    for hot_bytes in (1 << 30, 3000, 1):
        before = read.value
        spans = suffix_dedup.repeated_spans(suffix_dedup.keyed(docs.mapInArrow(counted, docs.schema), ("doc_id",), "doc_id", "text"), 48, 20, hot_bytes=hot_bytes)
        rows = {r.k1: [x.tolist() if hasattr(x, "tolist") else x for x in suffix_dedup.merge_spans(*np.array(r.spans).T)] for r in spans.collect()}
        found[hot_bytes] = (read.value - before, rows)
    assert found[1] == found[3000] == found[1 << 30]
    assert found[1][0] == 2 * 65 and found[1][1]


def test_only_what_shares_a_deeper_anchor_is_sorted_and_one_anchor_at_a_time(monkeypatch):
    """Pieces that have no more than the anchor in common aren't sorted; a shard's anchors don't make one long text."""
    rng = random.Random(13)
    word = lambda n: bytes(rng.choice(b"abcdefghij ") for _ in range(n))
    passages = [word(n) for n in (30, 30, 60, 60, 90, 90)]
    texts = [word(rng.randint(20, 90)) + p + word(rng.randint(20, 90)) for p in passages for _ in range(20)]
    length, names = 48, [*suffix_dedup.PIECE, "copies", "first", "windows", "lead", "data"]
    found = [(a, p1, p2, 0, n, lead, t[s : s + n + length - 1]) for t in texts for c in suffix_dedup.pieces(t, length, 20) for s, n, lead, a, p1, p2, _ in c.T.tolist()]
    anchors, copies = Counter(x[0] for x in found), Counter(x[:3] for x in found)
    rows = [(*x[:3], copies[x[:3]], *x[3:]) for x in dict.fromkeys(found) if anchors[x[0]] > 1]
    batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:-1]), pa.array([x[-1] for x in rows], pa.binary())], names)

    class Frame:
        def select(self, *columns):
            assert set(columns) <= set(names)
            return self

        def mapInArrow(self, run, schema):
            return run

    sort, sorted_ = induced_sort.repeated, []
    monkeypatch.setattr(induced_sort, "repeated", lambda text, *rest: sorted_.append(len(text)) or sort(text, *rest))
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 2000, raising=False)
    got = {}
    for b in suffix_dedup.sort_shards(Frame(), length)(iter([batch.slice(0, 50), batch.slice(50)])):
        for x in b.to_pylist():
            got[x["anchor"], x["p1"], x["p2"]] = [*zip(x["begins"], x["ends"], strict=True)]
    windows = Counter(x[-1][i : i + length] for x in rows for i in range(x[5]))
    want = {x[:3]: [*zip(*(s.tolist() for s in suffix_dedup.covered(np.array(hits), length)), strict=True)] for x in rows if x[3] == 1 and (hits := [i for i in range(x[5]) if windows[x[-1][i : i + length]] > 1])}
    assert got == want and want
    assert sum(sorted_) < 0.7 * sum(len(x[-1]) for x in rows), (sorted_, sum(len(x[-1]) for x in rows))
    assert len(sorted_) > 1 and max(sorted_) < sum(sorted_) / 2
