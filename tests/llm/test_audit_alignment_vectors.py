"""Filter audit, token alignment and vector near-duplicates against brute force, on odd rows and planted ones."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import base, filter_audit, token_alignment, vector_dedup

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Filter audit


def plain_audit(docs, labels):
    """Every order, filter by filter, over the documents themselves."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    texts = [(i, t or "", lang or "") for i, t, lang in docs]
    least = defaultdict(lambda: float("inf"))
    for i, t, _ in texts:
        if i is not None:
            least[t] = min(least[t], i)
    rows = []
    for i, t, lang in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        rows.append((lang, {c for c, x in fails.items() if x}, i in good, i in toxic))
    out, totals = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left, gone = [r for r in rows if r[0] == part], []
            for step, c in enumerate(order, 1):
                removed = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                redundant = sum(c in r[1] for r in gone)
                gone += removed
                unique = sum(r[1] == {c} for r in rows if r[0] == part)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, unique, sum(r[2] for r in removed), sum(r[3] for r in removed)]
                totals[part, c] += len(removed)
    return {(p, o, s): (*x, totals[p, o[s - 1]]) for (p, o, s), x in out.items()}


LONG = " ".join(f"w{k}" for k in range(250))
AUDITED = [
    (5, "same text", "en"), (3, "same text", "en"), (3, "same text", "de"), (9, "same text", None), (None, "same text", "en"), (None, "same text", "en"), (4, None, "en"), (6, "", "en"), (2, None, None),
    (7, LONG, "en"), (8, LONG + " #", "en"), (1, "ABC " * 250, "en"), (10, LONG.upper(), "fr"), (11, "a b " * 300, "fr"), (12, "\x1c\xa0 é" * 100, "fr"), (12, "\x1c\xa0 é" * 100, "fr"), (13, "x y " * 100 + "z" * 1_000_000, "fr"),
    (14, " \t\n\x0b\f\r", "x"), (15, "A", "x"), (16, "ABC" + "d" * 97, "x"), (17, "ABC" + "d" * 96, "x"), (18, LONG + " " + LONG, "x"), (19, LONG + " " + LONG + " a", "x"),
]
LABELS = [(3, 1, 0), (3, 1, 1), (5, 1, None), (7, None, 1), (8, 1, 1), (None, 1, 1), (12, 1, 1), (99, 1, 1), (11, 0, 0), (11, 1, 0)]


def test_audit_equals_every_order_by_hand(spark):
    docs = spark.createDataFrame([(*r, "k", 1) for r in AUDITED], "doc_id long, text string, lang string, mask string, part int")
    labels = spark.createDataFrame([(*r, "t") for r in LABELS], "doc_id long, quality int, toxic int, text string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    assert got == plain_audit(AUDITED, LABELS)
    assert len(got) == 600 * 5 and all(type(x) is int for r in got.values() for x in r)


def test_audit_of_real_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    want = plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()} == want


def test_audit_of_nothing_and_without_labels(spark):
    docs = spark.createDataFrame(AUDITED, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.where("false"), labels).collect() == []
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()} == plain_audit(AUDITED, [])


def test_matrices():
    made = filter_audit.outcomes()
    assert {m.shape for m in made.values()} == {(32, 600)} and len(set(filter_audit.orders())) == 600
    assert (made["kept"] + made["removed"] + made["redundant"] <= 1).all()
    last = [k for k, (_, s) in enumerate(filter_audit.orders()) if s == 5]
    assert made["kept"][0].all() and not made["kept"][1:, last].any()


# Token alignment


def plain_alignment(docs):
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    own = token_alignment.aligner(A, B)
    a_bytes, b_bytes = own.a_table.to_pylist(), own.b_table.to_pylist()
    made, held = [], Counter()
    for i, t in docs:
        a, b = (a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)) if t else ([], [])
        if not t or {b"".join(a_bytes[x] for x in a), b"".join(b_bytes[x] for x in b)} != {(" " + t).encode()}:
            made.append((i, [], [], None))
            continue
        ends = set(itertools.accumulate(len(a_bytes[x]) for x in a)) & set(itertools.accumulate(len(b_bytes[x]) for x in b))
        groups = []
        for tokens, table, side in ((a, a_bytes, 0), (b, b_bytes, 1)):
            at, k = 0, 0
            for x in tokens:
                if k == len(groups):
                    groups.append(([], []))
                groups[k][side].append(x)
                at += len(table[x])
                k += at in ends
        links = [(p, q) for g, h in groups for p in g for q in h]
        held.update(set(links))
        made.append((i, groups, links, (len(a), len(b), len(groups), len(links))))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for i, groups, links, sizes in made:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((i, *(sizes or (0, 0, 0, 0)), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if sizes else ""))
    return sorted(out, key=repr)


ALIGNED = [
    (1, None), (2, ""), (3, " "), (4, "  x"), (5, "a▁b"), (6, "a\nb\n\nc"), (7, "\n x"), (8, "x " * 5), (9, "<|endoftext|> a <s> </s>"), (10, "é漢 字　x\x00y﻿"), (11, "x" * 5000), (12, "tab\there  two"),
    (13, "▁"), (14, " lead"), (14, " lead"), (None, "no id"), (15, "\r\n q\x0bz"), (16, "the end. " * 3000), (17, "😀" * 40 + " a"), (18, "é ﬁ"), (19, "internationalisation of tokenisers " * 2), (20, "0123456789" * 2000),
]


def alignments(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_alignment_of_odd_texts(spark):
    rng = random.Random(5)
    noise = [(100 + k, "".join(rng.choice("ab \n\t.é漢1▁X  😀" if k % 3 == 0 else "ab \n\t.é漢1X  😀") for _ in range(rng.randint(1, 60)))) for k in range(400)]
    rows = ALIGNED + noise
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, pairs string").repartition(5)
    assert alignments(token_alignment.align(docs, A, B)) == plain_alignment(rows)
    assert alignments(token_alignment.align(docs.where("false"), A, B)) == []


def test_alignment_of_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert alignments(token_alignment.align(docs, A, B)) == plain_alignment([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_without_cuts_and_with_small_written_groups(monkeypatch):
    """Texts aligned whole, and groups counted by distinct ids, give the same blocks."""
    texts = [t for _, t in ALIGNED if t] + ["aaaa" * 50]
    own = token_alignment.Aligner(A, B)
    want = token_alignment._block(own, base.pa.array(range(len(texts))), base.pa.array(texts), 7)
    monkeypatch.setattr(token_alignment, "WRITTEN", 1)
    assert token_alignment._block(own, base.pa.array(range(len(texts))), base.pa.array(texts), 7).equals(want)
    own.cuts, own.fast = False, None
    assert token_alignment._block(own, base.pa.array(range(len(texts))), base.pa.array(texts), 7).equals(want)


def test_components_are_those_of_a_plain_union_find():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 3000):
        x, y = rng.integers(0, n, n // 2), rng.integers(0, n, n // 2)
        root = list(range(n))
        find = lambda v: v if root[v] == v else find(root[v])
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            a, b = sorted((find(a), find(b)))
            root[b] = a
        assert token_alignment.components(x, y, n).tolist() == [find(v) for v in range(n)]
    chain = np.arange(99_999)
    assert not token_alignment.components(chain, chain + 1, 100_000).any()


# Vectors


def plain_groups(rows, threshold=0.98):
    def fine(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    parent, n_links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    own = [k for k, (_, v, label) in enumerate(rows) if fine(v, label)]
    unit = {k: vector_dedup.unit(np.array([rows[k][1]], np.float64))[0] for k in own}
    for a, b in itertools.combinations(own, 2):
        if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
            n_links[a] += 1
            n_links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    named = defaultdict(list)
    for k, (i, _, _) in enumerate(rows):
        named[find(k)] += [i] * (i is not None)
    out = [(i, n_links[k], min(named[find(k)], default=None)) for k, (i, _, _) in enumerate(rows)]
    return sorted(((i, n, c, i is not None and i == c) for i, n, c in out), key=repr)


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], label, 1, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, cell int, g string")


def near(rng, v, angle):
    """A unit vector at an angle from one of length one."""
    side = rng.standard_normal(len(v))
    side -= side @ v * v
    return np.cos(angle) * v + np.sin(angle) * side / np.linalg.norm(side)


def test_vectors_that_cannot_link_ties_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    v = vector_dedup.unit(rng.standard_normal((1, 16)))[0]
    same = np.float32(v).tolist()
    rows = [
        (1, None, 1), (2, [], 1), (3, [0.0] * 16, 1), (4, [float("nan"), *same[1:]], 1), (5, [float("inf"), *same[1:]], 1), (6, [None, *same[1:]], 1), (7, same, None), (8, same, 1), (8, same, 1), (9, same, 2), (10, same[:8], 1),
        (11, [2 * x for x in same], 1), (12, [-x for x in same], 1), (None, same, 1), (None, same, 3), (13, [1e-30] * 16, 4), (14, [1.0] * 16, 4), (15, [3e38] * 16, 4), (16, [5.0], 5), (17, [2.0], 5), (18, [-2.0], 5), (18, [0.0, 1.0], 5), (18, [1.0, 0.0], 5),
    ]
    got = vector_dedup.groups(vector_frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_groups(rows)
    assert got.where("false").columns == ["vec_id", "n_links", "component_id", "kept"]
    assert vector_dedup.groups(vector_frame(spark, rows).where("false")).collect() == []


@pytest.mark.parametrize("dim", [2, 24, 64, 300])
def test_planted_vectors(spark, monkeypatch, dim):
    """Chains, hubs and copies across blocks; angles clearly on either side of the threshold."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)
    rng, rows, angle = np.random.default_rng(dim), [], np.arccos(0.98)
    for k in range(30):
        v = vector_dedup.unit(rng.standard_normal((1, dim)))[0]
        rows += [(v, k % 3), (near(rng, v, angle * 0.5), k % 3), (near(rng, v, angle * 1.3), k % 3), (near(rng, v, 0.1 * angle), (k + 1) % 3)]
    hub = vector_dedup.unit(rng.standard_normal((1, dim)))[0]
    rows += [(near(rng, hub, angle * 0.2), 1) for _ in range(150)] + [(hub, 1)] * 5
    rows = [(int(i), np.float32(v).tolist(), label) for i, (v, label) in zip(rng.permutation(len(rows)), rows, strict=True)]
    got = sorted((tuple(r) for r in vector_dedup.groups(vector_frame(spark, rows)).collect()), key=repr)
    want = plain_groups(rows)
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want]
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want)


def test_estimates_are_unbiased_and_bounded():
    """Over many pairs at the threshold the mean error vanishes, and the deviation is what it says."""
    rng = np.random.default_rng(9)
    errors, deviations = [], []
    for _ in range(300):
        v = vector_dedup.unit(rng.standard_normal((4, 64)))
        both = np.concatenate([v, [near(rng, x, np.arccos(0.98)) for x in v]])
        code, align, spread = vector_dedup.encode(both)
        small, step = vector_dedup.rounded(both)
        estimate, deviation = vector_dedup.estimates(code, align, spread, small, step, 0.98)
        errors += [estimate[k, k + 4] - 0.98 for k in range(4)]
        deviations += [deviation[k, k + 4] for k in range(4)]
    assert abs(np.mean(errors)) < 4 * np.mean(deviations) / np.sqrt(len(errors))
    assert np.std(errors) < 1.1 * np.mean(deviations) and np.abs(errors).max() < vector_dedup.SIGMAS * np.mean(deviations)


def test_recall_at_the_threshold():
    """Pairs with a cosine of just 0.98 share a band nearly always."""
    rng = np.random.default_rng(4)
    v = vector_dedup.unit(rng.standard_normal((3000, 64)))
    w = np.array([near(rng, x, np.arccos(0.98)) for x in v])
    a, b = (vector_dedup.bands(vector_dedup.encode(x)[0]) for x in (v, w))
    assert (a == b).any(1).mean() > 0.99


def test_runs_hold_one_key_at_a_time():
    batches = [base.pa.record_batch({"k": x, "v": y}) for x, y in (([1, 1, 2], [1, 2, 3]), ([], []), ([2, 2], [4, 5]), ([3], [6]), ([3], [7]))]
    batches[1] = batches[0].slice(0, 0)
    assert [(t.column("k")[0].as_py(), t.column("v").to_pylist()) for t in base.runs(batches, ["k"])] == [(1, [1, 2]), (2, [3, 4, 5]), (3, [6, 7])]
