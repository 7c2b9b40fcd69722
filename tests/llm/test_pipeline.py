"""Every stage of the pipeline against a brute-force version, each on its own input."""

import random
import re
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from test_operators import plain_components, plain_entropy, plain_fingerprint, plain_spans
from test_suffixes import plain_removal
from test_tokens import check_packing

from tidemark.llm import quality


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        out.append((name, docs.collect(), docs.columns))
        stage(spark, docs, sf_dir).write.parquet(f"file://{path}")
        docs = spark.read.parquet(f"file://{path}")
    return [*out, ("result", docs.collect(), docs.columns)]


def test_columns_stay_those_of_documents(tables):
    assert [n for n, _, _ in tables[:-1]] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "secret_scans", "best_fit_packing"]
    assert {tuple(c) for _, _, c in tables[:-1]} == {("doc_id", "text", "lang", "source", "n_chars")}


def test_quality_stage(spark, sf_dir, tables):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    accepted = {r.doc_id for r in quality.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels).collect() if r.predicted}
    assert {r.doc_id for r in tables[1][1]} == accepted and 0.6 * len(tables[0][1]) < len(accepted) < len(tables[0][1])


def test_near_dedup_stage(tables):
    own = [(r.doc_id, plain_fingerprint(r.text)) for r in tables[1][1]]
    roots = plain_components([i for i, _ in own], [(a, b) for a, x in own for b, y in own if a < b and (x ^ y).bit_count() <= 3])
    assert sorted(r.doc_id for r in tables[2][1]) == sorted(i for i, root in roots.items() if i == root)
    texts = {r.doc_id: r.text for r in tables[1][1]}
    assert all(r.text == texts[r.doc_id] for r in tables[2][1])


def test_repeated_passages_stage(tables):
    before = sorted(tables[2][1], key=lambda r: r.doc_id)
    after = {r.doc_id: r for r in tables[3][1]}
    assert [r.doc_id for r in before] == sorted(after)
    for r, (n, removed, _, _) in zip(before, plain_removal([r.text.encode() for r in before], pipeline.PASSAGE_BYTES)):
        kept = after[r.doc_id]
        assert kept.n_chars == len(kept.text) and 0 <= len(kept.text.encode()) - (n - removed) <= 6 * (removed > 0) * 10
        assert removed or kept.text == r.text


def test_secrets_stage(tables):
    after = {r.doc_id: r for r in tables[4][1]}
    assert len(after) == len(tables[3][1])
    for r in tables[3][1]:
        spans, out, at = sorted({(s, e) for s, _, e, _ in plain_spans(r.text) + plain_entropy(r.text)}), "", 0
        for s, e in spans:
            if s >= at:
                out += r.text[at:s] + "[SECRET]"
            at = max(at, e)
        assert after[r.doc_id].text == out + r.text[at:] and after[r.doc_id].n_chars == len(after[r.doc_id].text)
        assert not re.search("AKIA[A-Z0-9]{16}", after[r.doc_id].text)


def test_packing_stage(tables):
    check_packing(tables[5][1], {r.doc_id: r.text for r in tables[4][1]}, 2048)


def test_run(spark, sf_dir, tables):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, pipeline.run(spark, sf_dir).collect())) == Counter(map(key, tables[5][1]))


def test_passages_of_fifty_words_go_and_clean_documents_stay(spark, sf_dir):
    """Passages of 50 to 80 words in three documents each, among words of any length; the other documents are unique."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8])))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(51, 80)) for _ in range(30)]
    rows = [(3 * k + j, f"{prose(rng.randint(5, 90))} {p} {prose(rng.randint(5, 90))}", "xx", "s", 0) for k, p in enumerate(passages) for j in range(3)]
    clean = [(1000 + k, prose(rng.randint(1, 300)), "xx", "s", 0) for k in range(60)]
    docs = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s, _ in rows + clean], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in pipeline.repeated_passages(spark, docs, sf_dir).collect()}
    assert len(got) == len(rows) + len(clean)
    assert all(got[i].text == t for i, t, *_ in clean)
    caught = sum(passages[i // 3] not in got[i].text and len(got[i].text) < len(t) - len(passages[i // 3]) + 20 for i, t, *_ in rows)
    assert caught == len(rows) and all(r.n_chars == len(r.text) for r in got.values())


def test_clashing_columns_and_repeated_ids(spark, sf_dir):
    """Every stage keeps extra columns, whatever their names; a row with another row's id and another text stays."""
    texts = ["the quick brown fox jumps over the lazy dog by the river bank " * 3, "password = hunter22 and more words than that to make a text of it", "ten words of a text that is like no other one"]
    names = ["base", "added", "k1", "k2", "n_bytes", "n_chars", "score", "predicted", "label", "fp", "row", "spans", "task", "length", "first"]
    rows = [(1, t, *["v"] * len(names)) for t in (*texts, texts[0])] + [(None, texts[2] + " but this", *["v"] * len(names)), (2, None, *[None] * len(names)), (3, "", *["v"] * len(names))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for k, (name, stage) in enumerate(pipeline.STAGES):
        for own in (docs, docs.where("false")):
            got = stage(spark, own, sf_dir)
            if k < 4:
                assert got.columns == docs.columns, name
            found = got.collect()
            if name == "simhash_near_dedup" and own is docs:
                assert sorted(r.text or "" for r in found if r.doc_id == 1) == sorted(texts)
                assert all(r.base == "v" and r.added == "v" for r in found if r.doc_id == 1)
            if name in ("suffix_array_dedup", "secret_scans") and own is docs:
                assert len(found) == len(rows) and all(r.k1 == r.score == "v" for r in found if r.doc_id != 2) and sum(r.text is None for r in found) == 1
