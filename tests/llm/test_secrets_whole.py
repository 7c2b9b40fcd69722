"""Secrets that the allow list or a missing class of characters used to hide."""

import random
import string
import time

from pyspark.sql import functions as F

from tidemark.llm import secrets

RSA = "AAAAB3NzaC1yc2EAAAADAQABAAABgQC7vTq9Lk2xWf8RzYpM4dHs6JnQe1UbXo3GcVaKi5tE0yZrPwNDlFhSuBm"
OPENSSH = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZW"
LONG = "k9Qz7LmX2vBn4TgY8RwE1sUd6HjPa3Cf0ZoIiK5exampleVtNqS9yWbGx7JhM2rDcA4pFuL8kQ1zT"


def test_secrets_that_were_hidden(spark):
    rng = random.Random(11)
    token = lambda alphabet, n=32: "".join(rng.choice(alphabet) for _ in range(n))
    shown = [
        (RSA, "entropy64"), (OPENSSH, "entropy64"), (LONG, "entropy64"),
        (token(string.ascii_lowercase + string.digits), "entropy36"), ("key-" + token(string.ascii_lowercase + string.digits), "entropy36"),
        (token(string.ascii_uppercase + "234567"), "entropy32"), (token(string.ascii_letters), "entropy52"),
        ("3f9c1b7e-52ad-4e08-9b6d-c47a10f8e25b", "uuid"),
    ]
    hidden = [
        "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "Aa1" * 3000,
        "Example1-Placeholder2-" * 12, "abcdefghijklmnopqrstuvwxyz0123456789", "00000000-0000-0000-0000-000000000000", "InternationalisationOfServices",
        "the words of a plain sentence, joined-by-hyphens-and-2024-in-between",
    ]
    df = spark.createDataFrame(list(enumerate([f"see {x} here" for x, _ in shown] + [f"see {x} here" for x in hidden])), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.digest(df).collect()}
    for k, (x, name) in enumerate(shown):
        at = 4 + (4 if x.startswith("key-") else 0)
        assert got[k] == f"{name}:{at}:{4 + len(x)}", x
    assert [got[k] for k in range(len(shown), len(got))] == [""] * len(hidden)


def test_long_runs_are_scanned_in_linear_time(spark):
    """Runs of 20 to a million characters, with and without equal letters inside, are all reported."""
    rng = random.Random(5)
    alphabet = string.ascii_letters + string.digits
    runs = []
    for n in (20, 1_000, 50_000, 1_000_000):
        run = "".join(rng.choice(alphabet) for _ in range(n - 3)) + "aZ7"
        runs += [run, run[: n // 2] + "aaaa" + run[n // 2 :] if n > 20 else run]
    df = spark.createDataFrame([(i, f"see {x} here") for i, x in enumerate(runs)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.spans for r in secrets.digest(df).collect()}
    assert [got[i] for i in range(len(runs))] == [f"entropy64:4:{4 + len(x)}" for x in runs]
    assert time.time() - began < 90


def test_many_secrets_in_one_text(spark):
    """Spans that touch block ends, and thousands of them; every column is kept, whatever its name."""
    rng = random.Random(6)
    text, want = [], []
    for k in range(3_000):
        plain = "wörds 🎉 " * rng.randint(0, 3 if k % 500 else 2_000)
        text.append(plain + "AKIA" + "".join(rng.choice(string.ascii_uppercase) for _ in range(rng.randint(16, 40))) + " ")
        want.append(plain + "[SECRET] ")
    columns = ("doc_id", "text", "base", "added", "raw", "row", "k1")
    df = spark.createDataFrame([(1, "".join(text), "b", "a", "r", "w", 3), (2, None, "b", None, "r", "w", 3), (2, "", "b", None, "r", "w", 3)], "doc_id long, text string, base string, added string, raw string, row string, k1 long")
    got = secrets.redact(df)
    assert tuple(got.columns) == columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "".join(want), "b", "a", "r", "w", 3), (2, None, "b", None, "r", "w", 3), (2, "", "b", None, "r", "w", 3)], key=str)
    assert secrets.scan(df, columns).columns == ["doc_id", "text", "raw", "row", "k1", "base", "added"]


def test_suppressed_runs_of_any_length(spark):
    """What filler makes up is suppressed, however much of it there is; one secret inside it is not."""
    rng = random.Random(8)
    unit = lambda n: "".join(rng.choice(["Example1-", "Placeholder2_", "changeMe0/", "0123456789Zy-", "Aa1Aa1Aa1Aa1Aa1"]) for _ in range(n))
    short, long = [unit(3 + k) for k in range(20)], [unit(390), unit(405), unit(12_000), "Aa1" * 40_000]
    key = "k9Qz7LmX2vBn4TgY8RwE1sUd6HjPa3Cf0"
    texts = [f"see {x} here" for x in short + long] + [f"see {x}{key}{x} here" for x in long]
    got = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    n = len(short + long)
    assert [got[k] for k in range(n)] == [""] * n
    assert [got[n + k] for k in range(len(long))] == [f"entropy64:4:{4 + 2 * len(x) + len(key)}" for x in long]


def _busy(rng, n):
    """As many secrets as candidates, some of which overlap."""
    random_text = lambda k: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(k))
    return " ".join(f"token={random_text(8)} {random_text(24)}" if k % 7 else f"x{random_text(12)}+AKIA{'A1B2C3D4E5F6G7H8'}" for k in range(n))


def test_search_keeps_what_a_comparison_of_all_pairs_keeps(spark):
    rng = random.Random(9)
    rows = []
    for k in range(300):
        cuts = sorted(rng.sample(range(60), 2 * rng.randint(0, 8)))
        mine = [(a, 9, b, "c") for a, b in zip(cuts[::2], cuts[1::2])]
        taken = [(a, rng.randint(0, 2), a + rng.randint(1, 9), "t") for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 6)))]
        rows.append((k, mine, taken))
    span = "array<struct<start:int,kind:int,end:int,body:string>>"
    df = spark.createDataFrame(rows, f"k long, mine {span}, taken {span}")
    got = {r.k: [tuple(x) for x in r.kept] for r in df.select("k", secrets.apart(F.col("mine"), F.col("taken")).alias("kept")).collect()}
    assert got == {k: [x for x in mine if not any(t[0] < x[2] and x[0] < t[2] for t in taken)] for k, mine, taken in rows}


def test_time_grows_with_the_secrets_of_a_text(spark):
    """Twice the secrets and candidates in one text take about twice as long, up to 50,000 of each."""
    rng = random.Random(10)
    texts = {n: _busy(rng, n) for n in (500, 25_000, 50_000)}
    took = {}
    for n, text in texts.items():
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        secrets.digest(df).collect()
        took[n] = time.time() - began
    assert took[50_000] <= 2.2 * took[25_000] + 2, took
