"""Queries that have SQL, against it: on the small documents, and on odd texts."""

import duckdb
import pytest
import xxhash

from tidemark.llm import oracles, queries

ODD = [None, "", " \t\n", "One", "one TWO", "ÀB c d", "a b c d e", "word " * 300, "Word " * 300, "x" * 900, "y" + "x" * 900, "é" * 450, "漢字 仮名 " * 90, "z" * 399, "z" * 400, "one two three four", "one two three four"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    docs = [(k, t, (None, "en", "", "fr")[k % 4]) for k, t in enumerate(ODD)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (8, 1, 1), (9, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    vectors = [(1, [1.0, 0.0], 1), (2, [0.99, 0.1], 1), (3, [0.97, 0.25], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], None), (9, [2.0, 0.0], 1), (9, [1.0, 0.0], 2), (10, [-1.0, 0.0], 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("source", ["documents", "odd"])
def test_query_equals_sql(spark, sf_dir, odd, name, source):
    folder, files = (sf_dir, "") if source == "documents" else (odd, "/*.parquet")
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{files}'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, folder if source == "documents" else f"file://{folder}")
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())


def test_hash_in_sql():
    texts = [(("a漢bé" * 30)[: k + 1] + str(k)) for k in range(100)]
    con = duckdb.connect()
    con.execute("CREATE TABLE c (s VARCHAR)")
    con.executemany("INSERT INTO c VALUES (?)", [[t] for t in texts])
    got = dict(con.execute(f"WITH {oracles.xxh64('(SELECT s, CAST(42 AS UBIGINT) AS e FROM c)')} SELECT s, h FROM hashed").fetchall())
    assert got == {t: xxhash.xxh64_intdigest(t.encode(), 42) for t in texts}
