import duckdb
import pytest

import __spark_entry__
from stratalog.llm import queries

DIR = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and "op2_exact_topk" in __spark_entry__.oracle_sql()


def compared(spark, name, folder):
    sql = duckdb.connect()
    for table in ("documents", "embeddings"):
        sql.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{'/*.parquet' if folder != DIR else ''}')")
    df = queries.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(columns).collect())
    want = sql.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns and got
    assert got == sorted(tuple(repr(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    compared(spark, name, DIR)


@pytest.mark.parametrize("name", ["op5_ngram_jaccard_join", "op7_suffix_dedup"])
def test_same_rows_as_sql_on_long_texts_copies_and_nulls(spark, name, tmp_path):
    words = [f"w{i * i % 977}é" for i in range(9000)]
    long, passage = " ".join(words), " ".join(words[100:170])
    texts = [None, "", " \t", "One", "one", "a b c d", long, long[:-9] + " end", long.upper(), passage, "x " + passage + " y", passage * 2, "z" * 1200]
    rows = [(i, t, None, str(i), 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string, spans string, region int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    df.select("doc_id").write.parquet(f"{tmp_path}/embeddings.parquet")
    compared(spark, name, tmp_path)
