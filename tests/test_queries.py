"""Every registered query with SQL gives DuckDB's rows, on the smallest tables."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry
from clausemill import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def bag(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return collections.Counter(tuple(round(x, 6) if isinstance(x := r[i], float) else x for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    result = duck.execute(engine.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(names, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_file_source(spark, tmp_path):
    from clausemill.sources import readers

    (tmp_path / "a.txt").write_bytes("caf\xe9. Ok.".encode("latin-1"))
    path = (tmp_path / "a.txt").as_uri()
    assert readers.files(spark, path, "latin-1").collect()[0]["text"] == "café. Ok."
    for encoding in ("utf-8", "ascii"):
        with pytest.raises(Exception, match="not U"):
            readers.files(spark, path, encoding).collect()
