"""Queries of this folder against their SQL, on the files as they are."""

import duckdb
import pytest

from orrery.llm.queries import oracle_sql, queries
from tests.harness import DATA, duck, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_duckdb(spark, name):
    got, want = spark_rows(queries()[name](spark, DATA)), duck_rows(duck(), oracle_sql()[name])
    assert got == want


def test_scores_equal_the_sql_bit_by_bit(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    want = {(r[0], r[2]): r[3] for r in con.execute(oracle_sql()["op10_vector_search"]).fetchall()}
    got = {(r.query_id, r.vec_id): r.score for r in queries()["op10_vector_search"](spark, DATA).collect()}
    assert got == want
