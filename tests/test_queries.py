import pytest

from orrery.queries import oracle_sql, queries
from tests.harness import DATA, duck, duck_rows, spark_rows

CON = duck()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_duckdb(spark, name):
    got, want = spark_rows(queries()[name](spark, DATA)), duck_rows(CON, oracle_sql()[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
