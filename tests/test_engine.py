"""Names, suggestions and metrics of the engine."""

import pytest

from orrery.errors import PlanError
from orrery.sources.engine import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register_table("sales", spark.sql("SELECT 1 AS region_id, 2.5D AS price, 'x' AS Label"))
    return e


@pytest.mark.parametrize(
    ("sql", "hint"),
    [
        ("SELECT region_id FROM sale", "no table sale; did you mean sales?"),
        ("SELECT regoin_id FROM sales", "no column regoin_id; did you mean region_id?"),
        ("SELECT zzzzzz FROM sales", "no column zzzzzz"),
        ('SELECT "REGION_ID" FROM sales', 'no name "REGION_ID"; did you mean "region_id"?'),
        ('SELECT price FROM "Sales"', 'no name "Sales"; did you mean "sales"?'),
    ],
)
def test_unknown_names(engine, sql, hint):
    with pytest.raises(PlanError, match=hint.replace("?", "[?]")):
        engine.sql(sql)


def test_quoted_names_as_they_are(engine):
    assert engine.sql('SELECT "region_id", REGION_ID, "Label", price AS "Price" FROM sales ORDER BY "Price"').columns == ["region_id", "REGION_ID", "Label", "Price"]


def test_a_lazy_table_is_loaded_when_it_is_named(spark):
    e, loaded = Engine(spark), []
    df = spark.range(2)
    e.register_table_stream_lazy("t", df.schema, lambda: loaded.append(1) or [df])
    e.register_table("other", df)
    assert e.sql("SELECT COUNT(*) AS t1 FROM other").first()[0] == 2 and not loaded
    assert e.sql("SELECT COUNT(*) FROM t").first()[0] == 2 and loaded


def test_metrics(spark):
    e = Engine(spark)
    e.register_table("one_row", spark.range(1))
    assert e.fetch("SELECT id FROM one_row").num_rows == 1
    with pytest.raises(PlanError):
        e.sql("SELECT nothing FROM one_row")
    text = e.metrics.prometheus()
    assert "orrery_queries_total 2" in text and "orrery_errors_total 1" in text and "orrery_rows_total 1" in text
    assert 'orrery_phase_seconds_count{phase="plan"} 2' in text and 'phase_seconds_bucket{phase="run",le="+Inf"} 1' in text
    assert Engine(spark).metrics.prometheus() == ""
