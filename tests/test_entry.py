"""The driver's contract, also where the training-data operators can't be imported, and the shared folder."""

import subprocess
import sys
from pathlib import Path

import pytest

from orrery import queries as core
from orrery import session
from orrery.errors import PlanError

BLOCKED = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""


@pytest.mark.parametrize("name", ["orrery.llm", "public_tokenizers"])
def test_core_queries_stay_without_the_operators(name):
    found = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], capture_output=True, text=True, cwd=Path(__file__).parents[1])
    assert found.stdout.split() == [str(len(core.queries())), str(len(core.oracle_sql()))], found.stderr


def test_scratch_is_below_the_application(spark):
    a, b = session.scratch(spark, "x"), session.scratch(spark, "x")
    assert a != b and f"orrery-{spark.sparkContext.applicationId}/x-" in a
    spark.range(3).write.parquet(a)
    session.discard(spark, a)
    assert not Path(a).exists()


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(PlanError):
        session.shared_dir(Cluster())
