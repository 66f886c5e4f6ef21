"""Every query beside its SQL, at the smallest scale."""

import __spark_entry__ as entry
import pytest
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Model training takes most of a minute whatever the scale; test_models covers it.
SLOW = {"model_grid", "model_report", "model_noise_sets", "model_noise_levels"}
EMPTY = {"augmented_copies"}  # four trips, one of each class: nothing to balance


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, con, name):
    wrong = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert wrong == ("no rows" if name in EMPTY else None)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
