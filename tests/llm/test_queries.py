"""The registered queries of the subpackage that have SQL, on the smallest tables, and what the entry module offers."""

import pytest
from check import compare

from __spark_entry__ import oracle_sql, queries
from textloom.llm.queries import oracles, registered

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_matches_sql(spark, name):
    assert compare(spark, FOLDER, name, registered()[name], oracles()[name]).startswith("ok")


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in registered()}
    assert set(registered()) | {"pipeline"} <= set(queries()) and set(oracles()) <= set(oracle_sql())
