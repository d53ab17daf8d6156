"""Odd inputs that every operator has to take: nulls, empty and long texts, repeated rows, clashing column names."""

import pytest
from odd_inputs import SCHEMA, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
