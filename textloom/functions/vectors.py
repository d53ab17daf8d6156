"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: scores are rounded to this many decimals, so that equal similarities stay equal whatever
# the order of summation was, and ties fall through to the row ids.
SCORE_DECIMALS = 10


def norm(vector: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda total, a: total + a.cast("double") * a.cast("double"))
    )
