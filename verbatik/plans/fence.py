"""A fence in a plan, against conditions being pushed into what makes their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame) -> DataFrame:
    """df through a generator of one row for each row.

    The optimizer pushes a filter below a projection by writing the projection's expressions into
    it; array expressions would then be worked out twice, or, inside a lambda, once an element. It
    doesn't push filters on a generator's output.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
