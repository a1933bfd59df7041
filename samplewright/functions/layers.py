"""Derived columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layer(df: DataFrame, *kept: str, **cols: Column) -> DataFrame:
    """`df` (or its `kept` columns) with derived columns that come out of a one-element `inline`.

    The optimizer moves filters below a plain projection by copying the expressions into the filter, and below a
    repartitioning too. It does not do so here: each expression is evaluated once per row, where it is written.
    """
    struct = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*(kept or ("*",)), F.inline(F.array(struct)))
