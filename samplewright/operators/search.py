"""Search over sample payloads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.functions import text as t


def _combine(parts: list[Column], logic: str) -> Column:
    return reduce((lambda a, b: a & b) if logic == "AND" else (lambda a, b: a | b), parts)


def advanced_search(
    rows: DataFrame, texts: Sequence[str], sampletypes: Sequence[str] = (), attributes: Sequence[str] = (),
    match: str = "PARTIAL", attribute_logic: str = "OR", text_logic: str = "OR",
) -> DataFrame:
    """Rows of any listed type whose attributes match the texts.

    Without attributes any payload value may match. Matching ignores case, which the contract leaves open. `match` is
    PARTIAL (substring) or EXACT (whole value); each logic is AND or OR. All of it is one filter on the scan.
    """
    if not texts or match not in ("PARTIAL", "EXACT"):
        raise ValueError("give at least one text, and PARTIAL or EXACT")
    if {attribute_logic, text_logic} - {"AND", "OR"}:
        raise ValueError("logic is AND or OR")

    def fits(value: Column, text: str) -> Column:
        low, want = F.lower(value), F.lit(text.lower())
        return low == want if match == "EXACT" else F.contains(low, want)

    def on_row(text: str) -> Column:
        if not attributes:
            return F.exists(F.map_values("attrs"), lambda v: fits(v, text))
        return _combine([F.coalesce(fits(t.attr("attrs", a), text), F.lit(False)) for a in attributes], attribute_logic)

    hit = _combine([on_row(x) for x in texts], text_logic)
    if sampletypes:
        hit = F.col("sampletype").isin(*sampletypes) & hit
    return rows.where(F.coalesce(hit, F.lit(False)))
