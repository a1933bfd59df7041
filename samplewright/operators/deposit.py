"""Deposit sheets: ragged file lists to numbered columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplewright.model import DEPOSIT_COLUMNS, PAIRED_COLUMNS


def _has(df: DataFrame, name: str) -> Column | None:
    return F.col(f"`{name}`") if name in df.columns else None


def _lists(samples: DataFrame) -> tuple[Column, Column]:
    """(processed, raw) file lists; the list field is preferred, single fields are the fallback."""
    text = lambda n: F.when(_has(samples, n) != "", _has(samples, n)) if n in samples.columns else F.lit(None).cast("string")
    present = lambda *cols: F.filter(F.array(*cols), lambda x: x.isNotNull())
    lst = lambda n: _has(samples, n) if n in samples.columns else F.lit(None).cast("array<string>")
    given = lambda n, alt: F.when(F.size(F.coalesce(lst(n), F.array().cast("array<string>"))) > 0, lst(n)).otherwise(alt)
    processed = given("processed_data_files", present(text("processed data file"), text("processed data file (2)")))
    raw = given("raw_files", present(text("*raw file")))
    return processed, raw


def list_widths(samples: DataFrame) -> DataFrame:
    """One row: the longest processed and raw list. A sample counts as one raw file when it has no list."""
    processed, _ = _lists(samples)
    raw = F.size("raw_files") if "raw_files" in samples.columns else F.lit(None).cast("int")
    return samples.agg(
        F.coalesce(F.max(F.size(processed)), F.lit(0)).alias("max_processed"),
        F.coalesce(F.max(F.when(raw.isNotNull() & (raw >= 0), raw).otherwise(1)), F.lit(1)).alias("max_raw"),
    )


def numbered_headers(max_processed: int, max_raw: int) -> tuple[list[str], list[str]]:
    """Column names for lists of these lengths: processed `x, x (2), …`; raw `*raw file, raw file, raw file (2), …`."""
    processed = ["processed data file"][:max_processed] + [f"processed data file ({i})" for i in range(2, max_processed + 1)]
    raw = ["*raw file"] + ["raw file"][: max(0, max_raw - 1)] + [f"raw file ({i})" for i in range(2, max_raw)]
    return processed, raw


def deposit_table(samples: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The deposit sheet: fixed columns, then processed, then raw files. One small job finds the two widths."""
    width = list_widths(samples).first()
    processed_cols, raw_cols = numbered_headers(width["max_processed"], width["max_raw"])
    processed, raw = _lists(samples)
    base = [
        (_has(samples, c) if c in samples.columns else F.lit(None).cast("string")).alias(c) for c in DEPOSIT_COLUMNS
    ]
    return samples.withColumns({"_proc": processed, "_raw": raw}).select(
        *(keep or []), *base,
        *[F.get("_proc", F.lit(i)).alias(c) for i, c in enumerate(processed_cols)],
        *[F.get("_raw", F.lit(i)).alias(c) for i, c in enumerate(raw_cols)],
    )


def paired_table(pairs: DataFrame) -> DataFrame:
    return pairs.select(*[
        (F.col(f"`{c}`") if c in pairs.columns else F.lit(None).cast("string")).alias(c) for c in PAIRED_COLUMNS
    ])
