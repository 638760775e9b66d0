"""What several of the text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as white space or invisible, as a regular expression class body (Java and RE2).
BLANK_CLASS = r"\s\x{0085}\x{00a0}\x{00ad}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}"


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space and invisible characters."""
    return F.coalesce(~text.rlike(f"[^{BLANK_CLASS}]"), F.lit(True))


def lines_of(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row a line of the text: line_no from 0, blank lines included; a null text has no lines."""
    return df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
