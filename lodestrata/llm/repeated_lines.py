"""Problem 4: lines repeated across the sources of one vendor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_checked
from .common import lines_of

MIN_SOURCES = 3
MIN_SHARE = 0.1


def letters_only(line: Column) -> Column:
    """The line in lower case with every run of other characters than letters as one space; empty without letters."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))


def line_keys(chunks: DataFrame) -> DataFrame:
    """point_id, line_no, vendor and the two 64-bit hashes that stand for the normalised line."""
    rows = chunks.where(F.col("vendor").isNotNull()).select("point_id", "source", F.lower(F.trim("vendor")).alias("vendor"), "text")
    norm = lines_of(rows, "point_id", "source", "vendor").select("point_id", "source", "vendor", "line_no", letters_only(F.col("line")).alias("norm"))
    return norm.where("norm != ''").select("point_id", "source", "vendor", "line_no", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"))


def frequent_lines(chunks: DataFrame, min_sources: int = MIN_SOURCES, min_share: float = MIN_SHARE) -> DataFrame:
    """vendor, h1, h2, n_sources of the lines that stand in enough distinct sources of their vendor.

    Distinct (vendor, line, source) rows are made first, so that one source or line with a third of all rows is combined
    before the shuffle; a vendor has at most 1 / min_share times its mean number of distinct lines a source of these lines.
    """
    keys = line_keys(chunks)
    counts = keys.select("vendor", "h1", "h2", F.xxhash64("source").alias("s")).distinct().groupBy("vendor", "h1", "h2").agg(F.count(F.lit(1)).alias("n_sources"))
    sources = chunks.where("vendor is not null").select(F.lower(F.trim("vendor")).alias("vendor"), F.xxhash64("source").alias("s")).distinct().groupBy("vendor").agg(F.count(F.lit(1)).alias("vendor_sources"))
    kept = counts.where(F.col("n_sources") >= min_sources)
    return kept.join(sources, "vendor").where(F.col("n_sources") >= F.col("vendor_sources") * min_share).select("vendor", "h1", "h2", "n_sources")


def repeated_lines(chunks: DataFrame, min_sources: int = MIN_SOURCES, min_share: float = MIN_SHARE) -> DataFrame:
    """point_id, line_no of every line that recurs across the sources of its vendor.

    Rows with a null vendor or text give no rows, nor do lines without letters; a chunk stored twice gives each line once;
    an empty table gives an empty result; other columns are ignored.
    """
    frequent = frequent_lines(chunks, min_sources, min_share).drop("n_sources")
    return join_checked(line_keys(chunks), frequent, ["vendor", "h1", "h2"], "left_semi").select("point_id", "line_no").distinct()


def without_repeated_lines(chunks: DataFrame, min_sources: int = MIN_SOURCES, min_share: float = MIN_SHARE) -> DataFrame:
    """point_id, text of each stored chunk, rebuilt without its recurring lines; null texts stay null."""
    found = repeated_lines(chunks, min_sources, min_share).groupBy("point_id").agg(F.collect_set("line_no").alias("gone"))
    once = chunks.select("point_id", "text").dropDuplicates(["point_id"])
    lines = F.split("text", "\n", -1)
    left = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    return once.join(found, "point_id", "left").select("point_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))


