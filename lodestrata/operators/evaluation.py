"""Offline evaluation of retrieval: metrics of items, means, gates and comparisons.

Items without hits score 0; a null score is left out of a mean of scores; items without wanted vendor never hit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def item_metrics(hits: DataFrame, questions: DataFrame, rows: DataFrame, rid: str = "point_id") -> DataFrame:
    """qid, wanted, recall_5, recall_10, rr, top_score of each question; a hit is a row of the wanted vendor."""
    vendors = rows.select(rid, F.lower(F.trim("vendor")).alias("v")).join(hits.select(rid).distinct(), rid, "left_semi")
    seen = questions.select("qid", "wanted").join(hits.join(vendors, rid, "left"), "qid", "left").withColumn("hit", F.coalesce(F.col("v") == F.col("wanted"), F.lit(False)))
    return seen.groupBy("qid", "wanted").agg(
        F.bool_or(F.col("hit") & (F.col("rank") <= 5)).cast("int").alias("recall_5"),
        F.bool_or(F.col("hit") & (F.col("rank") <= 10)).cast("int").alias("recall_10"),
        F.coalesce(F.round(1 / F.min(F.when(F.col("hit"), F.col("rank"))), 6), F.lit(0.0)).alias("rr"),
        F.max("score").alias("top_score"),
    )


def expected_metrics(hits: DataFrame, items: DataFrame, rows: DataFrame, rid: str = "point_id") -> DataFrame:
    """qid, recall_5, recall_10, rr, caption_5, caption_10, strict_5, strict_10 of each item.

    items has qid, expected (an array of sources) and needle: a hit is a row of an expected source; a caption hit is one that is a
    caption; a strict one also holds the needle, in lower case (a blank needle asks for nothing). Items without sources score 0.
    """
    about = rows.select(rid, "source", "content_type", "text").join(hits.select(rid).distinct(), rid, "left_semi")
    found = hits.select("qid", rid, "rank").join(about, rid)
    seen = items.select("qid", "expected", F.lower(F.trim(F.coalesce("needle", F.lit("")))).alias("needle")).join(found, "qid", "left")
    hit = F.coalesce(F.array_contains("expected", F.col("source")), F.lit(False))
    caption = hit & F.coalesce(F.col("content_type") == "image_caption", F.lit(False))
    strict = caption & F.contains(F.lower(F.coalesce("text", F.lit(""))), F.col("needle"))
    within = lambda what, k: F.bool_or(what & (F.col("rank") <= k)).cast("int")
    return seen.groupBy("qid").agg(
        within(hit, 5).alias("recall_5"), within(hit, 10).alias("recall_10"), F.coalesce(F.round(1 / F.min(F.when(hit, F.col("rank"))), 6), F.lit(0.0)).alias("rr"),
        within(caption, 5).alias("caption_5"), within(caption, 10).alias("caption_10"), within(strict, 5).alias("strict_5"), within(strict, 10).alias("strict_10"),
    ).na.fill(0)


def bake_off(runs: DataFrame) -> DataFrame:
    """model, n and the mean metrics of each model that was tried on the same items."""
    return runs.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_5", "recall_10", "rr")])


def aggregated(metrics: DataFrame) -> DataFrame:
    """n and the means; a missing top score is left out of its mean."""
    return metrics.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg("recall_10"), 6).alias("recall_10"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("top_score"), 6).alias("mean_top"))


def regressions(current: DataFrame, base: DataFrame, tolerance: float, metrics: tuple[str, ...] = ("recall_5", "recall_10", "mrr")) -> DataFrame:
    """metric, base, current where the current value lies below the base by more than the tolerance; nulls are skipped."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in metrics)
    tall = lambda df, name: df.select(F.expr(f"stack({len(metrics)}, {pairs}) as (metric, {name})"))
    return tall(base, "base").join(tall(current, "current"), "metric").where(F.col("current") < F.col("base") - tolerance)


def winners(a: DataFrame, b: DataFrame) -> DataFrame:
    """winner, n: items by recall at 5, then reciprocal rank, ties to a."""
    both = a.select("qid", F.struct("recall_5", "rr").alias("a")).join(b.select("qid", F.struct("recall_5", "rr").alias("b")), "qid")
    return both.groupBy(F.when(F.col("b") > F.col("a"), "b").otherwise("a").alias("winner")).agg(F.count(F.lit(1)).alias("n"))
