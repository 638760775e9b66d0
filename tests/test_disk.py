"""What retrieval queries write: less than the texts that they search."""

from __future__ import annotations

import os
import random

import pytest

from pyspark.sql import functions as F

from lodestrata.plans import registry
from lodestrata.session import checkpointed, shared_dir


def written(spark) -> int:
    """Bytes shuffled so far and those of checkpoints on disk."""
    folder = shared_dir(spark).removeprefix("file:")
    shuffled = spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    return shuffled + sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    known = [f"{rng.randrange(16**6):06x}" for _ in range(500)]
    at = tmp_path_factory.mktemp("tables")
    rows = [(f"{i:032x}", " ".join(rng.choices(known, k=170)), f"source {i % 90}", i % 7, "v", ("text", "image_caption")[i % 2], "2025") for i in range(3000)]
    spark.createDataFrame(rows, "point_id string, text string, source string, page int, vendor string, content_type string, ingested_at string").repartition(4).write.parquet(f"{at}/chunks.parquet")
    spark.createDataFrame([(i, " ".join(known[i * 3 : i * 3 + 3]), "v") for i in range(20)], "item_id bigint, question string, vendor string").write.parquet(f"{at}/eval_items.parquet")
    return str(at), sum(len(r[1]) for r in rows)


@pytest.mark.parametrize("name", ["r14_citations", "r5_text_and_images", "v12_top_facts", "r2_hybrid"])
def test_texts_are_not_written(spark, tables, name):
    at, size = tables
    checkpointed(spark.range(1))
    before = written(spark)
    rows = registry.queries()[name](spark, at)
    assert rows.collect()
    assert written(spark) - before < size / 2


def test_texts_stored_again_are_shuffled_once(spark, tmp_path):
    ids = 100_500  # more than are broadcast
    words = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 256) for i in range(5)], F.when(F.col("id") % 1000 < 3, "omega"))
    rows = spark.range(2 * ids).select((F.col("id") % ids).cast("string").alias("point_id"), words.alias("text"), F.lit("s").alias("source"), F.lit(0).alias("page"), F.lit("v").alias("vendor"), F.when(F.col("id") % 2 == 0, "text").otherwise("image_caption").alias("content_type"), F.when(F.col("id") >= ids, "2025").otherwise("2024").alias("ingested_at"))
    rows.repartition(4).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, "omega")], "item_id bigint, question string").withColumn("vendor", F.lit("v")).write.parquet(f"{tmp_path}/eval_items.parquet")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0]
    before = written(spark)
    got = registry.queries()["r5_text_and_images"](spark, str(tmp_path)).collect()
    assert written(spark) - before < 1.6 * size
    last = [i for i in range(ids, 2 * ids) if i % 1000 < 3]
    both = [sorted(str(i - ids) for i in last if i % 2 == kind)[:20] for kind in (0, 1)]
    want = sorted((-round(1 / (61 + at), 8), x) for hits in both for at, x in enumerate(hits))[:10]
    assert sorted((r.rank, r.score, r.point_id) for r in got) == [(at + 1, -s, x) for at, (s, x) in enumerate(want)]
