"""Operators without SQL against brute force, and odd rows."""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import catalog, chunking, evaluation, retrieval, timed
from lodestrata.session import join_checked, join_salted, numbered

CHUNK = "point_id string, text string, source string, page int, url string, vendor string, product string, content_type string, doc_type string, section string, lang string, schema_version int, ingested_at string, chunk_index int, source_type string, more string"


def chunks(spark, rows):
    keys = [x.split()[0] for x in CHUNK.split(", ")]
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], CHUNK)


def test_numbered_like_row_number_with_hot_key_and_nulls(spark):
    rows = [("hot" if i % 3 else None if i % 5 == 0 else f"k{i % 7}", (i * 7919) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = {(r.id): r.seq for r in numbered(df, ["k"], ["v", "id"]).collect()}
    for key in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])):
            assert got[r[2]] == n


def test_salted_join_is_the_join(spark):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 99), (None, 100)], "k string, v int")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = Counter(map(tuple, left.join(right, ["k"], how).collect()))
        assert Counter(map(tuple, join_salted(left, right, ["k"], how, 4, "v").collect())) == want
        assert Counter(map(tuple, join_checked(left, right, ["k"], how, max_rows=1).collect())) == want
        assert Counter(map(tuple, join_checked(left, right, ["k"], how).collect())) == want


def test_nearest_like_brute_force(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8))
    m[17] = 0
    m[18] = m[19]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(900, None)], "vec_id bigint, embedding array<float>")
    queries = rows.where("vec_id % 50 = 0 and vec_id < 300").withColumnRenamed("vec_id", "qid")
    got = {}
    for r in retrieval.nearest(queries, rows, 5).collect():
        got.setdefault(r.qid, []).append((r.rank, r.vec_id))
    f = m.astype(np.float32).astype(float)
    unit = np.divide(f, np.linalg.norm(f, axis=1)[:, None], out=np.zeros_like(f), where=np.linalg.norm(f, axis=1)[:, None] > 0)
    for q, hits in got.items():
        score = np.round(unit @ unit[q], 9)
        assert [i for _, i in sorted(hits)] == sorted(range(300), key=lambda i: (-score[i], i))[:5]
    assert set(got) == {0, 50, 100, 150, 200, 250}
    assert retrieval.nearest(queries.limit(0), rows, 5).count() == 0
    assert retrieval.nearest(queries, rows.limit(0), 5).count() == 0


def test_fallback_only_where_nothing_matches(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(10)], "vec_id bigint, embedding array<double>, label int")
    q = spark.createDataFrame([(1, [1.0, 1.0], 0), (2, [1.0, 1.0], 7)], "qid bigint, embedding array<double>, label int")
    got = retrieval.filtered_with_fallback(q, rows, 3).collect()
    assert {(r.qid, r.fallback) for r in got} == {(1, False), (2, True)}
    assert all(r.vec_id % 2 == 0 for r in got if r.qid == 1)


def test_floor_and_packing(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.2, 2), (2, "a", 0.1, 1), (2, "c", 0.05, 2)], "qid bigint, point_id string, score double, rank int")
    assert {(r.qid, r.point_id) for r in retrieval.above_floor(hits, 0.5).collect()} == {(1, "a"), (2, "a")}
    assert retrieval.above_floor(hits, 0).count() == 4
    rows = spark.createDataFrame([("a", "x" * 400), ("b", "y" * 40), ("c", None)], "point_id string, text string")
    assert {(r.qid, r.point_id, r.spent) for r in retrieval.packed_context(hits, rows, 110).collect()} == {(1, "a", 102), (2, "a", 102), (2, "c", 104)}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=400), st.integers(20, 60), st.integers(0, 9))
def test_pieces_cover_the_text(text, size, overlap):
    spans = chunking.pieces(text, size, overlap)
    assert all(0 < b - a <= size for a, b in spans)
    assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b < d and b - c <= overlap


def test_uuid5_and_estimates(spark):
    names = ["", "a|1|2", "ü|None|0", "x" * 500]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for r in df.select("n", T.uuid5(F.col("n")).alias("u"), T.token_estimate(F.col("n")).alias("t")).collect():
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n))
        assert r.t == (max(1, len(r.n) // 4) if r.n else 0)


def test_catalog_with_nulls_repeats_and_no_rows(spark):
    rows = [
        {"point_id": "1", "source": "a", "text": "t", "vendor": " X ", "content_type": "text", "ingested_at": "2024"},
        {"point_id": "1", "source": "a", "text": "u", "vendor": "X", "content_type": "text", "ingested_at": "2025"},
        {"point_id": "2", "source": "a", "vendor": "", "content_type": "image_caption"},
        {"point_id": None, "source": None},
        {"point_id": "3", "source": "b", "schema_version": 1, "content_type": "image_caption", "more": "source"},
    ]
    df = chunks(spark, rows)
    assert {(r.point_id, r.text) for r in catalog.latest(df).collect()} == {("1", "u"), ("2", None), ("3", None)}
    listed = {r.source: r for r in catalog.source_list(df).collect()}
    assert listed["a"].n_chunks == 3 and listed["a"].vendor.strip() == "X" and listed["b"].vendor is None
    manifest = spark.createDataFrame([("a", 2), ("z", 1), (None, 5)], "source string, chunk_count int")
    assert {(r.source, r.status) for r in catalog.reconciled(df, manifest).collect()} == {("a", "drift"), ("b", "untracked"), ("z", "missing_in_store")}
    assert {(r.source, r.status) for r in catalog.backfill_plan(df, manifest).collect()} == {("a", "skipped_existing"), ("b", "skipped_other")}
    none = df.limit(0)
    for f in (catalog.latest, catalog.source_list, catalog.vendor_products, catalog.audit, catalog.vendor_counts, catalog.content_pivot, catalog.source_metadata, catalog.migrated, catalog.page_numbers_of_chunks):
        assert f(none).count() == 0
    assert catalog.without_sources(df, df.where("source = 'a'")).count() == 2
    new = chunks(spark, [{"point_id": "3", "source": "c"}, {"point_id": "9", "source": "c"}])
    assert {r.source for r in catalog.upserted(df.where("point_id is not null"), new).where("point_id in ('3', '9')").collect()} == {"c"}


def test_steps_without_the_preamble(spark):
    df = spark.createDataFrame([(1, "Head\n\n1. one\nmore\n2. two"), (2, "plain\n1. only"), (3, ""), (4, None), (5, "Step 1: a\nStep 2: b")], "doc_id bigint, text string")
    got = {(r.doc_id, r.part_no): r.text for r in chunking.steps(df).collect()}
    assert got == {(1, 0): "1. one\nmore", (1, 1): "2. two", (2, 0): "plain\n1. only", (5, 0): "Step 1: a", (5, 1): "Step 2: b"}


def test_markdown_sections(spark):
    df = spark.createDataFrame([(1, "lead\n# *One*\nbody\n```\n# no heading\n```\n![x](y)\n## Two ##"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {(r.section_no, r.heading): r.body for r in chunking.markdown_sections(df).collect()}
    assert got == {(0, None): "lead", (1, "One"): "body\n```\n# no heading\n```", (2, "Two"): ""}


CUES = "video_id string, cue_id bigint, start_seconds double, end_seconds double, text string"


def test_fresh_lines_across_parts(spark):
    cues = spark.createDataFrame([("v", 1, 299.0, 300.0, "a\nb"), ("v", 2, 301.0, 302.0, "B\nc"), ("v", 3, 302.0, None, None), ("v", 4, 303.0, 304.0, "c<i>!</i>\nC! more"), (None, 5, 1.0, 2.0, "x")], CUES)
    assert {(r.cue_id, tuple(r.lines)) for r in timed.fresh_lines(cues).collect()} == {(1, ("a", "b")), (2, ("c",)), (4, ("C! more",))}


def test_windows_do_not_depend_on_the_parts(spark):
    import random

    rng = random.Random(4)
    rows = [(v, i, float(i * 7), i * 7 + 5.0, " ".join(["word"] * rng.randrange(1, 30))) for v in ("v", "w") for i in range(90 if v == "v" else 3)]
    cues = timed.spoken_cues(spark.createDataFrame([r[:4] + (f"{r[4]} {r[1]}",) for r in rows], CUES))
    for windows in (timed.packed_windows, timed.span_windows):
        whole, parts = ({tuple(r) for r in windows(cues, part_rows=n).collect()} for n in (5000, 40))
        assert whole == parts and whole
    assert all(len(r.text) <= 1500 for r in timed.packed_windows(cues).collect()) and all(r.end - r.start <= 45 for r in timed.span_windows(cues).collect())
    assert timed.packed_windows(cues.limit(0)).count() == 0


def test_expected_sources_and_needles(spark):
    rows = chunks(spark, [{"point_id": "a", "source": "s", "content_type": "text", "text": "x"}, {"point_id": "b", "source": "t", "content_type": "image_caption", "text": "A Red Box"}, {"point_id": "c", "source": "u"}])
    hits = spark.createDataFrame([(1, "c", 1), (1, "a", 2), (1, "b", 6), (2, "b", 1), (3, "b", 1)], "qid bigint, point_id string, rank int")
    items = spark.createDataFrame([(1, ["s", "t"], "red "), (2, ["t"], "blue"), (3, [], ""), (4, ["s"], None), (5, None, None)], "qid bigint, expected array<string>, needle string")
    got = {r.qid: tuple(r)[1:] for r in evaluation.expected_metrics(hits, items, rows).collect()}
    assert got == {1: (1, 1, 0.5, 0, 1, 0, 1), 2: (1, 1, 1.0, 1, 1, 0, 0), 3: (0, 0, 0.0, 0, 0, 0, 0), 4: (0, 0, 0.0, 0, 0, 0, 0), 5: (0, 0, 0.0, 0, 0, 0, 0)}


def test_term_hashes_and_versions(spark):
    import zlib

    df = spark.createDataFrame([("héllo",), ("x_v2.10.3_y",), ("tool V19 notes",), ("manual_317_en",), ("plain",)], "t string")
    got = df.select("t", T.term_hash(F.col("t")), T.version_of_name(F.col("t"))).collect()
    assert [r[1] for r in got] == [zlib.crc32(r[0].encode()) for r in got]
    assert [r[2] for r in got] == ["", "2.10.3", "19", "3.17.0", ""]


def test_upserts_and_queues(spark):
    old, new = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, t string"), spark.createDataFrame([("b", 3, None), ("c", 4, "y")], "k string, n int, t string")
    assert {tuple(r) for r in catalog.upserted(old, new, "k").collect()} == {("a", 1, None), ("b", 3, None), ("c", 4, "y")}
    assert {tuple(r) for r in catalog.merged(old, new, "k").collect()} == {("a", 1, None), ("b", 3, "x"), ("c", 4, "y")}
    assert {tuple(r) for r in catalog.appended_new(old, new.unionByName(new), ["k"], "n").collect()} == {("a", 1, None), ("b", 2, "x"), ("c", 4, "y")}


def test_streams_in_any_number_of_batches(spark, tmp_path):
    from lodestrata.streaming import events

    rows = [(i, i % 7, "abc"[i % 3], float(i), (i * 7919) % 400000) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double, s bigint").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    df.repartition(4).write.parquet(str(tmp_path / "e"))
    windows, runs = ([{tuple(r) for r in f(spark, str(tmp_path / "e"), files_per_batch=n).collect()} for n in (None, 1)] for f in (events.event_windows, events.runs))
    assert windows[0] == windows[1] and runs[0] == runs[1] and sum(r[2] for r in windows[0]) == sum(r[2] for r in runs[0]) == 300


def test_clock(spark):
    df = spark.createDataFrame([("00:01:02.5",), ("01:02",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(timed.seconds_of_clock(F.col("c"))).collect()] == [62.5, 62.0, None, None]


def test_history_cuts_the_oldest(spark):
    rows = [("s", i, "user" if i % 2 else "assistant", "x" * 5, float(i)) for i in range(10)] + [("s", 99, "system", "y", 99.0), ("s", 98, "user", "", 98.0)]
    df = spark.createDataFrame(rows, "session_id string, id bigint, role string, content string, created_at double")
    got = {r.id: r.content for r in timed.recent_history(df, 4, 12).collect()}
    assert got == {9: "xxxxx", 8: "xxxxx", 7: "xx…"}


def test_gate_and_winners(spark):
    a = spark.createDataFrame([(1, 1, 1, 1.0, 2.0), (2, 0, 0, 0.0, None)], "qid bigint, recall_5 int, recall_10 int, rr double, top_score double")
    b = a.withColumn("recall_5", F.lit(0)).withColumn("rr", F.lit(0.5))
    assert {(r.winner, r.n) for r in evaluation.winners(a, b).collect()} == {("a", 1), ("b", 1)}
    assert evaluation.aggregated(a).first().mean_top == 2.0
    assert {r.metric for r in evaluation.regressions(evaluation.aggregated(b), evaluation.aggregated(a), 0.05).collect()} == {"recall_5"}


def test_term_search_by_matrix_and_by_joins(spark, monkeypatch):
    import random

    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(["Alpha", "beta", "x9", "gamma", "δelta-1", "the", "the"]) for _ in range(n))
    texts = [(f"p{i % 10}{i}", some(rng.randrange(9))) for i in range(400)] + [("none", None), ("blank", " \n"), ("odd", "BETAK;beta")] + [(f"same{i}", "omega omega") for i in range(30)]
    rows = spark.createDataFrame(texts, "point_id string, text string").repartition(5)
    asked = spark.createDataFrame([(1, "The beta, the ALPHA?"), (2, "omega"), (3, "unheard of"), (4, None), (5, ""), (6, "x9 gamma 1")], "qid bigint, question string")
    want = sorted(map(tuple, retrieval.term_search(asked, rows, 7, max_rows=-1).collect()))
    assert {r[0] for r in want} == {1, 2, 6} and [r[1] for r in want if r[0] == 2] == sorted(f"same{i}" for i in range(30))[:7]
    assert sorted(map(tuple, retrieval.term_search(asked, rows, 7).collect())) == want
    monkeypatch.setattr(retrieval, "MATRIX_CELLS", 60)
    assert sorted(map(tuple, retrieval.term_search(asked, rows, 7).collect())) == want
    text_qids = asked.withColumn("qid", F.concat("qid", F.lit("|0")))
    assert sorted((int(r[0].split("|")[0]), *r[1:]) for r in map(tuple, retrieval.term_search(text_qids, rows, 7).collect())) == want
    assert retrieval.term_search(asked.limit(0), rows, 7).count() == 0 and retrieval.term_search(asked, rows.limit(0), 7).count() == 0


def test_term_searches_like_one_search_a_kind(spark):
    texts = [(f"p{i:03}", (["one two", "two", "one one three", None, ""])[i % 5], ("a", "b", "c", None)[i % 4]) for i in range(100)]
    rows = spark.createDataFrame(texts, "point_id string, text string, kind string").repartition(3)
    asked = spark.createDataFrame([(1, "one"), (2, "two three"), (3, "four"), (4, None)], "qid bigint, question string")
    want = [sorted(map(tuple, retrieval.term_search(asked, rows.where(F.col("kind") == x), 4).collect())) for x in ("b", "a", "none")]
    assert want[0] and want[1] and want[0] != want[1] and not want[2]
    for most in (1000, -1):
        got = retrieval.term_searches(asked, rows, "kind", ["b", "a", "none"], 4, max_rows=most)
        assert [sorted(map(tuple, x.collect())) for x in got] == want


def test_latest_of_many_ids_stored_again(spark):
    stored = [(str(i % 40), f"t{i % 7}" if i % 11 else None, f"2025-{i % 3}" if i % 5 else None, i % 7) for i in range(97)] + [(None, "x", "2026", 1), ("alone", None, None, None)]
    df = spark.createDataFrame(stored, "point_id string, text string, ingested_at string, page int")
    rows = lambda most: sorted((r.point_id, r.ingested_at or "", r.text or "") for r in catalog.latest(df, most).collect())
    best = {}
    for i, text, at, _ in stored:
        if i is not None:
            best[i] = max(best.get(i, ("", "")), (at or "", text or ""))
    assert rows(0) == rows(1000) == sorted((i, *x) for i, x in best.items())

def test_term_vectors_like_the_column(spark):
    texts = [("a", "One two, TWO; three-3"), ("b", None), ("c", ""), ("d", " ?! "), ("e", "é x1" * 40), ("f", "9")]
    rows = spark.createDataFrame(texts, "point_id string, text string")
    got = {r.point_id: r.embedding for r in retrieval.term_vectors(rows).collect()}
    assert got == {r.point_id: r.v for r in rows.select("point_id", T.term_vector(F.col("text")).alias("v")).collect() if r.v and any(r.v)}
    assert set(got) == {"a", "e", "f"} and retrieval.term_vectors(rows.limit(0)).count() == 0
