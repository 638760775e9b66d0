"""Queries of batch retrieval, evaluation and caching, with their SQL.

Questions are the golden items (a fixed table) against all chunks; vectors are searched for every row whose id is divisible
by 50, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..session import checkpointed, join_checked, table

K, VECTOR_K = 20, 10


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "question", F.lower(F.trim("vendor")).alias("wanted"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """The stored chunks, once a point_id; never written, for their texts take a multiple of the table's bytes: each step of a query reads the columns that it needs."""
    return C.latest(table(spark, d, "chunks").select("point_id", "text", "source", "page", "vendor", "content_type", "ingested_at"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings")
    return rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid"), rows


def _term_hits(spark: SparkSession, d: str, rows: DataFrame | None = None, k: int = K) -> DataFrame:
    return checkpointed(R.term_search(_questions(spark, d), _chunks(spark, d) if rows is None else rows, k))


def _hash_hits(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    """Hits by the reference's stand-in for embeddings, bytes of a digest."""
    q = _questions(spark, d).select("qid", T.hash_vector(F.col("question")).alias("embedding"))
    rows = _chunks(spark, d).where("text is not null").select("point_id", T.hash_vector(F.col("text")).alias("embedding"))
    return R.nearest(q, rows, k, rid="point_id")


def _dense_hits(spark: SparkSession, d: str, rows: DataFrame, k: int = K) -> DataFrame:
    """Hits by vectors of hashed terms of questions and texts."""
    return checkpointed(R.nearest(R.term_vectors(_questions(spark, d), "qid", "question"), R.term_vectors(rows), k, rid="point_id"))


def t1_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    q, rows = _vectors(spark, d)
    return R.nearest(q, rows, VECTOR_K)


def r7_filtered_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Search among rows of the query's label; a label that no row has (here that of every fifth query) falls back to all."""
    q, rows = _vectors(spark, d)
    asked = q.withColumn("label", F.when(F.col("qid") % 250 == 0, F.lit(-1).cast("int")).otherwise(F.col("label")).cast(dict(rows.dtypes)["label"]))
    return R.filtered_with_fallback(asked, rows, VECTOR_K)


def t2_sharded_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best of each label (shard), then the best of all shards."""
    q, rows = _vectors(spark, d)
    kind = dict(rows.dtypes)["label"]
    labels = rows.select("label").where("label is not null").distinct().withColumn("_all", F.lit(1))
    spread = join_checked(q.select("qid", "embedding").withColumn("_all", F.lit(1)), labels, ["_all"], "inner", salt_by="qid").select("qid", "embedding", F.col("label").cast(kind).alias("label"))
    local = R.nearest(spread.select(F.concat_ws("|", "qid", "label").alias("qid"), "embedding", "label"), rows, VECTOR_K, group="label")
    merged = local.select(F.split("qid", "[|]")[0].cast("bigint").alias("qid"), "vec_id", "score")
    return R.ranked(merged, "score", "vec_id", VECTOR_K)


def j9_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The most similar earlier vector of each asked one, where the cosine is 0.2 or more."""
    q, rows = _vectors(spark, d)
    hits = R.nearest(q, rows, 2).where("vec_id != qid and score >= 0.2")
    return R.ranked(hits.drop("rank"), "score", "vec_id", 1).select("qid", "vec_id", "score")


def a17_idf(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    return R.idf(R.postings(rows, "point_id", "text"), rows.count()).select("term", "df", F.round("idf", 6).alias("idf"))


def j2_term_search(spark: SparkSession, d: str) -> DataFrame:
    return _term_hits(spark, d)


def r1_hash_search(spark: SparkSession, d: str) -> DataFrame:
    return _hash_hits(spark, d)


def r2_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Dense and term hits fused; a row keeps its score by vectors, one that only the terms found has none."""
    rows = _chunks(spark, d)
    dense = _dense_hits(spark, d, rows)
    fused = R.fused([dense, _term_hits(spark, d, rows)])
    return fused.join(dense.select("qid", "point_id", F.col("score").alias("vector_score")), ["qid", "point_id"], "left").select("qid", "point_id", "score", "rank", "vector_score")


def r4_supplements(spark: SparkSession, d: str) -> DataFrame:
    """Hits among all chunks, transcripts and captions, searched apart and fused."""
    rows, q = _chunks(spark, d), _questions(spark, d)
    parts = [rows, rows.where("content_type = 'video_transcript'"), rows.where("content_type = 'image_caption'")]
    return R.fused([R.term_search(q, p, K) for p in parts])


def r5_text_and_images(spark: SparkSession, d: str) -> DataFrame:
    """Text and caption hits fused; a question with hits of one kind keeps these."""
    texts, images = map(checkpointed, R.term_searches(_questions(spark, d), _chunks(spark, d), "content_type", ["text", "image_caption"], K))
    return R.merged_kinds(texts, images, 10)


def r3_map_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Questions split into parts, searched, and the best score of each chunk kept."""
    parts = _questions(spark, d).select("qid", F.posexplode(F.split("question", r"(?i)\s+(?:and|;)\s+")).alias("i", "question")).where("trim(question) != ''")
    hits = R.term_search(parts.select(F.concat_ws("|", "qid", "i").alias("qid"), "question"), _chunks(spark, d), K)
    return hits.select(F.split("qid", "[|]")[0].cast("bigint").alias("qid"), "point_id", "score").groupBy("qid", "point_id").agg(F.max("score").alias("score"))


def t4_rerank(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    return R.reranked(_term_hits(spark, d, rows), _questions(spark, d), rows, 5)


def f6_score_floor(spark: SparkSession, d: str) -> DataFrame:
    return R.above_floor(_term_hits(spark, d), 30.0).select("qid", "point_id", "score", "rank")


def w3_context(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    return R.packed_context(_term_hits(spark, d, rows), rows, 1200)


def w4_rerank_size(spark: SparkSession, d: str) -> DataFrame:
    """How many of the first five hits of each question fit the budget."""
    rows = _chunks(spark, d)
    return R.fitting(_term_hits(spark, d, rows), rows, 120)


def r14_citations(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    return R.cited(_term_hits(spark, d, rows), rows)


def w16_videos_first(spark: SparkSession, d: str) -> DataFrame:
    """Citations with those of transcripts first, the order otherwise kept."""
    rows = _chunks(spark, d)
    hits = _term_hits(spark, d, rows).join(rows.select("point_id", "source", "content_type"), "point_id")
    return R.videos_first(hits, F.col("content_type") == "video_transcript", "rank").select("qid", "point_id", "position")


def t7_video_supplement(spark: SparkSession, d: str) -> DataFrame:
    """At most 30 transcript hits a question, the cap of the supplement."""
    rows = _chunks(spark, d).where("content_type = 'video_transcript'")
    return R.term_search(_questions(spark, d), rows, min(50, 30))


def v12_top_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the first hit of each question: page 0 for none, null for what is empty."""
    rows = _chunks(spark, d)
    first = _term_hits(spark, d, rows).where("rank = 1")
    return join_checked(rows.drop("text", "ingested_at"), first, ["point_id"], salt_by="point_id").select("qid", "source", F.coalesce("page", F.lit(0)).alias("page"), T.normalised(F.col("vendor")).alias("vendor"), F.nullif("content_type", F.lit("")).alias("content_type"), "score")


def j10_expected_sources(spark: SparkSession, d: str) -> DataFrame:
    """Recall, reciprocal rank and caption recalls of each golden item by its expected sources."""
    rows = _chunks(spark, d)
    items = table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), F.col("expected_sources").alias("expected"), F.element_at("tags", 1).alias("needle"))
    return E.expected_metrics(_term_hits(spark, d, rows), items, rows)


def a14_bake_off(spark: SparkSession, d: str) -> DataFrame:
    """Term search, term vectors and their fusion on the same items, by mean metrics."""
    rows, q = _chunks(spark, d), _questions(spark, d)
    terms, dense = _term_hits(spark, d, rows), _dense_hits(spark, d, rows)
    arms = {"terms": terms, "vectors": dense, "fused": R.fused([dense, terms])}
    runs = None
    for model, hits in arms.items():
        one = E.item_metrics(hits, q, rows).withColumn("model", F.lit(model))
        runs = one if runs is None else runs.unionByName(one)
    return E.bake_off(runs)


def a12_score_stats(spark: SparkSession, d: str) -> DataFrame:
    """The first and the mean score of each question."""
    return _term_hits(spark, d).groupBy("qid").agg(F.min_by("score", "rank").alias("top"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("mean"))


def r10_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 5 and 10 and the reciprocal rank of each golden item, a hit being a chunk of its vendor."""
    rows = _chunks(spark, d)
    return E.item_metrics(_term_hits(spark, d, rows), _questions(spark, d), rows)


def a9_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return E.aggregated(r10_evaluation(spark, d))


def a25_gate(spark: SparkSession, d: str) -> DataFrame:
    """Metrics in which term vectors fall behind term search by more than 0.05."""
    q, rows = _questions(spark, d), _chunks(spark, d)
    base = E.aggregated(E.item_metrics(_term_hits(spark, d, rows), q, rows))
    return E.regressions(E.aggregated(E.item_metrics(_dense_hits(spark, d, rows), q, rows)), base, 0.05)


def r11_ab(spark: SparkSession, d: str) -> DataFrame:
    """Items won by term search (a) and by term vectors (b): by recall at 5, then reciprocal rank, ties to a."""
    q, rows = _questions(spark, d), _chunks(spark, d)
    a, b = E.item_metrics(_term_hits(spark, d, rows), q, rows), E.item_metrics(_dense_hits(spark, d, rows), q, rows)
    return E.winners(a, b)


def a13_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Share of positive ratings and their mean by vendor-free rating rule: only -1 and 1 are valid."""
    valid = table(spark, d, "feedback").where(F.col("rating").isin(-1, 1))
    day = F.date_format("received_at", "yyyy-MM")
    return valid.groupBy(day.alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("rating") > 0).cast("double")), 6).alias("pass_rate"), F.round(F.avg("rating"), 6).alias("mean"))


def a19_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feedback").groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def p26_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Questions of the production sample: by digest, the same at any time."""
    return table(spark, d, "feedback").where(F.col("question").isNotNull() & T.in_sample(F.col("question"), 0.05)).select("feedback_id", F.substring(F.trim("question"), 1, 240).alias("question"))


def w18_cache_cap(spark: SparkSession, d: str) -> DataFrame:
    """The newest 200 entries of a cache of answers; the cap is the cache's."""
    return table(spark, d, "feedback").where("question is not null and answer is not null").orderBy(F.desc("received_at"), F.desc("feedback_id")).limit(200).select("feedback_id", "question")


def j15_vendor_inference(spark: SparkSession, d: str) -> DataFrame:
    """Vendors whose alias, squeezed to letters and digits, the squeezed question contains; the scope is set by exactly one."""
    squeezed = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    alias = table(spark, d, "vendors").select("vendor", F.explode("aliases").alias("alias")).select("vendor", squeezed(F.col("alias")).alias("alias")).where("alias != ''").distinct()
    known = alias.agg(F.array_sort(F.collect_list(F.struct("vendor", "alias"))).alias("known"))
    asked = table(spark, d, "feedback").where("question is not null").select("feedback_id", squeezed(F.col("question")).alias("q"))
    found = F.array_sort(F.array_distinct(F.transform(F.filter("known", lambda k: F.contains(F.col("q"), k["alias"])), lambda k: k["vendor"])))
    return asked.join(F.broadcast(known)).select("feedback_id", F.array_join(found, ",").alias("vendors"), F.when(F.size(found) == 1, found[0]).alias("scope"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and k.split("_")[0][-1:].isdigit() and getattr(f, "__module__", "") == __name__}


_LATEST = "latest as (select * from (select *, row_number() over (partition by point_id order by coalesce(ingested_at, '') desc, coalesce(text, '') desc) as rn from chunks where point_id is not null) where rn = 1)"
_TERMS = f"""{_LATEST}, qs as (select item_id as qid, question, lower(trim(vendor)) as wanted from eval_items),
qt as (select qid, term, count(*) as qtf from (select qid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from qs) group by 1, 2),
ct as (select point_id, term, count(*) as tf from (select point_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from latest) group by 1, 2),
idf as (select term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from (select term, cast(count(*) as double) as df from ct group by 1), (select cast(count(*) as double) as n from latest)),
scored as (select qid, point_id, round(sum(qtf * tf * idf), 6) as score from qt join ct using (term) join idf using (term) group by 1, 2),
th as (select * from (select *, row_number() over (partition by qid order by score desc, point_id) as rank from scored) where rank <= {K})"""
_HASH = f"""{_LATEST}, hv as (select point_id, list_transform(range(32), lambda i: cast(('0x' || substr(sha256(text), i * 2 + 1, 2)) as integer) / 255.0::double) as v from latest where text is not null),
qv as (select item_id as qid, list_transform(range(32), lambda i: cast(('0x' || substr(sha256(question), i * 2 + 1, 2)) as integer) / 255.0::double) as v from eval_items where question is not null),
hh as (select * from (select qid, point_id, score, row_number() over (partition by qid order by score desc, point_id) as rank from (select qid, point_id, round(list_cosine_similarity(qv.v, hv.v), 9) as score from qv, hv)) where rank <= {K})"""
_DENSE = f"""dv as (select point_id, list_transform(range(32), lambda i: cast(len(list_filter(b, lambda x: x = i)) as double)) as v from (select point_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: cast('0x' || substr(sha256(t), 1, 2) as integer) % 32) as b from latest where regexp_matches(lower(text), '[a-z0-9]'))),
dq as (select qid, list_transform(range(32), lambda i: cast(len(list_filter(b, lambda x: x = i)) as double)) as v from (select item_id as qid, list_transform(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda t: cast('0x' || substr(sha256(t), 1, 2) as integer) % 32) as b from eval_items where regexp_matches(lower(question), '[a-z0-9]'))),
dh as (select * from (select qid, point_id, score, row_number() over (partition by qid order by score desc, point_id) as rank from (select qid, point_id, round(list_cosine_similarity(dq.v, dv.v), 9) as score from dq, dv)) where rank <= {K})"""


def _term_sql(name: str, rows: str, questions: str, k: int = K) -> str:
    """Term search of a table of questions (qid, question) over a part of the chunks, as common table expressions that end in name."""
    return f"""{name}_r as ({rows}), {name}_qt as (select qid, term, count(*) as qtf from (select qid, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) as term from ({questions})) group by 1, 2),
{name}_ct as (select point_id, term, count(*) as tf from (select point_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from {name}_r) group by 1, 2),
{name}_i as (select term, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf from (select term, cast(count(*) as double) as df from {name}_ct group by 1), (select cast(count(*) as double) as n from {name}_r)),
{name} as (select * from (select *, row_number() over (partition by qid order by score desc, point_id) as rank from (select qid, point_id, round(sum(qtf * tf * idf), 6) as score from {name}_qt join {name}_ct using (term) join {name}_i using (term) group by 1, 2)) where rank <= {k})"""


_Q = "select item_id as qid, question from eval_items"
_VECTORS = "s as (select q.vec_id as qid, q.label as wanted, e.vec_id, e.label, round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 9) as score from embeddings q, embeddings e where q.vec_id % 50 = 0)"


def _metrics(hits: str, name: str) -> str:
    return f"""{name} as (select qid, wanted, cast(coalesce(bool_or(hit and rank <= 5), false) as integer) as recall_5, cast(coalesce(bool_or(hit and rank <= 10), false) as integer) as recall_10, coalesce(round(1.0 / min(rank) filter (where hit), 6), 0.0) as rr, max(score) as top_score
from (select q.qid, q.wanted, h.rank, h.score, lower(trim(l.vendor)) = q.wanted as hit from (select item_id as qid, lower(trim(vendor)) as wanted from eval_items) q left join {hits} h using (qid) left join latest l using (point_id)) group by 1, 2)"""


def _aggregate(name: str) -> str:
    return f"select count(*) as n, round(avg(recall_5), 6) as recall_5, round(avg(recall_10), 6) as recall_10, round(avg(rr), 6) as mrr, round(avg(top_score), 6) as mean_top from {name}"


def oracle_sql() -> dict[str, str]:
    fuse = "select qid, point_id, score, row_number() over (partition by qid order by score desc, point_id) as rank from (select qid, point_id, round(sum(1.0::double / (60 + rank)), 8) as score from ({0}) group by 1, 2)"
    cost = "(case when length(p) = 0 then 0 else greatest(1, length(p) // 4) end + 2)"
    both = f"with {_TERMS}, {_DENSE}, {_metrics('th', 'ma')}, {_metrics('dh', 'mb')}"
    kinds = {k: f"select point_id, text from latest where content_type = '{k}'" for k in ("text", "video_transcript", "image_caption")}
    three = ", ".join([_term_sql("ha", "select point_id, text from latest", _Q), _term_sql("hb", kinds["video_transcript"], _Q), _term_sql("hc", kinds["image_caption"], _Q)])
    split = "select qid || '|' || i as qid, part as question from (select qid, unnest(range(len(p))) as i, unnest(p) as part from (select item_id as qid, regexp_split_to_array(question, '(?i)\\s+(?:and|;)\\s+') as p from eval_items where question is not null)) where trim(part, ' ') <> ''"
    expected = "select e.item_id as qid, th.rank, coalesce(list_contains(e.expected_sources, l.source), false) as hit, coalesce(l.content_type = 'image_caption', false) as cap, contains(lower(coalesce(l.text, '')), lower(trim(coalesce(e.tags[1], '')))) as needle from eval_items e left join th on th.qid = e.item_id left join latest l using (point_id)"
    within = lambda what, k, name: f"cast(coalesce(bool_or({what} and rank <= {k}), false) as integer) as {name}"
    return {
        "t1_vector_topk": f"with {_VECTORS} select qid, vec_id, score, rank from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from s) where rank <= {VECTOR_K}",
        "t2_sharded_topk": f"with {_VECTORS} select qid, vec_id, score, rank from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from s) where rank <= {VECTOR_K}",
        "r7_filtered_fallback": f"with {_VECTORS} select qid, vec_id, score, rank, qid % 250 = 0 as fallback from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from s where qid % 250 = 0 or label = wanted) where rank <= {VECTOR_K}",
        "j9_cache_lookup": f"with {_VECTORS}, two as (select * from (select *, row_number() over (partition by qid order by score desc, vec_id) as rank from s) where rank <= 2) select qid, vec_id, score from (select *, row_number() over (partition by qid order by score desc, vec_id) as n from two where vec_id <> qid and score >= 0.2) where n = 1",
        "a17_idf": f"with {_TERMS} select term, cast(df as bigint) as df, round(idf, 6) as idf from idf",
        "j2_term_search": f"with {_TERMS} select qid, point_id, score, rank from th",
        "r1_hash_search": f"with {_HASH} select qid, point_id, score, rank from hh",
        "r2_hybrid": f"with {_TERMS}, {_DENSE}, f as (" + fuse.format("select qid, point_id, rank from th union all select qid, point_id, rank from dh") + ") select f.*, dh.score as vector_score from f left join dh using (qid, point_id)",
        "r4_supplements": f"with {_LATEST}, {three} " + fuse.format("select qid, point_id, rank from ha union all select qid, point_id, rank from hb union all select qid, point_id, rank from hc"),
        "r5_text_and_images": f"with {_LATEST}, {_term_sql('ha', kinds['text'], _Q)}, {_term_sql('hb', kinds['image_caption'], _Q)}, b as (select distinct qid from ha where qid in (select qid from hb)), f as (" + fuse.format("select qid, point_id, rank from ha where qid in (select qid from b) union all select qid, point_id, rank from hb where qid in (select qid from b)") + ") select * from (select qid, point_id, score, rank from ha where qid not in (select qid from b) union all select qid, point_id, score, rank from hb where qid not in (select qid from b) union all select qid, point_id, score, rank from f) where rank <= 10",
        "r3_map_reduce": f"with {_LATEST}, {_term_sql('ha', 'select point_id, text from latest', split)} select cast(string_split(qid, '|')[1] as bigint) as qid, point_id, max(score) as score from ha group by 1, 2",
        "t7_video_supplement": f"with {_LATEST}, {_term_sql('ha', kinds['video_transcript'], _Q, 30)} select qid, point_id, score, rank from ha",
        "w4_rerank_size": f"with {_TERMS}, b as (select th.qid, th.point_id, th.rank, cast({cost} as bigint) as cost from (select point_id, case when length(text) > 1000 then substr(text, 1, 1000) || '…' else coalesce(text, '') end as p from latest) join th using (point_id)) select qid, count(*) as n from (select *, sum(cost) over (partition by qid order by rank) as spent from b) where (spent <= 120 or rank = 1) and rank <= 5 group by 1",
        "w16_videos_first": f"with {_TERMS} select qid, point_id, row_number() over (partition by qid order by case when coalesce(content_type = 'video_transcript', false) then 0 else 1 end, rank) as position from th join latest using (point_id)",
        "v12_top_facts": f"with {_TERMS} select qid, source, coalesce(page, 0) as page, nullif(lower(trim(vendor)), '') as vendor, nullif(content_type, '') as content_type, score from th join latest using (point_id) where rank = 1",
        "j10_expected_sources": f"with {_TERMS}, x as ({expected}) select qid, {within('hit', 5, 'recall_5')}, {within('hit', 10, 'recall_10')}, coalesce(round(1.0 / min(rank) filter (where hit), 6), 0.0) as rr, {within('hit and cap', 5, 'caption_5')}, {within('hit and cap', 10, 'caption_10')}, {within('hit and cap and needle', 5, 'strict_5')}, {within('hit and cap and needle', 10, 'strict_10')} from x group by 1",
        "a14_bake_off": f"{both}, fu as (" + fuse.format("select qid, point_id, rank from th union all select qid, point_id, rank from dh") + f"), {_metrics('fu', 'mc')} select model, count(*) as n, round(avg(recall_5), 6) as recall_5, round(avg(recall_10), 6) as recall_10, round(avg(rr), 6) as rr from (select 'terms' as model, * from ma union all select 'vectors', * from mb union all select 'fused', * from mc) group by 1",
        "a25_gate": f"{both}, a as ({_aggregate('ma')}), b as ({_aggregate('mb')}) select * from (select unnest(['recall_5', 'recall_10', 'mrr']) as metric, unnest([a.recall_5, a.recall_10, a.mrr]) as base, unnest([b.recall_5, b.recall_10, b.mrr]) as current from a, b) where current < base - 0.05",
        "t4_rerank": f"with {_TERMS}, j as (select qid, point_id, rank as before, round(case when len(list_distinct(a || b)) = 0 then 0 else len(list_intersect(a, b)) / len(list_distinct(a || b)) end, 6) as score from (select th.*, list_distinct(regexp_extract_all(lower(qs.question), '[a-z0-9]+')) as a, list_distinct(regexp_extract_all(lower(substr(l.text, 1, 512)), '[a-z0-9]+')) as b from th join qs using (qid) join latest l using (point_id))) select qid, point_id, score, rank from (select *, row_number() over (partition by qid order by score desc, before) as rank from j) where rank <= 5",
        "f6_score_floor": f"with {_TERMS} select qid, point_id, score, rank from (select *, max(score) over (partition by qid) as best from th) where score >= 30 or (best < 30 and rank = 1)",
        "w3_context": f"with {_TERMS}, b as (select th.qid, th.point_id, th.rank, cast({cost} as bigint) as cost from (select point_id, case when length(text) > 1000 then substr(text, 1, 1000) || '…' else coalesce(text, '') end as p from latest) join th using (point_id)) select * from (select *, cast(sum(cost) over (partition by qid order by rank) as bigint) as spent from b) where spent <= 1200 or rank = 1",
        "r14_citations": f"with {_TERMS}, f as (select qid, source, page, min(rank) as rank from th join latest using (point_id) group by 1, 2, 3) select qid, row_number() over (partition by qid order by rank) as n, source || coalesce(' p.' || (page + 1), '') as label from f",
        "a12_score_stats": f"with {_TERMS} select qid, arg_min(score, rank) as top, round(avg(score), 6) as mean from th group by 1",
        "r10_evaluation": f"with {_TERMS}, {_metrics('th', 'ma')} select * from ma",
        "a9_aggregate": f"with {_TERMS}, {_metrics('th', 'ma')} {_aggregate('ma')}",
        "r11_ab": f"{both} select winner, count(*) as n from (select case when b.recall_5 > a.recall_5 or (b.recall_5 = a.recall_5 and b.rr > a.rr) then 'b' else 'a' end as winner from ma a join mb b using (qid)) group by 1",
        "a13_feedback": "select strftime(received_at, '%Y-%m') as month, count(*) as n, round(avg(case when rating > 0 then 1.0::double else 0.0::double end), 6) as pass_rate, round(avg(rating), 6) as mean from feedback where rating in (-1, 1) group by 1",
        "a19_outcomes": "select rating, count(*) as n from feedback group by 1",
        "p26_sampling": "select feedback_id, substr(trim(question), 1, 240) as question from feedback where question is not null and cast('0x' || substr(sha256(question), 1, 8) as bigint) / 4294967295.0::double < 0.05",
        "w18_cache_cap": "select feedback_id, question from feedback where question is not null and answer is not null order by received_at desc, feedback_id desc limit 200",
        "j15_vendor_inference": "with a as (select distinct vendor, regexp_replace(lower(alias), '[^a-z0-9]', '', 'g') as alias from (select vendor, unnest(aliases) as alias from vendors)), q as (select feedback_id, regexp_replace(lower(question), '[^a-z0-9]', '', 'g') as q from feedback where question is not null), m as (select distinct feedback_id, vendor from q, a where alias <> '' and contains(q, alias)) select q.feedback_id, coalesce(string_agg(vendor, ',' order by vendor), '') as vendors, case when count(vendor) = 1 then min(vendor) end as scope from q left join m using (feedback_id) group by 1",
    }
