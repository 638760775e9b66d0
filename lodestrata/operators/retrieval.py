"""Retrieval over whole batches of questions: vectors, terms, fusion, reranking, packing and citations.

Null texts have no terms and null vectors no hits; ties go to the smaller id; repeated rows are hits of their own; without
questions or rows results are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import BROADCAST_BYTES, BROADCAST_ROWS, checkpointed, join_checked, measured

#: Rows of a block of vectors on either side of a search.
BLOCK_ROWS = 4096
#: Cells of terms by questions, or of rows by either, up to which they are multiplied as one matrix.
MATRIX_CELLS = 1 << 22
#: Constant of reciprocal rank fusion.
FUSION_K = 60


def packed(vectors: DataFrame, id_col: str, vec_col: str, group: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """group, ids, matrix (row after row, as the bytes of its floats): vectors of each group in blocks of up to so many rows, packed where they lie, without a shuffle."""
    kind = "float32" if dict(vectors.dtypes)[vec_col] == "array<float>" else "float64"
    kinds = dict(vectors.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for g in table.column(group).unique():
                own = table.filter(pc.equal(table.column(group), g))
                for at in range(0, own.num_rows, rows):
                    piece = own.slice(at, rows).combine_chunks()
                    matrix = piece.column(vec_col).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
                    ids = piece.column(id_col).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([g.as_py()], type=batch.schema.field(group).type), pa.array([ids], type=pa.list_(batch.schema.field(id_col).type)), pa.array([matrix.tobytes()], type=pa.binary())], names=[group, "ids", "matrix"])

    return vectors.where(F.col(vec_col).isNotNull() & F.col(group).isNotNull()).select(group, id_col, vec_col).mapInArrow(run, f"{group} {kinds[group]}, ids array<{kinds[id_col]}>, matrix binary")


def nearest(queries: DataFrame, rows: DataFrame, k: int, qid: str = "qid", rid: str = "vec_id", vec: str = "embedding", group: str | None = None) -> DataFrame:
    """qid, rid, score, rank of the k rows with the greatest cosine (rounded to 9 digits) for each query, ties by rid.

    With group, only rows of the query's group. The stated queries meet all rows in blocks: blocks of rows stay where they
    were read, blocks of queries come to them (broadcast as far as their measured size allows, else both by a salted shuffle);
    a task multiplies block by block and keeps k a query over all its blocks, and a row number per query keeps k of all.
    """
    g = group or "_all"
    if not group:
        queries, rows = queries.withColumn(g, F.lit(0)), rows.withColumn(g, F.lit(0))
    kinds = dict(queries.dtypes)[qid], dict(rows.dtypes)[rid]
    types = ["float32" if dict(x.dtypes)[vec] == "array<float>" else "float64" for x in (queries, rows)]
    parts = max(1, -(-queries.count() // BLOCK_ROWS))
    asked = packed(queries.repartition(parts, g) if group else queries.repartition(parts), qid, vec, g).toDF(g, "qids", "qm")
    pairs = join_checked(packed(rows, rid, vec, g).toDF(g, "rids", "rm"), asked, [g], "inner", salt_by="rids")

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for qids, qm, rids, rm in zip(batch["qids"], batch["qm"], batch["rids"], batch["rm"], strict=True):
                a, b = (np.frombuffer(m, dtype=t).astype(np.float64).reshape(len(i), -1) for m, t, i in ((qm, types[0], qids), (rm, types[1], rids)))
                norm = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
                score = np.round(np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0), 9) + 0.0
                least = np.partition(score, -k, axis=1)[:, [-k]] if score.shape[1] > k else np.full((len(a), 1), -np.inf)
                row, at = np.nonzero(score >= least)
                found = (row, score[row, at], np.asarray(rids)[at])
                key = tuple(qids)
                best[key] = _first_of_rows(*(np.concatenate(x) for x in zip(best[key], found, strict=True)), k) if key in best else _first_of_rows(*found, k)
        for key, (row, score, ids) in best.items():
            yield pd.DataFrame({"qid": np.asarray(key)[row], "rid": ids, "score": score})

    hits = pairs.select("qids", "qm", "rids", "rm").mapInPandas(local, f"qid {kinds[0]}, rid {kinds[1]}, score double")
    return ranked(hits, "score", "rid", k).select(F.col("qid").alias(qid), F.col("rid").alias(rid), "score", "rank")


def _first_of_rows(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (row, score, id) the first k of each row by falling score, then id."""
    order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, row))
    row, score, ids = row[order], score[order], ids[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], score[kept], ids[kept]


def ranked(hits: DataFrame, score: str, tie: str, k: int | None = None, qid: str = "qid") -> DataFrame:
    """hits with rank (from 1) by falling score, ties by tie; with k, the first k of each question."""
    out = hits.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(score), tie)))
    return out.where(F.col("rank") <= k) if k else out


def filtered_with_fallback(queries: DataFrame, rows: DataFrame, k: int, label: str = "label") -> DataFrame:
    """qid, vec_id, score, rank, fallback: hits among rows with the query's label; questions without any take hits of all."""
    kept = checkpointed(nearest(queries, rows, k, group=label).withColumn("fallback", F.lit(False)))
    left = queries.join(kept.select("qid").distinct(), "qid", "left_anti").drop(label)
    return kept.unionByName(nearest(left, rows, k).withColumn("fallback", F.lit(True)))


def postings(rows: DataFrame, rid: str, text: str) -> DataFrame:
    """rid, term, tf."""
    return rows.select(rid, F.explode(T.terms(F.col(text))).alias("term")).groupBy(rid, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(posted: DataFrame, n_rows: int) -> DataFrame:
    """term, df, idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + (F.lit(float(n_rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def term_search(questions: DataFrame, rows: DataFrame, k: int, rid: str = "point_id", text: str = "text", n_rows: int | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """qid, rid, score, rank of the k rows with the greatest sum of tf of question, tf of row and idf (6 digits); rid is filled and unique in rows.

    The questions' terms are measured. Up to max_rows rows, BROADCAST_BYTES and MATRIX_CELLS they go to the rows, of which only
    the numbers of asked terms are written and only k a question and task are shuffled; beyond that postings meet them by joins.
    """
    return _searches(questions, rows, [], [F.lit(True)], k, rid, text, n_rows, max_rows)[0]


def term_searches(questions: DataFrame, rows: DataFrame, kind: str, kinds: list[str], k: int, rid: str = "point_id", text: str = "text", max_rows: int = BROADCAST_ROWS) -> list[DataFrame]:
    """term_search among the rows of each of the kinds apart (values of the column kind), whose texts are read once for all of them."""
    return _searches(questions, rows.where(F.col(kind).isin(kinds)), [kind], [F.col(kind) == x for x in kinds], k, rid, text, None, max_rows)


def _searches(questions: DataFrame, rows: DataFrame, kept: list[str], parts: list[Column], k: int, rid: str, text: str, n_rows: int | None, max_rows: int) -> list[DataFrame]:
    """term_search in each part of rows, a condition on the columns kept."""
    asked = checkpointed(postings(questions, "qid", "question").toDF("qid", "term", "qtf"))
    n, size = measured(asked)
    if n <= max_rows and size <= BROADCAST_BYTES:
        known = asked.toArrow()
        terms, qids = (pa.array(list(dict.fromkeys(known[c].to_pylist())), known.schema.field(c).type) for c in ("term", "qid"))
        if len(terms) * len(qids) <= MATRIX_CELLS:
            posted = checkpointed(_numbered_terms(rows, terms, rid, text, kept))
            return [ranked(_by_matrix(known, terms, qids, dict(asked.dtypes)["qid"], posted.where(x).select(rid, "terms", "tf"), k, rid, n_rows), "score", rid, k) for x in parts]
    found = join_checked(rows.select(rid, *kept, F.explode(T.terms(F.col(text))).alias("term")), asked.select("term").distinct(), ["term"], "left_semi", salt_by=rid)
    posted = checkpointed(found.groupBy(rid, *kept, "term").agg(F.count(F.lit(1)).alias("tf")))
    sizes = rows.agg(*[F.count_if(x) for x in parts]).first() if n_rows is None else [n_rows] * len(parts)
    out = []
    for x, size in zip(parts, sizes, strict=True):
        own = posted.where(x).select(rid, "term", "tf")
        weighed = join_checked(asked, idf(own, size), ["term"], "inner", salt_by="qid")
        scored = join_checked(own, weighed, ["term"], "inner", salt_by=rid).groupBy("qid", rid).agg(F.round(F.sum(F.col("qtf") * F.col("tf") * F.col("idf")), 6).alias("score"))
        out.append(ranked(scored, "score", rid, k))
    return out


def _by_matrix(asked: pa.Table, terms: pa.Array, qids: pa.Array, kind: str, posted: DataFrame, k: int, rid: str, n_rows: int | None) -> DataFrame:
    """qid (of that kind), rid, score: the k best rows a question and task; asked has qid, term, qtf, posted rid, terms, tf (see _numbered_terms)."""
    rare = {r.term: r.idf for r in idf(posted.select(F.explode("terms").alias("term")), posted.count() if n_rows is None else n_rows).collect()}
    weights = np.zeros((len(terms), len(qids)))
    at = [pc.index_in(asked[c], value_set=x).to_numpy() for c, x in (("term", terms), ("qid", qids))]
    weights[at[0], at[1]] = asked["qtf"].to_numpy()
    weights *= np.array([rare.get(i, 0.0) for i in range(len(terms))])[:, None]
    step = max(1, MATRIX_CELLS // max(1, *weights.shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.empty(0, int), np.empty(0), np.empty(0, object)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                ids, own, tf = batch.slice(start, step).columns
                counts = np.zeros((len(ids), len(terms)))
                counts[pc.list_parent_indices(own).to_numpy(), own.flatten().to_numpy()] = tf.flatten().to_numpy()
                raw = (counts @ weights).T
                score = np.where(raw != 0, np.round(raw, 6), -np.inf)
                least = np.partition(score, -k, axis=1)[:, [-k]] if score.shape[1] > k else np.full((len(score), 1), -np.inf)
                row, of = np.nonzero((score >= least) & (raw != 0))
                found = row, score[row, of], np.asarray(ids.to_pylist(), dtype=object)[of]
                best = _first_of_rows(*(np.concatenate(x) for x in zip(best, found, strict=True)), k)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(best[0])), pa.array(best[2], ids.type), pa.array(best[1])], names=["qid", rid, "score"])

    return posted.mapInArrow(run, f"qid {kind}, {rid} {dict(posted.dtypes)[rid]}, score double")


def _numbered_terms(rows: DataFrame, terms: pa.Array, rid: str, text: str, kept: list[str]) -> DataFrame:
    """rid, terms, tf and the columns kept of each row: the places of its terms in the given ones, each once, and how often it stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.ascii_split_whitespace(batch.column(1))
            code, row = (x.to_numpy(zero_copy_only=False) for x in (pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1), pc.list_parent_indices(words)))
            one, tf = np.unique(row[code >= 0] * len(terms) + code[code >= 0], return_counts=True)
            ends = pa.array(np.searchsorted(one, np.arange(batch.num_rows + 1) * len(terms)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (one % max(1, len(terms)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *batch.columns[2:]], names=[rid, "terms", "tf", *kept])

    kinds = dict(rows.dtypes)
    return _words(rows, rid, text, kept).mapInArrow(run, ", ".join([f"{rid} {kinds[rid]}, terms array<int>, tf array<int>", *[f"{c} {kinds[c]}" for c in kept]]))


def _words(rows: DataFrame, rid: str, text: str, kept: list[str] | None = None) -> DataFrame:
    """rid, words and the columns kept: the terms of each row as one string, blanks between them and perhaps around."""
    return rows.select(rid, F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " ").alias("words"), *(kept or []))


def term_vectors(rows: DataFrame, rid: str = "point_id", text: str = "text", size: int = 32) -> DataFrame:
    """rid, embedding: functions.text.term_vector of each row that has terms, with one digest a distinct term and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.ascii_split_whitespace(batch.column(1))
            coded = words.flatten().dictionary_encode()
            cells = np.array([hashlib.sha256(w.encode()).digest()[0] % size if w else -1 for w in coded.dictionary.to_pylist()], dtype=int)[coded.indices.to_numpy()]
            at = (pc.list_parent_indices(words).to_numpy() * size + cells)[cells >= 0]
            counts = np.bincount(at, minlength=batch.num_rows * size).reshape(-1, size).astype(float)
            kept = np.flatnonzero(counts.any(axis=1))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * size, pa.int32()), pa.array(counts[kept].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), vectors], names=[rid, "embedding"])

    return _words(rows, rid, text).mapInArrow(run, f"{rid} {dict(rows.dtypes)[rid]}, embedding array<double>")


def fused(lists: list[DataFrame], rid: str = "point_id", k: int = FUSION_K) -> DataFrame:
    """qid, rid, score, rank: reciprocal ranks summed over lists (8 digits), ties by rid."""
    rows = None
    for hits in lists:
        part = hits.select("qid", rid, "rank")
        rows = part if rows is None else rows.unionByName(part)
    return ranked(rows.groupBy("qid", rid).agg(F.round(F.sum(1 / (F.lit(k) + F.col("rank"))), 8).alias("score")), "score", rid)


def merged_kinds(texts: DataFrame, images: DataFrame, k: int, rid: str = "point_id") -> DataFrame:
    """qid, rid, score, rank: text and image hits fused, up to k; a question with hits of one kind only keeps these as they are."""
    both = texts.select("qid").distinct().join(images.select("qid").distinct(), "qid", "left_semi")
    single = texts.join(both, "qid", "left_anti").unionByName(images.join(both, "qid", "left_anti"))
    kept = fused([texts.join(both, "qid", "left_semi"), images.join(both, "qid", "left_semi")], rid)
    return single.select("qid", rid, "score", "rank").unionByName(kept.select("qid", rid, "score", "rank")).where(F.col("rank") <= k)


def fitting(hits: DataFrame, rows: DataFrame, budget: int, most: int = 5, rid: str = "point_id") -> DataFrame:
    """qid, n: how many of the first hits, up to most, fit a budget of estimated tokens; one at least."""
    return packed_context(hits, rows, budget, rid).where(F.col("rank") <= most).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))


def videos_first(cited_rows: DataFrame, is_video: Column, order: str = "n") -> DataFrame:
    """Citations numbered anew: those of videos first, the order otherwise kept."""
    n = F.row_number().over(Window.partitionBy("qid").orderBy(F.when(is_video, 0).otherwise(1), order))
    return cited_rows.withColumn("position", n)


def above_floor(hits: DataFrame, floor: float) -> DataFrame:
    """Hits with the score or more; a question with none keeps its first; a floor of 0 or less keeps all."""
    if floor <= 0:
        return hits
    best = hits.withColumn("_best", F.max("score").over(Window.partitionBy("qid")))
    return best.where((F.col("score") >= floor) | ((F.col("_best") < floor) & (F.col("rank") == 1))).drop("_best")


def reranked(hits: DataFrame, questions: DataFrame, rows: DataFrame, n: int, rid: str = "point_id", chars: int = 512) -> DataFrame:
    """qid, rid, score, rank: hits by the Jaccard similarity of question and the first characters, ties by the rank before."""
    texts = rows.select(rid, T.terms(F.substring("text", 1, chars)).alias("t")).join(hits.select(rid).distinct(), rid, "left_semi")
    asked = questions.select("qid", T.terms(F.col("question")).alias("q"))
    scored = hits.select("qid", rid, F.col("rank").alias("before")).join(texts, rid).join(asked, "qid").select("qid", rid, "before", F.round(T.jaccard(F.array_distinct("q"), F.array_distinct("t")), 6).alias("score"))
    return ranked(scored, "score", "before", n).select("qid", rid, "score", "rank")


def packed_context(hits: DataFrame, rows: DataFrame, budget: int, rid: str = "point_id", chars: int = 1000) -> DataFrame:
    """qid, rid, rank, cost, spent of the longest run of hits whose estimated tokens fit the budget; one at least."""
    body = rows.select(rid, (T.token_estimate(T.body(F.col("text"), chars)) + 2).cast("bigint").alias("cost")).join(hits.select(rid).distinct(), rid, "left_semi")
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.join(body, rid).withColumn("spent", F.sum("cost").over(order)).where((F.col("spent") <= budget) | (F.col("rank") == 1)).select("qid", rid, "rank", "cost", "spent")


def cited(hits: DataFrame, rows: DataFrame, rid: str = "point_id") -> DataFrame:
    """qid, n, label: citations in order of rank, each source and page once."""
    about = join_checked(rows.select(rid, "source", "page"), hits.select(rid).distinct(), [rid], "left_semi", salt_by=rid)
    first = hits.join(about, rid).groupBy("qid", "source", "page").agg(F.min("rank").alias("rank"))
    n = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    label: Column = F.concat("source", F.coalesce(F.concat(F.lit(" p."), (F.col("page") + 1).cast("string")), F.lit("")))
    return first.select("qid", n.alias("n"), label.alias("label"))
