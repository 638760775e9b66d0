"""The chunk store as DataFrames: keyed writes, listings, audits, reconciliation and migration.

Nulls: a null source or key never matches; a first value is the first that isn't empty by point_id; repeated rows count once
where a point_id is a key and each where rows are counted; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import BROADCAST_BYTES, BROADCAST_ROWS, before, checkpointed, join_checked, measured, numbered


def latest(chunks: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Keyed upsert: of rows stored under one point_id the one stored last stays (then the greatest text).

    Ids stored again are found from the key column alone. Up to max_rows and BROADCAST_BYTES of them only their rows are
    shuffled with all columns, the others stay where they are; beyond that all rows are shuffled, each once.
    """
    rest = [c for c in chunks.columns if c != "point_id"]
    rows = chunks.where("point_id is not null")
    again = checkpointed(rows.groupBy("point_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("point_id", F.lit(True).alias("_again")))
    newest = F.max_by(F.struct(*rest), F.struct(F.coalesce("ingested_at", F.lit("")), F.coalesce("text", F.lit(""))))
    one = lambda stored: stored.groupBy("point_id").agg(newest.alias("r")).select("point_id", *[F.col(f"r.{c}") for c in rest])
    n, size = measured(again)
    if n > max_rows or size > BROADCAST_BYTES:
        return one(rows)
    marked = rows.join(F.broadcast(again), ["point_id"], "left")
    return marked.where("_again is null").select("point_id", *rest).unionByName(one(marked.where("_again")))


def upserted(stored: DataFrame, incoming: DataFrame, key: str = "point_id") -> DataFrame:
    """stored with the rows of incoming in the place of those with the same key; keys of incoming must be unique."""
    return join_checked(stored, incoming.select(key), [key], "left_anti", salt_by=key).unionByName(incoming)


def merged(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """stored with each column of incoming in the place of its own where that is filled: insert or update by key, once a key on both sides."""
    rest = [c for c in stored.columns if c != key]
    both = stored.alias("s").join(incoming.alias("i"), key, "full_outer")
    return both.select(key, *[F.coalesce(F.col(f"i.{c}"), F.col(f"s.{c}")).alias(c) for c in rest])


def appended_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A queue with what is new in incoming, once a key, the first by order; what exists wins."""
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in existing.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
    return existing.unionByName(join_checked(first, existing.select(*keys).distinct(), keys, "left_anti", salt_by=keys[0]))


def without_sources(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks but those of the given sources (delete, and the purge before a new write)."""
    return join_checked(chunks, sources.select("source").distinct(), ["source"], "left_anti", salt_by="point_id")


def first_filled(column: str, order: str = "point_id") -> Column:
    """The first value that isn't null or blank, by order."""
    filled = F.nullif(F.trim(column), F.lit(""))
    return F.min_by(column, F.when(filled.isNotNull(), F.struct(order, F.col(column))))


def source_list(chunks: DataFrame) -> DataFrame:
    """source, n_chunks and the first filled vendor, product, doc_type and ingested_at of each source."""
    return chunks.where("source is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"), *[first_filled(c).alias(c) for c in ("vendor", "product", "doc_type", "ingested_at")]
    )


def vendor_products(chunks: DataFrame) -> DataFrame:
    """vendor and its sorted distinct products; a vendor without products keeps an empty list."""
    rows = chunks.select(T.normalised(F.col("vendor")).alias("vendor"), T.normalised(F.col("product")).alias("product")).where("vendor is not null").distinct()
    return rows.groupBy("vendor").agg(F.array_sort(F.collect_set("product")).alias("products"))


def last_filled(value: Column, order: str = "point_id") -> Column:
    """The last value that isn't null or blank, by order."""
    filled = F.nullif(F.trim(value), F.lit(""))
    return F.max_by(value, F.when(filled.isNotNull(), F.struct(order, value)))


def audit(chunks: DataFrame, version: int = 2) -> DataFrame:
    """Per source: chunks, last filled vendor, first filled doc_type and product, distinct sections, any url, newest time, rows of another schema version."""
    return chunks.where("source is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"),
        last_filled(F.lower(F.trim("vendor"))).alias("vendor"),
        first_filled("doc_type").alias("doc_type"),
        first_filled("product").alias("product"),
        F.count_distinct(F.nullif("section", F.lit(""))).alias("n_sections"),
        F.bool_or(F.coalesce(F.col("url") != "", F.lit(False))).alias("has_url"),
        F.max(F.nullif("ingested_at", F.lit(""))).alias("newest"),
        F.count_if(F.coalesce(F.col("schema_version") != version, F.lit(True))).alias("n_old"),
    )


def audit_lines(chunks: DataFrame) -> DataFrame:
    """The audit as a report shows it: - for what is empty, yes or no for urls."""
    shown = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("-"))
    return audit(chunks).select("source", F.col("n_chunks").cast("string").alias("n_chunks"), *[shown(c).alias(c) for c in ("vendor", "doc_type", "product", "newest")], F.when(F.col("has_url"), "yes").otherwise("no").alias("url"))


def backfill_entries(chunks: DataFrame) -> DataFrame:
    """Per source what a manifest entry is filled from: count, first filled values and the sets of types."""
    types = lambda c: F.array_sort(F.collect_set(F.nullif(F.trim(c), F.lit(""))))
    return chunks.where("source is not null").groupBy("source").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.lower(F.trim(first_filled("vendor"))).alias("vendor"), *[first_filled(c).alias(c) for c in ("content_type", "source_type", "product")], types("content_type").alias("content_types"), types("source_type").alias("source_types")
    )


def backfilled(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """The manifest with an entry for each source without one: a marker in the place of the digest, vendor unknown where none is."""
    kind = F.when(F.array_contains("content_types", "video_transcript"), "video").when(F.array_contains("source_types", "html"), "html").otherwise("file")
    entries = join_checked(backfill_entries(chunks), manifest.select("source").distinct(), ["source"], "left_anti", salt_by="source")
    new = entries.select("source", F.concat(F.lit("backfill:"), kind).alias("sha256"), F.coalesce("vendor", F.lit("unknown")).alias("vendor"), "product", F.col("n_chunks").cast("int").alias("chunk_count"))
    return manifest.where("source is not null").select("source", "sha256", "vendor", "product", "chunk_count").unionByName(new)


def deleted_summary(chunks: DataFrame, manifest: DataFrame, sources: DataFrame) -> DataFrame:
    """source, n_chunks, listed of each source that a delete job is given: what it will take out of store and manifest."""
    asked = sources.where("source is not null").select("source").distinct()
    n = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    listed = manifest.select("source").distinct().withColumn("l", F.lit(True))
    return asked.join(n, "source", "left").join(listed, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n_chunks"), F.coalesce("l", F.lit(False)).alias("listed"))


def pending_sources(manifest: DataFrame, chunks: DataFrame, finished: DataFrame) -> DataFrame:
    """Sources that a resumed run has to take: not finished, or finished without any text chunk in the store."""
    stored = chunks.where("content_type = 'text'").select("source").distinct()
    done = join_checked(finished.select("source").distinct(), stored, ["source"], "left_semi", salt_by="source")
    return join_checked(manifest.where("source is not null").select("source").distinct(), done, ["source"], "left_anti", salt_by="source")


def filtered(chunks: DataFrame, vendors: list[str] | None = None, **equal: str | None) -> DataFrame:
    """Chunks that equal every given value, trimmed and in lower case; vendors (one or several) beat a single vendor; empty values don't count."""
    wanted = [v.strip().lower() for v in vendors or [] if v and v.strip()]
    if wanted:
        equal.pop("vendor", None)
        chunks = chunks.where(F.col("vendor").isin(*wanted))
    for column, value in equal.items():
        if value and value.strip():
            chunks = chunks.where(F.col(column) == value.strip().lower())
    return chunks


def audit_warnings(chunks: DataFrame, manifest: DataFrame, few: int = 3) -> DataFrame:
    """source, warning: few_chunks, no_headings, old_schema, missing_in_store, untracked, drift."""
    a = audit(chunks)
    kinds = F.array_compact(F.array(F.when(F.col("n_chunks") < few, "few_chunks"), F.when(F.col("n_sections") == 0, "no_headings"), F.when(F.col("n_old") > 0, "old_schema")))
    own = a.select("source", F.explode(kinds).alias("warning"))
    return own.unionByName(reconciled(chunks, manifest).where("status != 'ok'").select("source", F.col("status").alias("warning")))


def reconciled(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """source, stored, listed, status of a full outer comparison of store and manifest."""
    stored = chunks.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("stored"))
    listed = manifest.where("source is not null").groupBy("source").agg(F.max("chunk_count").alias("listed"))
    status = F.when(F.col("stored").isNull(), "missing_in_store").when(F.col("listed").isNull(), "untracked").when(F.col("stored") != F.col("listed"), "drift").otherwise("ok")
    return stored.join(listed, "source", "full_outer").select("source", "stored", F.col("listed").cast("bigint").alias("listed"), status.alias("status"))


def vendor_counts(chunks: DataFrame) -> DataFrame:
    """vendor, content_type, doc_type, n: the counters of both levels in one pass (rollup rows have nulls)."""
    rows = chunks.select(F.coalesce(T.normalised(F.col("vendor")), F.lit("unknown")).alias("vendor"), F.coalesce("content_type", F.lit("none")).alias("content_type"), T.doc_type(F.col("doc_type")).alias("doc_type"))
    return rows.groupingSets([("vendor", "content_type"), ("vendor", "doc_type")], "vendor", "content_type", "doc_type").agg(F.count(F.lit(1)).alias("n"))


def content_pivot(chunks: DataFrame) -> DataFrame:
    """Per vendor: text, image_caption and other chunks; of text chunks those of pdf, html and other sources."""
    text = F.col("content_type") == "text"
    return chunks.groupBy(F.coalesce(T.normalised(F.col("vendor")), F.lit("unknown")).alias("vendor")).agg(
        F.count_if(text).alias("n_text"),
        F.count_if(F.col("content_type") == "image_caption").alias("n_caption"),
        F.count_if(~F.coalesce(F.col("content_type").isin("text", "image_caption"), F.lit(False))).alias("n_other"),
        F.count_if(text & (F.col("source_type") == "pdf")).alias("n_pdf"),
        F.count_if(text & (F.col("source_type") == "html")).alias("n_html"),
        F.count_if(text & ~F.coalesce(F.col("source_type").isin("pdf", "html"), F.lit(False))).alias("n_rest"),
    )


def source_metadata(chunks: DataFrame) -> DataFrame:
    """source with section, lang and product of its best chunk: a text chunk if there is one, then the first by point_id."""
    best = F.min_by(F.struct("point_id", "section", "lang", "product", "content_type"), F.struct(F.when(F.col("content_type") == "text", 0).otherwise(1), "point_id"))
    return chunks.where("source is not null").groupBy("source").agg(best.alias("b")).select("source", "b.point_id", "b.section", "b.lang", "b.product", "b.content_type")


def backfill_plan(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """source, n_chunks, content_types, status: selected (no entry), skipped_existing, skipped_other (no text chunks)."""
    per = chunks.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_set("content_type")).alias("content_types"))
    listed = manifest.where("source is not null").select("source").distinct().withColumn("listed", F.lit(True))
    status = F.when(F.coalesce("listed", F.lit(False)), "skipped_existing").when(~F.array_contains("content_types", "text"), "skipped_other").otherwise("selected")
    return per.join(listed, "source", "left").select("source", "n_chunks", "content_types", status.alias("status"))


def changed_sources(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """source, digest, action: of sources with documents, new where no entry is, replace where the digest differs, else skip.

    The digest is made of sums that don't depend on order, over the distinct texts, so no source is gathered.
    """
    texts = documents.where("source is not null").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).distinct()
    part = lambda at: F.bit_xor(F.conv(F.substring("h", at, 15), 16, 10).cast("bigint"))
    now = texts.groupBy("source").agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(16).alias("b")).select("source", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("digest"))
    listed = manifest.where("source is not null").groupBy("source").agg(F.max("sha256").alias("sha256"))
    action = F.when(F.col("sha256").isNull(), "new").when(F.col("sha256") != F.col("digest"), "replace").otherwise("skip")
    return now.join(listed, "source", "left").select("source", "digest", action.alias("action"))


def migrated(chunks: DataFrame) -> DataFrame:
    """point_id, chunk_index, total_chunks, chunk_id, schema_version after renumbering each source by page, section and text."""
    rows = latest(chunks).where("source is not null").select("point_id", "source", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("section", F.lit("")).alias("section"), F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("head"))
    total = rows.groupBy("source").agg(F.count(F.lit(1)).alias("total_chunks"))
    placed = numbered(rows, ["source"], ["page", "section", "head", "point_id"], "chunk_index")
    return join_checked(placed, total, ["source"], "left", salt_by="point_id").select("point_id", "chunk_index", "total_chunks", T.digest_id(F.col("source"), F.col("chunk_index")).alias("chunk_id"), F.lit(2).alias("schema_version"))


def page_numbers_of_chunks(chunks: DataFrame) -> DataFrame:
    """point_id, chunk_index counted anew from 0 in each page of a source; rows without page share one count."""
    rows = latest(chunks).where("source is not null").select("point_id", "source", "page", F.coalesce("chunk_index", F.lit(0)).alias("old"))
    return numbered(rows, ["source", "page"], ["old", "point_id"], "chunk_index").select("point_id", "source", "page", "chunk_index")


def filled_headings(chunks: DataFrame) -> DataFrame:
    """point_id, source, page, chunk_index, section: the section of a chunk or the nearest one before it in its source.

    Goes over pages and also names captions by the section they stand in; sources are ordered in parts of 100 pages.
    """
    rows = chunks.where("point_id is not null and source is not null").select("point_id", "source", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.nullif(F.trim("section"), F.lit("")).alias("own")).distinct()
    rows = rows.withColumn("part", F.floor(F.col("page") / 100))
    return before(rows, "source", "own", "nearest", ["page", "chunk_index", "point_id"]).select("point_id", "source", "page", "chunk_index", F.coalesce("own", "nearest").alias("section"))
