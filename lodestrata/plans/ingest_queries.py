"""Queries of ingest: names and ids, queues, registries and manifests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import timed
from ..session import fresh_dir, join_checked, table
from ..sources import readers
from .catalog_queries import _LATEST, _VENDOR

_SHARD = "coalesce(nullif(regexp_replace(lower(trim(vendor)), '[^a-z0-9_]+', '_', 'g'), ''), 'unknown')"


def k2_shards(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written by shard and read back: a shard is a folder, so a filter on it reads nothing else."""
    shard = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim("vendor")), "[^a-z0-9_]+", "_"), F.lit("")), F.lit("unknown"))
    out = fresh_dir(spark, "shards")
    table(spark, d, "chunks").select("point_id", "source", F.sha2("text", 256).alias("digest"), shard.alias("shard")).write.partitionBy("shard").parquet(out)
    rows = spark.read.schema("point_id string, source string, digest string, shard string").parquet(out)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.min("digest").alias("first_digest"))


def k5_delete_by_video(spark: SparkSession, d: str) -> DataFrame:
    """Cues that stay when videos without speakers are deleted."""
    cues, known = table(spark, d, "vtt_cues"), table(spark, d, "video_speakers").select("video_id").distinct()
    return join_checked(cues.where("video_id is not null"), known, ["video_id"], "left_semi", salt_by="cue_id").groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_manifest").where("source is not null").groupBy("source").agg(F.max(F.nullif("vendor", F.lit(""))).alias("vendor"), F.max("product").alias("product"))


def k8_registry_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The registry of the manifest's sources, inserted or updated from what the store lists."""
    return C.merged(_registry(spark, d), C.source_list(table(spark, d, "chunks")).select("source", "vendor", "product"), "source")


def v7_registry_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Listed sources as registry rows, with defaults for what they lack."""
    name = F.regexp_extract(F.replace(F.col("source"), F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)
    return C.source_list(table(spark, d, "chunks")).select("source", name.alias("name"), F.coalesce(T.normalised(F.col("vendor")), F.lit("unknown")).alias("vendor"), T.doc_type(F.col("doc_type")).alias("doc_type"), "n_chunks")


def v32_registry_rows(spark: SparkSession, d: str) -> DataFrame:
    """What the registry keeps of each stored row."""
    return table(spark, d, "chunks").where("source is not null").select("source", T.normalised(F.col("vendor")).alias("vendor"), "product", "product_version", T.doc_type(F.col("doc_type")).alias("doc_type"), F.coalesce("lang", F.lit("en")).alias("lang")).distinct()


def k9_manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The manifest with fresh entries in the place of those whose count drifted."""
    chunks, manifest = table(spark, d, "chunks"), table(spark, d, "ingest_manifest").where("source is not null").select("source", "chunk_count", "sha256")
    fresh = C.reconciled(chunks, manifest).where("status = 'drift'").select("source", F.col("stored").cast("int").alias("chunk_count"), F.lit(None).cast("string").alias("sha256"))
    return C.upserted(manifest, fresh, "source")


def k10_queue_append(spark: SparkSession, d: str) -> DataFrame:
    """A queue of captions by source and picture: what is new joins it once, what is in it stays as it is."""
    rows = table(spark, d, "chunks").where("content_type = 'image_caption' and source is not null").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("image"), "point_id")
    queue = rows.where("point_id < '8'").groupBy("source", "image").agg(F.min("point_id").alias("point_id"))
    return C.appended_new(queue, rows, ["source", "image"], "point_id")


def k12_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sampled questions appended to JSON lines and read again, malformed lines named."""
    out = fresh_dir(spark, "samples")
    rows = table(spark, d, "feedback").where(F.col("question").isNotNull() & T.in_sample(F.col("question"), 0.2)).select("feedback_id", "question")
    rows.write.mode("append").json(out)
    return readers.json_lines(spark, out, "feedback_id bigint, question string").select("feedback_id", "question", "malformed")


def s12_source_urls(spark: SparkSession, d: str) -> DataFrame:
    """The url of each manifest entry: its own file's, by vendor and name, where one is known."""
    known = table(spark, d, "chunks").where("url is not null").groupBy("source", T.normalised(F.col("vendor")).alias("vendor")).agg(F.min("url").alias("url"))
    rows = table(spark, d, "ingest_manifest").where("source is not null").select("source", T.normalised(F.col("vendor")).alias("vendor")).distinct()
    return rows.join(known, ["source", "vendor"], "left").select("source", "vendor", "url")


def s16_url_list(spark: SparkSession, d: str) -> DataFrame:
    """Pages to take, once a vendor and url, under their first source."""
    return table(spark, d, "chunks").where("url is not null").groupBy(F.coalesce(T.normalised(F.col("vendor")), F.lit("unknown")).alias("vendor"), "url").agg(F.min("source").alias("source"))


def p1_filters(spark: SparkSession, d: str) -> DataFrame:
    """A filter built from a search request: several vendors beat one, values are trimmed and in lower case, empty ones don't count."""
    return C.filtered(table(spark, d, "chunks"), [" Corvexa ", "pellatrix", ""], vendor="brixmesh", content_type="TEXT ", product="").select("point_id", "vendor", "content_type")


def p31_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of each kind of chunk: its title, place and the text that is embedded."""
    rows = table(spark, d, "chunks").where("source is not null and text is not null").select("point_id", "source", "page", "section", "content_type", "start_seconds", "text").distinct()
    page = F.concat(F.lit("p."), F.col("page").cast("string"))
    at = F.concat(F.lit("t="), T.tenths(F.coalesce("start_seconds", F.lit(0.0))), F.lit("s"))
    text = F.when(F.col("content_type") == "image_caption", T.index_text("Figure", F.col("source"), page, F.col("text"))).when(F.col("content_type") == "video_transcript", T.index_text("Video transcript", F.col("source"), at, F.col("text"))).otherwise(F.col("text"))
    return rows.select("point_id", "content_type", F.coalesce(T.normalised(F.col("section")), F.lit("-")).alias("title"), F.when(F.col("content_type") == "video_transcript", at).otherwise(page).alias("place"), text.alias("index_text"))


def t8_ocr_limits(spark: SparkSession, d: str) -> DataFrame:
    """The first 120 characters that a citation shows of a caption; the limit is the citation's."""
    return table(spark, d, "chunks").where("content_type = 'image_caption' and text is not null").select("point_id", F.substring("text", 1, 120).alias("ocr")).distinct()


def p32_pending(spark: SparkSession, d: str) -> DataFrame:
    manifest = table(spark, d, "ingest_manifest")
    return C.pending_sources(manifest, table(spark, d, "chunks"), manifest.where("chunk_count > 0"))


def j8_content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The digest of the first document of each manifest entry, null where there is none."""
    first = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.min_by(F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id").alias("digest"))
    return table(spark, d, "ingest_manifest").select("source").distinct().join(first, "source", "left")


def j11_extra_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Products and types of sources; what the documents say wins over the store."""
    extra = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.max("product").alias("p"), F.max("doc_type").alias("t"))
    return C.source_list(table(spark, d, "chunks")).join(extra, "source", "left").select("source", F.coalesce("p", "product").alias("product"), F.coalesce("t", "doc_type").alias("doc_type"))


def j12_frame_times(spark: SparkSession, d: str) -> DataFrame:
    """Evenly spaced frames of a video and the times of its cues by position; a frame without time stands at 0."""
    cues = table(spark, d, "vtt_cues").dropDuplicates(["cue_id"])
    frames = timed.evenly_spaced(cues).select("video_id", F.col("pos").alias("frame"))
    times = cues.where("video_id is not null and cue_id % 2 = 0").select("video_id", "cue_id", F.col("start_seconds").alias("t"))
    placed = timed.numbered(times.withColumn("start", F.coalesce("t", F.lit(0.0))), ["video_id"], ["start", "cue_id"], "frame")
    return frames.join(placed.select("video_id", "frame", "t"), ["video_id", "frame"], "left").select("video_id", "frame", F.coalesce("t", F.lit(0.0)).alias("t"))


def j13_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their vectors by position; those without a vector are left out."""
    vectors = table(spark, d, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("dim"))
    return table(spark, d, "documents").select("doc_id", "source").join(vectors, "doc_id")


def v10_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """The dimension of the stored vectors and how many differ from the one that is asked for: the check before a new ingest."""
    rows = table(spark, d, "embeddings").where("embedding is not null").select(F.size("embedding").alias("dim"))
    return rows.agg(F.min("dim").alias("least"), F.max("dim").alias("most"), F.count_if(F.col("dim") != 64).alias("n_other"))


def j14_batch_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of a batch by the id of their request; a request without result or that failed gets an empty text."""
    rows = table(spark, d, "feedback")
    results = rows.where("answer is not null and rating in (-1, 1)").select("feedback_id", "answer")
    return rows.select("feedback_id").join(results, "feedback_id", "left").select(F.concat(F.lit("r-"), F.col("feedback_id").cast("string")).alias("custom_id"), F.coalesce("answer", F.lit("")).alias("result"))


def a7_backfill_entries(spark: SparkSession, d: str) -> DataFrame:
    return C.backfill_entries(table(spark, d, "chunks"))


def v39_backfilled(spark: SparkSession, d: str) -> DataFrame:
    return C.backfilled(table(spark, d, "chunks"), table(spark, d, "ingest_manifest"))


def v40_delete_summary(spark: SparkSession, d: str) -> DataFrame:
    """What deleting the sources of all documents would take out."""
    return C.deleted_summary(table(spark, d, "chunks"), table(spark, d, "ingest_manifest"), table(spark, d, "documents"))


def v41_audit_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.audit_lines(table(spark, d, "chunks"))


def u2_queue_union(spark: SparkSession, d: str) -> DataFrame:
    """Two queues as one, once a source; the first queue wins."""
    a = table(spark, d, "ingest_manifest").where("source is not null").groupBy("source").agg(F.max(F.coalesce("vendor", F.lit(""))).alias("vendor"))
    b = table(spark, d, "documents").where("source is not null").select("source", F.coalesce("vendor", F.lit("")).alias("vendor"))
    return C.appended_new(a, b, ["source"], "vendor")


def u3_vendor_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Vendors known by the list or by the store that the manifest asks for."""
    known = table(spark, d, "vendors").select("vendor").union(table(spark, d, "chunks").select(T.normalised(F.col("vendor")))).where("vendor is not null").distinct()
    asked = table(spark, d, "ingest_manifest").select(T.normalised(F.col("vendor")).alias("vendor")).distinct()
    return known.join(asked, "vendor", "left_semi")


def u5_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Golden items and captions as one set of items; what one side lacks is null."""
    golden = table(spark, d, "eval_items").select(F.concat(F.lit("g-"), F.col("item_id").cast("string")).alias("id"), "question")
    captions = table(spark, d, "chunks").where("content_type = 'image_caption'").select(F.concat(F.lit("c-"), "point_id").alias("id"), F.col("text").alias("caption")).distinct()
    return golden.unionByName(captions, allowMissingColumns=True)


def v6_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts by key from the side table; a missing one is empty. A key is safe as a path."""
    side = table(spark, d, "chunks").where("length(text) > 200").select(F.sha2("text", 256).alias("blob"), "text").dropDuplicates(["blob"])
    asked = table(spark, d, "chunks").where("point_id is not null").select("point_id", F.sha2("text", 256).alias("blob")).distinct()
    return asked.join(side, "blob", "left").select("point_id", F.concat(F.substring("blob", 1, 2), F.lit("/"), "blob").alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def v17_cache_import(spark: SparkSession, d: str) -> DataFrame:
    """Old cache entries that can be taken over: with question and answer, once a question, the newest."""
    rows = table(spark, d, "feedback").where("trim(question) != '' and trim(answer) != ''")
    return rows.groupBy(F.sha2(F.trim("question"), 256).alias("key")).agg(F.max_by("feedback_id", F.struct("received_at", "feedback_id")).alias("feedback_id"), F.count(F.lit(1)).alias("n"))


def v22_caption_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the captions of one vendor: the right side of a reconciliation."""
    return C.filtered(table(spark, d, "chunks"), vendor="Corvexa", content_type="image_caption").select("point_id").distinct()


def v24_reingest_pages(spark: SparkSession, d: str) -> DataFrame:
    """What stays of the store when every page of the manifest is taken anew: rows go by url and by the old file name of the url."""
    chunks = table(spark, d, "chunks")
    pages = chunks.where("url is not null").select("url", "source").join(table(spark, d, "ingest_manifest").select("source").distinct(), "source", "left_semi").select("url").distinct()
    kept = join_checked(chunks.select("point_id", "source", "url"), pages, ["url"], "left_anti", salt_by="point_id")
    names = pages.select(T.url_slug(F.col("url"), F.lit("index")).alias("source"))
    return join_checked(kept, names, ["source"], "left_anti", salt_by="point_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def v37_transcript_rows(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of each video with an id and a named speaker: source, speakers and last time."""
    named = table(spark, d, "video_speakers").where("trim(display_name) != ''").groupBy("video_id").agg(F.count_distinct("speaker_no").alias("n_speakers"))
    ends = table(spark, d, "vtt_cues").where("video_id is not null").groupBy("video_id").agg(F.max("end_seconds").alias("ends"))
    return ends.join(named, "video_id").select("video_id", F.concat("video_id", F.lit(".vtt")).alias("source"), "n_speakers", "ends")


def v43_destinations(spark: SparkSession, d: str) -> DataFrame:
    """A file name for each url: its last segment, with eight signs of its digest where two urls of a vendor share it."""
    rows = table(spark, d, "chunks").where("url is not null").select(F.coalesce(T.normalised(F.col("vendor")), F.lit("unknown")).alias("vendor"), "url").distinct()
    rows = rows.withColumn("name", F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)/*$", 1))
    shared = rows.groupBy("vendor", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vendor", "name", F.lit(True).alias("shared"))
    marked = join_checked(rows, shared, ["vendor", "name"], "left", salt_by="url")
    return marked.select("vendor", "url", F.concat("name", F.when(F.col("shared"), F.concat(F.lit("_"), T.short_hash(F.col("url"), 8))).otherwise("")).alias("file_name"))


def w11_headings(spark: SparkSession, d: str) -> DataFrame:
    """The section each chunk stands in, filled down over pages, also for captions."""
    return C.filled_headings(C.latest(table(spark, d, "chunks").select("point_id", "source", "page", "chunk_index", "section", "text", "ingested_at")))


def f12_point_ids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based ids by the key layouts of transcripts, local videos, captions and frames."""
    rows = table(spark, d, "chunks").where("source is not null").select("source", F.coalesce("chunk_index", F.lit(0)).cast("string").alias("i"), T.tenths(F.coalesce("start_seconds", F.lit(0.0)), 3).alias("t")).distinct()
    key = lambda *parts: T.uuid5(F.concat_ws("|", *parts))
    return rows.select("source", "i", "t", key("source", "t", "i").alias("cue_id"), key("source", F.lit("video_transcript"), "t", "i").alias("video_id"), key("source", F.lit("img"), "i").alias("image_id"), key("source", F.lit("video_frame"), "t").alias("frame_id"))


def f13_media_ids(spark: SparkSession, d: str) -> DataFrame:
    """Short digests that name videos, cached pictures and media of a source."""
    rows = table(spark, d, "chunks").where("source is not null and url is not null").select("source", "url").distinct()
    return rows.select("source", "url", T.short_hash(F.concat_ws("|", "source", "url"), 20).alias("video"), T.short_hash(F.col("url"), 20).alias("image"), T.short_hash(F.col("source"), 16).alias("media"))


def f15_vendors(spark: SparkSession, d: str) -> DataFrame:
    """Vendors by folder and by source path, and by the first known vendor that a file name holds."""
    known = table(spark, d, "vendors").select("vendor").where("trim(vendor) != ''").distinct().withColumn("_all", F.lit(1))
    rows = table(spark, d, "chunks").where("source is not null").select("source", F.coalesce("vendor", F.lit("x")).alias("v")).distinct()
    named = join_checked(rows.select("source").distinct().withColumn("_all", F.lit(1)), known, ["_all"], "inner", salt_by="source").where(F.contains(F.lower("source"), F.lower("vendor"))).groupBy("source").agg(F.min("vendor").alias("by_name"))
    paths = rows.select("source", T.vendor_of_path(F.concat(F.lit("data/"), "v", F.lit("/"), "source")).alias("by_path"), T.vendor_of_source(F.concat(F.lit("docs\\"), "v", F.lit("/"), "source")).alias("by_source"))
    return paths.join(named, "source", "left")


def f18_names(spark: SparkSession, d: str) -> DataFrame:
    """Versions, languages and document types as file names show them."""
    rows = table(spark, d, "chunks").where("source is not null").select(F.concat("source", F.coalesce(F.concat(F.lit("_v"), "product_version", F.lit("_")), F.lit(""))).alias("name")).union(table(spark, d, "documents").where("source is not null").select("source")).distinct()
    return rows.select("name", T.version_of_name(F.col("name")).alias("version"), T.language_of_name(F.col("name")).alias("lang"), T.doc_type_of_name(F.col("name")).alias("doc_type"))


def f20_products(spark: SparkSession, d: str) -> DataFrame:
    """The product of its vendor that a file name holds, blanks as hyphens; the first in order."""
    lines = table(spark, d, "vendors").select("vendor", F.explode("products").alias("product")).select("vendor", "product", F.replace(F.lower(F.trim("product")), F.lit(" "), F.lit("-")).alias("needle")).where("needle != ''")
    rows = table(spark, d, "chunks").where("source is not null").select("source", T.normalised(F.col("vendor")).alias("vendor")).distinct()
    found = rows.join(F.broadcast(lines), "vendor").where(F.contains(F.lower("source"), F.col("needle")))
    return found.groupBy("source", "vendor").agg(F.min("product").alias("product"))


def f31_video_urls(spark: SparkSession, d: str) -> DataFrame:
    """Urls of videos at a second: the id found in each form, and the plain form with the time."""
    rows = table(spark, d, "vtt_cues").where("video_id is not null").select("video_id", "start_seconds").distinct()
    form = F.when(F.length("video_id") % 2 == 0, F.concat(F.lit("https://youtu.be/"), "video_id")).otherwise(F.concat(F.lit("https://www.youtube.com/embed/"), "video_id", F.lit("?rel=0")))
    rows = rows.withColumn("url", form)
    return rows.select("url", "start_seconds", T.is_video_url(F.col("url")).alias("is_video"), T.video_of_url(F.col("url")).alias("id"), T.url_at(T.watch_url(F.col("url")), F.col("start_seconds")).alias("watch"))


def v35_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments trimmed, with the glossary's terms; empty ones are dropped."""
    text = timed.glossed(F.trim("text"))
    return table(spark, d, "vtt_cues").where("trim(text) != ''").select("cue_id", text.alias("text")).distinct()


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and k.split("_")[0][-1:].isdigit() and getattr(f, "__module__", "") == __name__}


_NS = "'\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::blob"


def _uuid5(key: str) -> str:
    h = f"sha1({_NS} || encode({key}))"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12))"


def oracle_sql() -> dict[str, str]:
    from .catalog_queries import _DOC_TYPE, _first
    from .catalog_queries import oracle_sql as catalog_sql

    doc_type = _DOC_TYPE.format("doc_type")
    listed = f"listed as ({catalog_sql()['a1_list_sources']})"
    audit = catalog_sql()["a4_audit"]
    glossed = "trim(text, ' ')"
    for pattern, term in timed.GLOSSARY:
        glossed = f"regexp_replace({glossed}, '\\b{pattern}\\b', '{term}', 'gi')"
    types = lambda c: f"list_sort(coalesce(list(distinct nullif(trim({c}), '')) filter (where trim({c}) <> ''), []))"
    entries = f"entries as (select source, count(*) as n_chunks, {', '.join(map(_first, ('vendor', 'content_type', 'source_type', 'product')))}, {types('content_type')} as content_types, {types('source_type')} as source_types from chunks where source is not null group by source)"
    shown = lambda c: f"coalesce(nullif(trim({c}), ''), '-') as {c}"
    at = "'t=' || printf('%.1f', coalesce(start_seconds, 0)) || 's'"
    slug = "regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)/*$', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    name = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1)"
    form = lambda k, i: f"regexp_extract(name, '{T.VERSION_FORMS[k]}', {i})"
    has = lambda k: f"regexp_matches(name, '{T.VERSION_FORMS[k]}')"
    return {
        "k2_shards": f"select {_SHARD} as shard, count(*) as n, count(distinct source) as n_sources, min(sha256(text)) as first_digest from chunks group by 1",
        "k5_delete_by_video": "select video_id, count(*) as n from vtt_cues where video_id in (select video_id from video_speakers) group by 1",
        "k8_registry_upsert": f"with {listed} select source, coalesce(l.vendor, m.vendor) as vendor, coalesce(l.product, m.product) as product from (select source, max(nullif(vendor, '')) as vendor, max(product) as product from ingest_manifest where source is not null group by 1) m full outer join listed l using (source)",
        "v7_registry_backfill": f"with {listed} select source, regexp_extract(replace(source, '\\', '/'), '([^/]*)$', 1) as name, coalesce({_VENDOR}, 'unknown') as vendor, {doc_type} as doc_type, n_chunks from listed",
        "v32_registry_rows": f"select distinct source, {_VENDOR} as vendor, product, product_version, {doc_type} as doc_type, coalesce(lang, 'en') as lang from chunks where source is not null",
        "k9_manifest_upsert": "with s as (select source, count(*) as n from chunks group by 1), g as (select source, max(chunk_count) as c from ingest_manifest where source is not null group by 1), f as (select source, cast(n as integer) as chunk_count from s join g using (source) where n <> c) select source, chunk_count, sha256 from ingest_manifest where source is not null and source not in (select source from f) union all select source, chunk_count, null from f",
        "k10_queue_append": "with r as (select source, sha256(coalesce(text, '')) as image, point_id from chunks where content_type = 'image_caption' and source is not null), q as (select source, image, min(point_id) as point_id from r where point_id < '8' group by 1, 2) select * from q union all select source, image, min(point_id) from r where (source, image) not in (select source, image from q) group by 1, 2",
        "k12_json_lines": "select feedback_id, question, cast(null as varchar) as malformed from feedback where question is not null and cast('0x' || substr(sha256(question), 1, 8) as bigint) / 4294967295.0::double < 0.2",
        "s12_source_urls": f"with k as (select source, {_VENDOR} as vendor, min(url) as url from chunks where url is not null group by 1, 2) select m.source, m.vendor, k.url from (select distinct source, {_VENDOR} as vendor from ingest_manifest where source is not null) m left join k on k.source = m.source and k.vendor = m.vendor",
        "s16_url_list": f"select coalesce({_VENDOR}, 'unknown') as vendor, url, min(source) as source from chunks where url is not null group by 1, 2",
        "p1_filters": "select point_id, vendor, content_type from chunks where vendor in ('corvexa', 'pellatrix') and content_type = 'text'",
        "p31_payloads": f"select point_id, content_type, coalesce(nullif(lower(trim(section)), ''), '-') as title, case when content_type = 'video_transcript' then {at} else 'p.' || page end as place, case content_type when 'image_caption' then '[Figure, ' || source || coalesce(', p.' || page, '') || '] ' || text when 'video_transcript' then '[Video transcript, ' || source || ', ' || {at} || '] ' || text else text end as index_text from (select distinct point_id, source, page, section, content_type, start_seconds, text from chunks where source is not null and text is not null)",
        "t8_ocr_limits": "select distinct point_id, substr(text, 1, 120) as ocr from chunks where content_type = 'image_caption' and text is not null",
        "p32_pending": "select distinct source from ingest_manifest where source is not null and source not in (select source from ingest_manifest where chunk_count > 0 and source in (select source from chunks where content_type = 'text'))",
        "j8_content_hashes": "select source, digest from (select distinct source from ingest_manifest) left join (select source, arg_min(sha256(coalesce(text, '')), doc_id) as digest from documents where source is not null group by 1) using (source)",
        "j11_extra_metadata": f"with {listed}, e as (select source, max(product) as p, max(doc_type) as t from documents where source is not null group by 1) select source, coalesce(p, product) as product, coalesce(t, doc_type) as doc_type from listed left join e using (source)",
        "j12_frame_times": "with u as (select distinct on (cue_id) * from vtt_cues), r as (select video_id, count(*) as n from u where video_id is not null group by 1), f as (select distinct video_id, case when least(n, 60) = 1 then 0 else cast(round_even(i * (n - 1)::double / (least(n, 60) - 1), 0) as bigint) end as frame from (select video_id, n, unnest(range(least(n, 60))) as i from r)), t as (select video_id, start_seconds as t, row_number() over (partition by video_id order by coalesce(start_seconds, 0), cue_id) - 1 as frame from u where video_id is not null and cue_id % 2 = 0) select video_id, frame, coalesce(t, 0.0::double) as t from f left join t using (video_id, frame)",
        "j13_embedded": "select doc_id, source, cast(len(embedding) as integer) as dim from documents join embeddings on vec_id = doc_id where embedding is not null",
        "v10_dimensions": "select cast(min(len(embedding)) as integer) as least, cast(max(len(embedding)) as integer) as most, count(*) filter (where len(embedding) <> 64) as n_other from embeddings where embedding is not null",
        "j14_batch_results": "select 'r-' || f.feedback_id as custom_id, coalesce(r.answer, '') as result from feedback f left join (select feedback_id, answer from feedback where answer is not null and rating in (-1, 1)) r using (feedback_id)",
        "a7_backfill_entries": f"with {entries} select * replace (lower(trim(vendor)) as vendor) from entries",
        "v39_backfilled": f"with {entries} select source, sha256, vendor, product, chunk_count from ingest_manifest where source is not null union all select source, 'backfill:' || case when list_contains(content_types, 'video_transcript') then 'video' when list_contains(source_types, 'html') then 'html' else 'file' end, coalesce(lower(trim(vendor)), 'unknown'), product, cast(n_chunks as integer) from entries where source not in (select source from ingest_manifest where source is not null)",
        "v40_delete_summary": "select source, coalesce(n, 0) as n_chunks, source in (select source from ingest_manifest where source is not null) as listed from (select distinct source from documents where source is not null) left join (select source, count(*) as n from chunks group by 1) using (source)",
        "v41_audit_lines": f"select source, cast(n_chunks as varchar) as n_chunks, {', '.join(map(shown, ('vendor', 'doc_type', 'product', 'newest')))}, case when has_url then 'yes' else 'no' end as url from ({audit})",
        "u2_queue_union": "with a as (select source, max(coalesce(vendor, '')) as vendor from ingest_manifest where source is not null group by 1) select * from a union all select source, min(coalesce(vendor, '')) from documents where source is not null and source not in (select source from a) group by 1",
        "u3_vendor_candidates": f"select distinct vendor from (select vendor from vendors union select {_VENDOR} from chunks) where vendor in (select {_VENDOR} from ingest_manifest where {_VENDOR} is not null)",
        "u5_dataset": "select 'g-' || item_id as id, question, null as caption from eval_items union all select distinct 'c-' || point_id, null, text from chunks where content_type = 'image_caption'",
        "v6_blobs": "select point_id, substr(blob, 1, 2) || '/' || blob as path, case when length(text) > 200 then text else '' end as text from (select distinct point_id, sha256(text) as blob, text from chunks where point_id is not null)",
        "v17_cache_import": "select sha256(trim(question, ' ')) as key, arg_max(feedback_id, struct_pack(a := received_at, b := feedback_id)) as feedback_id, count(*) as n from feedback where trim(question, ' ') <> '' and trim(answer, ' ') <> '' group by 1",
        "v22_caption_ids": "select distinct point_id from chunks where vendor = 'corvexa' and content_type = 'image_caption'",
        "v24_reingest_pages": f"with p as (select distinct url from chunks where url is not null and source in (select source from ingest_manifest)), n as (select coalesce(nullif({slug}, ''), 'index') || '-' || substr(sha256(url), 1, 8) || '.html' as source from p) select source, count(*) as n from chunks where (url is null or url not in (select url from p)) and (source is null or source not in (select source from n)) group by 1",
        "v37_transcript_rows": "select video_id, video_id || '.vtt' as source, n_speakers, ends from (select video_id, max(end_seconds) as ends from vtt_cues where video_id is not null group by 1) join (select video_id, count(distinct speaker_no) as n_speakers from video_speakers where trim(display_name) <> '' group by 1) using (video_id)",
        "v43_destinations": f"select vendor, url, name || case when count(*) over (partition by vendor, name) > 1 then '_' || substr(sha256(url), 1, 8) else '' end as file_name from (select distinct coalesce({_VENDOR}, 'unknown') as vendor, url, {name} as name from chunks where url is not null)",
        "w11_headings": f"with {_LATEST}, r as (select distinct point_id, source, coalesce(page, 0) as page, coalesce(chunk_index, 0) as chunk_index, nullif(trim(section), '') as own from latest where source is not null) select point_id, source, page, chunk_index, last_value(own ignore nulls) over (partition by source order by page, chunk_index, point_id rows between unbounded preceding and current row) as section from r",
        "f12_point_ids": f"select source, i, t, {_uuid5(chr(34) + 'source' + chr(34) + ' || ' + repr('|') + ' || t || ' + repr('|') + ' || i')} as cue_id, {_uuid5(chr(34) + 'source' + chr(34) + ' || ' + repr('|video_transcript|') + ' || t || ' + repr('|') + ' || i')} as video_id, {_uuid5('source || ' + repr('|img|') + ' || i')} as image_id, {_uuid5('source || ' + repr('|video_frame|') + ' || t')} as frame_id from (select distinct source, cast(coalesce(chunk_index, 0) as varchar) as i, printf('%.3f', coalesce(start_seconds, 0)) as t from chunks where source is not null)",
        "f13_media_ids": "select distinct source, url, substr(sha256(source || '|' || url), 1, 20) as video, substr(sha256(url), 1, 20) as image, substr(sha256(source), 1, 16) as media from chunks where source is not null and url is not null",
        "f15_vendors": "with r as (select distinct source, coalesce(vendor, 'x') as v from chunks where source is not null), n as (select source, min(vendor) as by_name from (select distinct source from r), vendors where trim(vendor) <> '' and contains(lower(source), lower(vendor)) group by 1) select source, lower(string_split(v || '/' || source, '/')[1]) as by_path, lower(string_split(v || '/' || source, '/')[1]) as by_source, by_name from r left join n using (source)",
        "f18_names": f"with r as (select source || coalesce('_v' || product_version || '_', '') as name from chunks where source is not null union select source from documents where source is not null) select name, case when {has(0)} then concat_ws('.', {form(0, 1)}, {form(0, 2)}, nullif({form(0, 3)}, '')) when {has(1)} then {form(1, 1)} || '.' || {form(1, 2)} when {has(2)} then {form(2, 1)} when {has(3)} then {form(3, 1)} || '.' || {form(3, 2)} || '.' || coalesce(nullif({form(3, 3)}, ''), '0') else '' end as version, case when regexp_matches(upper(name), '_EN[-_]US|-EN-US|-EN-') then 'en' when regexp_matches(upper(name), '_DE|-DE-') then 'de' else 'en' end as lang, case when regexp_matches(lower(name), '\\.html?$') then 'article' when regexp_matches(lower(name), 'data[-_]?sheet') then 'datasheet' when regexp_matches(lower(name), 'release[-_]notes') then 'release_notes' when regexp_matches(lower(name), 'tutorial|quick[-_]start') then 'tutorial' else 'manual' end as doc_type from r",
        "f20_products": f"with p as (select vendor, product, replace(lower(trim(product)), ' ', '-') as needle from (select vendor, unnest(products) as product from vendors)) select source, r.vendor, min(product) as product from (select distinct source, {_VENDOR} as vendor from chunks where source is not null) r join p on p.vendor = r.vendor where needle <> '' and contains(lower(source), needle) group by 1, 2",
        "f31_video_urls": "with r as (select distinct video_id, start_seconds, case when length(video_id) % 2 = 0 then 'https://youtu.be/' || video_id else 'https://www.youtube.com/embed/' || video_id || '?rel=0' end as url from vtt_cues where video_id is not null) select url, start_seconds, true as is_video, nullif(regexp_extract(url, '(?i)(?:youtu\\.be/|embed/|shorts/)([a-zA-Z0-9_-]{6,})', 1), '') as id, 'https://www.youtube.com/watch?v=' || video_id || case when start_seconds is null then '' else '&t=' || cast(greatest(0, round_even(start_seconds, 0)) as bigint) || 's' end as watch from r",
        "v35_segments": f"select distinct cue_id, {glossed} as text from vtt_cues where trim(text) <> ''",
    }
