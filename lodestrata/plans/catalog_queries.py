"""Queries over the chunk store and the manifest, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..session import table

_DOC_TYPE = "case when coalesce(lower(trim({0})), '') = '' then 'manual' when lower(trim({0})) in ('manual','datasheet','tutorial','release_notes','article','other') then lower(trim({0})) when lower(trim({0})) in ('user_manual','api_reference') then 'manual' when lower(trim({0})) in ('quick_start','integration_guide') then 'tutorial' when lower(trim({0})) = 'specification' then 'datasheet' else 'other' end"
_VENDOR = "nullif(lower(trim(vendor)), '')"


def _first(column: str) -> str:
    return f"arg_min({column}, point_id || chr(1) || {column}) filter (where nullif(trim({column}), '') is not null) as {column}"


_LATEST = "latest as (select * from (select *, row_number() over (partition by point_id order by coalesce(ingested_at, '') desc, coalesce(text, '') desc) as rn from chunks where point_id is not null) where rn = 1)"


def s1_scan(spark: SparkSession, d: str) -> DataFrame:
    """Pruned scan with a pushed-down equality and IN filter."""
    return table(spark, d, "chunks").where(F.col("content_type").isin("text", "image_caption") & (F.col("schema_version") == 2) & (F.col("vendor") == "corvexa")).select("point_id", "source", "page", "content_type")


def s3_corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where((F.trim("text") != "") & (F.trim("source") != "")).select("point_id", "text", "source")


def s4_exists(spark: SparkSession, d: str) -> DataFrame:
    """Which listed sources have chunks, and how many: a batch of existence checks."""
    n = table(spark, d, "chunks").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "ingest_manifest").select("source").distinct().join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("present"))


def s22_recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The 50 sessions changed last; the limit is the report's."""
    return table(spark, d, "sessions").where("session_id is not null").distinct().orderBy(F.desc("updated_at"), "session_id").limit(50).select("session_id", "title", "updated_at")


def k1_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = C.latest(table(spark, d, "chunks"))
    return rows.select("point_id", "source", "text", "ingested_at")


def k3_delete_by_source(spark: SparkSession, d: str) -> DataFrame:
    """What stays when sources without manifest entry are deleted."""
    chunks, listed = table(spark, d, "chunks"), table(spark, d, "ingest_manifest")
    gone = chunks.select("source").distinct().join(listed.select("source").distinct(), "source", "left_anti")
    return C.without_sources(chunks, gone).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def k4_purge_and_write(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose count drifted are purged and written anew from the rows stored last."""
    chunks, manifest = table(spark, d, "chunks"), table(spark, d, "ingest_manifest")
    drift = C.reconciled(chunks, manifest).where("status = 'drift'").select("source")
    fresh = C.latest(chunks).join(drift, "source", "left_semi").select("point_id", "source")
    return C.without_sources(chunks.select("point_id", "source"), drift).unionByName(fresh)


def k6_retag(spark: SparkSession, d: str) -> DataFrame:
    """Products set by source from the manifest where the entry has one."""
    chunks, manifest = table(spark, d, "chunks"), table(spark, d, "ingest_manifest")
    new = manifest.where(F.trim("product") != "").groupBy("source").agg(F.max("product").alias("new"))
    return chunks.join(new, "source", "left").select("point_id", "source", F.coalesce("new", "product").alias("product"))


def k15_externalise(spark: SparkSession, d: str) -> DataFrame:
    """Preview of 200 signs for the payload and the key of the whole text in a side table."""
    rows = table(spark, d, "chunks").where("text != ''").select("text").distinct()
    return rows.select(F.sha2("text", 256).alias("blob"), T.preview(F.col("text"), 200).alias("preview"), F.length("text").alias("n"))


def k16_hydrate(spark: SparkSession, d: str) -> DataFrame:
    """Previews joined with the side table of whole texts; texts up to 200 signs aren't in it."""
    rows = C.latest(table(spark, d, "chunks")).select("point_id", F.sha2("text", 256).alias("blob"), T.preview(F.col("text"), 200).alias("preview"))
    side = table(spark, d, "chunks").where(F.length("text") > 200).select(F.sha2("text", 256).alias("blob"), "text").dropDuplicates(["blob"])
    return rows.join(side, "blob", "left").select("point_id", F.coalesce("text", "preview").alias("text"))


def k18_migrate_to_v2(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the old schema version lifted to version 2, with the id of their key where none is."""
    rows = table(spark, d, "chunks").where(F.coalesce("schema_version", F.lit(1)) < 2)
    return rows.select(F.coalesce("point_id", T.digest_id(F.col("source"), F.col("chunk_index"))).alias("point_id"), "source", T.doc_type(F.col("doc_type")).alias("doc_type"), F.lit(2).alias("schema_version")).distinct()


def k19_migrate_metadata(spark: SparkSession, d: str) -> DataFrame:
    return C.migrated(table(spark, d, "chunks"))


def w1_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return C.page_numbers_of_chunks(table(spark, d, "chunks"))


def a1_list_sources(spark: SparkSession, d: str) -> DataFrame:
    return C.source_list(table(spark, d, "chunks"))


def a2_sharded_list(spark: SparkSession, d: str) -> DataFrame:
    """Sources over the shards of all vendors: counts are summed, the shard is the last by name."""
    shard = F.coalesce(F.nullif(F.regexp_replace(F.lower(F.trim("vendor")), "[^a-z0-9_]+", "_"), F.lit("")), F.lit("unknown"))
    per = table(spark, d, "chunks").where("source is not null").groupBy("source", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source").agg(F.sum("n").alias("n"), F.max("shard").alias("last_shard"), F.count(F.lit(1)).alias("n_shards"))


def a3_vendor_products(spark: SparkSession, d: str) -> DataFrame:
    return C.vendor_products(table(spark, d, "chunks"))


def a4_audit(spark: SparkSession, d: str) -> DataFrame:
    return C.audit(table(spark, d, "chunks"))


def a5_vendor_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.vendor_counts(table(spark, d, "chunks"))


def a6_warnings(spark: SparkSession, d: str) -> DataFrame:
    return C.audit_warnings(table(spark, d, "chunks"), table(spark, d, "ingest_manifest"))


def a8_backfill_plan(spark: SparkSession, d: str) -> DataFrame:
    return C.backfill_plan(table(spark, d, "chunks"), table(spark, d, "ingest_manifest"))


def a10_content_pivot(spark: SparkSession, d: str) -> DataFrame:
    return C.content_pivot(table(spark, d, "chunks"))


def a18_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy(T.normalised(F.col("vendor")).alias("vendor")).agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct("point_id").alias("n_ids"), F.count_distinct("source").alias("n_sources"))


def a21_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Exact median and population variance of the text lengths of each vendor and language."""
    rows = table(spark, d, "documents").where("text is not null")
    return rows.groupBy("vendor", "lang").agg(F.round(F.percentile("n_chars", 0.5), 4).alias("median"), F.round(F.var_pop(F.col("n_chars").cast("double")), 3).alias("variance"), F.count(F.lit(1)).alias("n"))


def j4_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return C.reconciled(table(spark, d, "chunks"), table(spark, d, "ingest_manifest"))


def j5_missing_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions whose source has no text chunk."""
    chunks = table(spark, d, "chunks")
    text = chunks.where("content_type = 'text'").select("source").distinct()
    return chunks.where("content_type = 'image_caption'").select("point_id", "source").distinct().join(text, "source", "left_anti")


def j6_source_metadata(spark: SparkSession, d: str) -> DataFrame:
    return C.source_metadata(table(spark, d, "chunks"))


def p14_incremental(spark: SparkSession, d: str) -> DataFrame:
    return C.changed_sources(table(spark, d, "documents"), table(spark, d, "ingest_manifest")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def u1_set_differences(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "ingest_manifest").select("source").distinct(), table(spark, d, "chunks").select("source").distinct()
    return a.subtract(b).withColumn("side", F.lit("manifest")).unionByName(b.subtract(a).withColumn("side", F.lit("store"))).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


def u4_required_and_fill(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of sources with captions, and 1,000 others in the order of a seeded hash; the limit is the sample's."""
    chunks = C.latest(table(spark, d, "chunks")).select("point_id", "source")
    need = table(spark, d, "chunks").where("content_type = 'image_caption'").select("source").distinct()
    fill = chunks.join(need, "source", "left_anti").orderBy(F.sha2(F.concat(F.lit("7:"), "point_id"), 256), "point_id").limit(1000)
    return chunks.join(need, "source", "left_semi").withColumn("why", F.lit("required")).unionByName(fill.withColumn("why", F.lit("fill")))


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and k.split("_")[0][-1:].isdigit() and getattr(f, "__module__", "") == __name__}


def oracle_sql() -> dict[str, str]:
    reconciled = "reconciled as (select source, s.stored, l.listed, case when s.stored is null then 'missing_in_store' when l.listed is null then 'untracked' when s.stored <> l.listed then 'drift' else 'ok' end as status from (select source, count(*) as stored from chunks where source is not null group by 1) s full outer join (select source, cast(max(chunk_count) as bigint) as listed from ingest_manifest where source is not null group by 1) l using (source))"
    audit = f"audit as (select source, count(*) as n_chunks, arg_max(lower(trim(vendor)), point_id || chr(1) || lower(trim(vendor))) filter (where trim(vendor) <> '') as vendor, {_first('doc_type')}, {_first('product')}, count(distinct nullif(section, '')) as n_sections, bool_or(coalesce(url <> '', false)) as has_url, max(nullif(ingested_at, '')) as newest, count(*) filter (where coalesce(schema_version <> 2, true)) as n_old from chunks where source is not null group by source)"
    return {
        "s1_scan": "select point_id, source, page, content_type from chunks where content_type in ('text', 'image_caption') and schema_version = 2 and vendor = 'corvexa'",
        "s3_corpus": "select point_id, text, source from chunks where trim(text) <> '' and trim(source) <> ''",
        "s4_exists": "select source, coalesce(n, 0) as n, n is not null as present from (select distinct source from ingest_manifest) left join (select source, count(*) as n from chunks group by 1) using (source)",
        "s22_recent_sessions": "select session_id, title, updated_at from (select distinct * from sessions where session_id is not null) order by updated_at desc, session_id limit 50",
        "k1_upsert": f"with {_LATEST} select point_id, source, text, ingested_at from latest",
        "k3_delete_by_source": "select source, count(*) as n from chunks where source in (select source from ingest_manifest) group by 1",
        "k4_purge_and_write": f"with {_LATEST}, {reconciled}, drift as (select source from reconciled where status = 'drift') select point_id, source from chunks where source not in (select source from drift) union all select point_id, source from latest where source in (select source from drift)",
        "k6_retag": "select point_id, source, coalesce(n.product, c.product) as product from chunks c left join (select source, max(product) as product from ingest_manifest where trim(product) <> '' group by 1) n using (source)",
        "k15_externalise": "select sha256(text) as blob, case when length(text) > 200 then rtrim(substr(text, 1, 200), ' ') || '…' else text end as preview, cast(length(text) as integer) as n from (select distinct text from chunks where text <> '')",
        "k16_hydrate": f"with {_LATEST} select point_id, text from latest",
        "k18_migrate_to_v2": f"select distinct point_id, source, {_DOC_TYPE.format('doc_type')} as doc_type, 2 as schema_version from chunks where coalesce(schema_version, 1) < 2",
        "k19_migrate_metadata": f"with {_LATEST} select point_id, row_number() over w - 1 as chunk_index, count(*) over (partition by source) as total_chunks, substr(sha256(source || ':' || (row_number() over w - 1)), 1, 32) as chunk_id, 2 as schema_version from latest where source is not null window w as (partition by source order by coalesce(page, 0), coalesce(section, ''), substr(coalesce(text, ''), 1, 80), point_id)",
        "w1_chunk_index": f"with {_LATEST} select point_id, source, page, row_number() over (partition by source, page order by coalesce(chunk_index, 0), point_id) - 1 as chunk_index from latest where source is not null",
        "a1_list_sources": f"select source, count(*) as n_chunks, {', '.join(map(_first, ('vendor', 'product', 'doc_type', 'ingested_at')))} from chunks where source is not null group by source",
        "a2_sharded_list": "select source, cast(sum(n) as bigint) as n, max(shard) as last_shard, count(*) as n_shards from (select source, coalesce(nullif(regexp_replace(lower(trim(vendor)), '[^a-z0-9_]+', '_', 'g'), ''), 'unknown') as shard, count(*) as n from chunks where source is not null group by 1, 2) group by 1",
        "a3_vendor_products": f"select {_VENDOR} as vendor, coalesce(list_sort(list(distinct nullif(lower(trim(product)), '')) filter (where nullif(lower(trim(product)), '') is not null)), []) as products from chunks where {_VENDOR} is not null group by 1",
        "a4_audit": f"with {audit} select * from audit",
        "a5_vendor_counts": f"select vendor, content_type, doc_type, count(*) as n from (select coalesce({_VENDOR}, 'unknown') as vendor, coalesce(content_type, 'none') as content_type, {_DOC_TYPE.format('doc_type')} as doc_type from chunks) group by grouping sets ((vendor, content_type), (vendor, doc_type))",
        "a6_warnings": f"with {audit}, {reconciled} select source, 'few_chunks' as warning from audit where n_chunks < 3 union all select source, 'no_headings' from audit where n_sections = 0 union all select source, 'old_schema' from audit where n_old > 0 union all select source, status from reconciled where status <> 'ok'",
        "a8_backfill_plan": "select source, n_chunks, content_types, case when source in (select source from ingest_manifest where source is not null) then 'skipped_existing' when not list_contains(content_types, 'text') then 'skipped_other' else 'selected' end as status from (select source, count(*) as n_chunks, list_sort(list(distinct content_type)) as content_types from chunks where source is not null group by 1)",
        "a10_content_pivot": f"select coalesce({_VENDOR}, 'unknown') as vendor, count(*) filter (where content_type = 'text') as n_text, count(*) filter (where content_type = 'image_caption') as n_caption, count(*) filter (where not coalesce(content_type in ('text', 'image_caption'), false)) as n_other, count(*) filter (where content_type = 'text' and source_type = 'pdf') as n_pdf, count(*) filter (where content_type = 'text' and source_type = 'html') as n_html, count(*) filter (where content_type = 'text' and not coalesce(source_type in ('pdf', 'html'), false)) as n_rest from chunks group by 1",
        "a18_totals": f"select {_VENDOR} as vendor, count(*) as n_points, count(distinct point_id) as n_ids, count(distinct source) as n_sources from chunks group by 1",
        "a21_statistics": "select vendor, lang, round(quantile_cont(cast(n_chars as double), 0.5), 4) as median, round(var_pop(cast(n_chars as double)), 3) as variance, count(*) as n from documents where text is not null group by 1, 2",
        "j4_reconcile": f"with {reconciled} select * from reconciled",
        "j5_missing_captions": "select distinct point_id, source from chunks where content_type = 'image_caption' and source not in (select source from chunks where content_type = 'text')",
        "j6_source_metadata": "select source, point_id, section, lang, product, content_type from (select *, row_number() over (partition by source order by case when content_type = 'text' then 0 else 1 end, point_id) as rn from chunks where source is not null) where rn = 1",
        "u1_set_differences": "select source, 'manifest' as side from (select source from ingest_manifest except select source from chunks) union all select source, 'store' from (select source from chunks except select source from ingest_manifest) union all select source, 'both' from (select source from chunks intersect select source from ingest_manifest)",
        "p14_incremental": "with t as (select distinct source, sha256(coalesce(text, '')) as h from documents where source is not null), n as (select source, sha256(count(*) || ':' || bit_xor(cast('0x' || substr(h, 1, 15) as bigint)) || ':' || bit_xor(cast('0x' || substr(h, 16, 15) as bigint))) as digest from t group by 1), m as (select source, max(sha256) as sha256 from ingest_manifest group by 1) select case when m.sha256 is null then 'new' when m.sha256 <> digest then 'replace' else 'skip' end as action, count(*) as n from n left join m using (source) group by 1",
        "u4_required_and_fill": f"with {_LATEST}, need as (select distinct source from chunks where content_type = 'image_caption') select point_id, source, 'required' as why from latest where source in (select source from need) union all select * from (select point_id, source, 'fill' as why from latest where source not in (select source from need) order by sha256('7:' || point_id), point_id limit 1000)",
    }
