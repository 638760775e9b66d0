"""Queries of text functions, chunking, transcripts, dialogues and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, timed
from ..session import table
from ..streaming import events


def f1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of all documents with their counts and document counts."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("n_docs"))


def f4_document_facts(spark: SparkSession, d: str) -> DataFrame:
    """Token estimate, digest, preview, numbered steps and normalised names of each document."""
    text = F.col("text")
    n_steps = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"^[ \t]*[0-9]+[.)][ \t]")))
    return table(spark, d, "documents").select(
        "doc_id",
        T.token_estimate(text).alias("n_tokens"),
        F.sha2(text, 256).alias("digest"),
        T.preview(text, 120).alias("preview"),
        (n_steps >= 3).alias("is_procedure"),
        T.has_code(text).alias("has_code"),
        T.normalised(F.col("vendor")).alias("vendor"),
        T.doc_type(F.col("doc_type")).alias("doc_type"),
    )


def f12_ids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based ids of source|page|index and digest ids of source:index."""
    rows = table(spark, d, "chunks").select("source", "page", "chunk_index").where("source is not null").distinct()
    key = F.concat_ws("|", "source", F.coalesce(F.col("page").cast("string"), F.lit("None")), F.coalesce("chunk_index", F.lit(0)).cast("string"))
    return rows.select("source", "page", "chunk_index", T.uuid5(key).alias("uuid"), T.digest_id(F.col("source"), F.coalesce("chunk_index", F.lit(0))).alias("chunk_id"))


def f14_url_names(spark: SparkSession, d: str) -> DataFrame:
    """A file name and the host of each url."""
    rows = table(spark, d, "chunks").where("url is not null").select("url", F.coalesce(T.normalised(F.col("vendor")), F.lit("unknown")).alias("v")).groupBy("url").agg(F.min("v").alias("v"))
    return rows.select("url", T.url_slug(F.col("url"), F.concat("v", F.lit("-index"))).alias("file_name"), F.lower(F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]+)", 1)).alias("host"))


def f27_glossary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vtt_cues").where("text is not null").select("cue_id", "start_seconds", timed.glossed(timed.cue_line(F.col("text"))).alias("text"))


def f5_headers(spark: SparkSession, d: str) -> DataFrame:
    """The line that names a chunk in a prompt: file and tenth of a second of what is timed, else file, page and section."""
    rows = table(spark, d, "chunks").where("source is not null").select("point_id", "source", "page", "section", "content_type", "start_seconds").dropDuplicates(["point_id"])
    timed_kind = F.col("content_type").isin("video_transcript", "video_frame") & F.col("start_seconds").isNotNull()
    page = F.coalesce(F.concat(F.lit(" p."), (F.col("page") + 1).cast("string")), F.lit(""))
    section = F.coalesce(F.concat(F.lit(" §"), F.nullif(F.trim("section"), F.lit(""))), F.lit(""))
    place = F.when(timed_kind, F.concat(F.lit(" t="), T.tenths(F.col("start_seconds")), F.lit("s"))).otherwise(F.concat(page, section))
    return rows.select("point_id", F.concat(F.lit("["), "source", place, F.lit("]")).alias("header"))


def f6_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Texts as they stand in a prompt: 1,000 characters as they are and an ellipsis."""
    return table(spark, d, "chunks").where("text is not null").select("point_id", T.body(F.col("text")).alias("body")).distinct()


def p11_captions(spark: SparkSession, d: str) -> DataFrame:
    """Why a caption is rejected, the first reason: short, ids, decimal array, coordinates; null if it is kept."""
    text = F.coalesce("text", F.lit(""))
    share = F.length(F.regexp_replace(text, r"[^0-9.,\[\] \t]", "")) / F.length(text)
    reason = (
        F.when(F.length(text) < 15, "too short")
        .when(text.rlike(r"(?i)^\s*ids?\s*[=:]"), "ids prefix")
        .when(text.rlike(r"\[\s*(?:\d+\.\d+\s*,\s*)+\d+\.\d+\s*\]"), "decimal coordinate array")
        .when(share > 0.5, "mostly coordinates/numbers")
    )
    return table(spark, d, "chunks").where("content_type = 'image_caption'").select("point_id", reason.alias("reason")).distinct()


def f7_steps(spark: SparkSession, d: str) -> DataFrame:
    return chunking.steps(table(spark, d, "documents")).select("doc_id", "part_no", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


def f8_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(table(spark, d, "documents"))


def w10_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(table(spark, d, "documents"))


def w7_fresh_lines(spark: SparkSession, d: str) -> DataFrame:
    return timed.fresh_lines(_cues(spark, d)).select("video_id", "cue_id", F.array_join("lines", "\n").alias("text"))


def _cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues once an id."""
    return table(spark, d, "vtt_cues").dropDuplicates(["cue_id"])


def w6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each cue without rolling repeats."""
    lines = timed.collapsed(F.transform(F.split("text", "\n"), timed.cue_line))
    return _cues(spark, d).where("text is not null").select("cue_id", F.array_join(lines, "\n").alias("text"))


def w8_packed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Cues packed to 1,500 characters, with 150 carried over."""
    return timed.packed_windows(timed.spoken_cues(_cues(spark, d)))


def w9_span_windows(spark: SparkSession, d: str) -> DataFrame:
    """Cues joined as long as they end within 45 seconds of the first of their window."""
    return timed.span_windows(timed.spoken_cues(_cues(spark, d)))


def v30_transcript_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Windows as chunks: the title (here the video) labels the first only; index text and name-based ids."""
    rows = timed.span_windows(timed.spoken_cues(_cues(spark, d)))
    key = F.concat_ws("|", "video_id", F.lit("video_transcript"), T.tenths(F.col("start"), 3), F.col("window_no").cast("string"))
    return rows.select("video_id", F.col("window_no").alias("chunk_index"), F.when(F.col("window_no") == 0, F.col("video_id")).alias("section"), T.uuid5(key).alias("point_id"), T.index_text("Video transcript", F.col("video_id"), F.concat(F.lit("t="), T.tenths(F.col("start")), F.lit("s")), F.col("text")).alias("index_text"))


def x9_time_grid(spark: SparkSession, d: str) -> DataFrame:
    """Extension: cues by a fixed grid of 45 seconds."""
    return timed.time_windows(table(spark, d, "vtt_cues"))


def w17_evenly_spaced(spark: SparkSession, d: str) -> DataFrame:
    return timed.evenly_spaced(table(spark, d, "vtt_cues").dropDuplicates(["cue_id"]))


def w5_history(spark: SparkSession, d: str) -> DataFrame:
    return timed.recent_history(table(spark, d, "session_messages"))


def w19_rechunk(spark: SparkSession, d: str) -> DataFrame:
    """Answers in runs of eight words with a blank after each but the last."""
    words = F.filter(F.split("answer", " "), lambda w: w != "")
    rows = table(spark, d, "feedback").where("answer is not null").select("feedback_id", words.alias("ws")).where(F.size("ws") > 0)
    runs = rows.select("feedback_id", "ws", F.explode(F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / 8).cast("int"))).alias("i"))
    piece = F.concat(F.array_join(F.slice("ws", F.col("i") * 8 + 1, 8), " "), F.when((F.col("i") + 1) * 8 < F.size("ws"), " ").otherwise(""))
    return runs.select("feedback_id", "i", piece.alias("piece"))


def f32_subquestions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "feedback").where("question is not null").select("feedback_id", F.posexplode(F.split("question", r"(?i)[ ]+(?:and|;)[ ]+")).alias("i", "part"))
    return rows.where("trim(part) != ''")


def v52_session_touch(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with the time of their last message, stored in seconds or milliseconds, where it is later than the stored one."""
    last = table(spark, d, "session_messages").where("session_id is not null").groupBy("session_id").agg(F.max(T.seconds_of(F.col("created_at"))).alias("last"))
    return table(spark, d, "sessions").where("session_id is not null").groupBy("session_id").agg(F.max("updated_at").alias("updated_at")).join(last, "session_id", "left").select("session_id", F.greatest("updated_at", "last").alias("updated_at"))


def st1_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: hourly windows of the event stream, by event time with a watermark."""
    return events.event_windows(spark, f"{d}/events.parquet")


def st3_job_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of each user's events as a job: stale where nothing came for two hours before the last event of all."""
    return events.job_states(spark, f"{d}/events.parquet")


def st5_stale_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events that a silence of two hours closed."""
    return events.runs(spark, f"{d}/events.parquet").select("user_id", F.date_format("began", "yyyy-MM-dd HH:mm:ss").alias("began"), "n", "last_type")


def st4_retained(spark: SparkSession, d: str) -> DataFrame:
    """Runs that a store of jobs still keeps: those that ended up to a day before the last event of all."""
    rows = events.runs(spark, f"{d}/events.parquet")
    newest = rows.agg(F.max("last_ts").alias("newest"))
    return rows.join(F.broadcast(newest)).where("last_ts >= newest - interval 1 day").select("user_id", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"), "n")


def w13_fences(spark: SparkSession, d: str) -> DataFrame:
    """Sections of documents by markdown headings; fences hide headings."""
    return chunking.markdown_sections(table(spark, d, "documents"))


def v38_headings(spark: SparkSession, d: str) -> DataFrame:
    """Sections without signs of emphasis and pages counted from 0 where they were from 1."""
    rows = table(spark, d, "chunks").where("section is not null").select("section", "page").distinct()
    return rows.select("section", "page", chunking.clean_heading(F.col("section")).alias("heading"), F.greatest(F.coalesce("page", F.lit(0)) - 1, F.lit(0)).alias("index"))


def f2_term_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The places of all terms of the documents in a sparse vector, and how many terms share one."""
    rows = table(spark, d, "documents").select(F.explode(T.terms(F.col("text"))).alias("term")).distinct()
    return rows.groupBy(T.term_hash(F.col("term")).alias("place")).agg(F.count(F.lit(1)).alias("n"), F.min("term").alias("term"))


def f28_captions(spark: SparkSession, d: str) -> DataFrame:
    """Captions without empty openings, cut to 80 characters at a sentence or word (the limit is 600 in production)."""
    return table(spark, d, "chunks").where("content_type = 'image_caption' and text is not null").select("point_id", T.caption_text(F.col("text")).alias("caption"), T.caption_text(F.col("text"), 80).alias("short")).distinct()


def f29_snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.snippet(F.col("text"), 200).alias("short"))


def v13_web_results(spark: SparkSession, d: str) -> DataFrame:
    """Web pages as blocks of title, url and shortened text."""
    rows = table(spark, d, "chunks").where("url is not null and text is not null").select("point_id", F.coalesce("section", F.lit("")).alias("title"), "url", T.snippet(F.col("text"), 300).alias("content")).distinct()
    return rows.select("point_id", F.concat_ws("\n", "title", "url", "content").alias("block"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if callable(f) and k.split("_")[0][-1:].isdigit() and getattr(f, "__module__", "") == __name__}


from .catalog_queries import _DOC_TYPE as _DOC_TYPE_OF  # noqa: E402

_DOC_TYPE = _DOC_TYPE_OF.format("doc_type")


_RUNS = "e as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hour then 0 else 1 end as opens from events where user_id is not null and ts is not null), r as (select *, sum(opens) over (partition by user_id order by ts, event_id) as run from e)"
_CUE_LINE = "trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[ \\t]+', ' ', 'g'), ' ')"
_COLLAPSED = f"list_reduce(list_prepend([], list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_CUE_LINE}), lambda x: x <> ''), lambda x: [x])), lambda k, x: case when len(k) = 0 or not (starts_with(lower(k[-1]), lower(x[1])) or starts_with(lower(x[1]), lower(k[-1]))) then list_concat(k, x) when length(x[1]) > length(k[-1]) then list_concat(k[1:-2], x) else k end)"
_FRESH = f"c as (select distinct video_id, coalesce(start_seconds, 0) as start, coalesce(end_seconds, start_seconds, 0) as \"end\", cue_id, {_COLLAPSED} as lines from vtt_cues where video_id is not null), p as (select *, coalesce(lag(lines) over (partition by video_id order by start, cue_id), []) as seen from c where len(lines) > 0), fresh as (select video_id, cue_id, start, \"end\", list_filter(lines, lambda x: len(list_filter(seen, lambda y: starts_with(lower(y), lower(x)))) = 0) as lines from p)"
_SPOKEN = "s as (select *, row_number() over (partition by video_id order by start, cue_id) - 1 as pos from (select video_id, cue_id, start, \"end\", trim(regexp_replace(array_to_string(lines, ' '), '\\s+', ' ', 'g'), ' ') as text from fresh) where text <> '')"
_SPANS = "q as (select video_id, pos, 0 as window_no, start as ws from s where pos = 0 union all select s.video_id, s.pos, case when s.\"end\" - q.ws > 45 then q.window_no + 1 else q.window_no end, case when s.\"end\" - q.ws > 45 then s.start else q.ws end from q join s on s.video_id = q.video_id and s.pos = q.pos + 1), spans as (select video_id, window_no, min(ws) as start, arg_max(\"end\", pos) as \"end\", string_agg(text, ' ' order by pos) as text from q join s using (video_id, pos) group by 1, 2)"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _caption_sql(x: str) -> str:
    out = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ')"
    for opening in T.CAPTION_OPENINGS:
        out = f"regexp_replace({out}, '{opening}', '')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' ')"


def _cut_sql(x: str, size: int) -> str:
    window = f"substr({x}, 1, {size})"
    return f"case when length({x}) <= {size} then {x} when regexp_matches({window}, '.[.!?]') then trim(regexp_extract({window}, '(?s)^(.+[.!?])', 1), ' ') when regexp_matches({window}, '. ') then trim(regexp_extract({window}, '(?s)^(.+) ', 1), ' ') else trim({window}, ' ') end"


def _snippet_sql(x: str, size: int) -> str:
    window, out = f"substr({x}, 1, {size})", ""
    for mark in ("\\. ", "\\.\\n", "\\n"):
        at = f"length(regexp_extract({window}, '(?s)^(.*){mark}', 1))"
        out += f" when regexp_matches({window}, '{mark}') and {at} > {size // 2} then {_strip(f'substr({window}, 1, {at} + 1)')} || '…'"
    tail = f"regexp_replace({window}, '\\s+$', '')"
    return f"case when length({x}) <= {size} then {x}{out} else {tail} || '…' end"


def _piece_end_sql(start: str) -> str:
    """Where a piece of 1,500 characters ends that begins at start: after the last paragraph, line or space in its second half."""
    half = f"substr(text, {start} + 751, 750)"
    after = [f"when contains({half}, {m}) then {start} + 750 + length(regexp_extract({half}, '(?s)^.*' || {m}))" for m in ("chr(10) || chr(10)", "chr(10)", "' '")]
    return f"case when length(text) - {start} <= 1500 then length(text) {' '.join(after)} else {start} + 1500 end"


def oracle_sql() -> dict[str, str]:
    key = "source || '|' || coalesce(cast(page as varchar), 'None') || '|' || cast(coalesce(chunk_index, 0) as varchar)"
    glossed = "trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), '[ \\t]+', ' ', 'g'), ' ')"
    for pattern, term in timed.GLOSSARY:
        glossed = f"regexp_replace({glossed}, '\\b{pattern}\\b', '{term}', 'gi')"
    return {
        "f1_terms": "select term, cast(sum(tf) as bigint) as n, count(*) as n_docs from (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents) group by 1, 2) group by 1",
        "f4_document_facts": f"select doc_id, cast(case when coalesce(length(text), 0) = 0 then 0 else greatest(1, length(text) // 4) end as integer) as n_tokens, sha256(text) as digest, case when length(text) > 120 then rtrim(substr(text, 1, 120), ' ') || '…' else text end as preview, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '^[ \\t]*[0-9]+[.)][ \\t]'))) >= 3 as is_procedure, contains(text, '{{') or contains(text, '}}') or contains(text, 'def ') or contains(text, 'function') or contains(text, 'import') or contains(text, '#include') or regexp_matches(text, '(?m)^(?:\\s{{2,}}|\\t)\\S') as has_code, nullif(lower(trim(vendor)), '') as vendor, {_DOC_TYPE} as doc_type from documents",
        "f12_ids": f"with k as (select distinct source, page, chunk_index from chunks where source is not null), h as (select *, sha1('\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::blob || encode({key})) as h from k) select source, page, chunk_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as uuid, substr(sha256(replace(source, '\\', '/') || ':' || coalesce(chunk_index, 0)), 1, 32) as chunk_id from h",
        "f14_url_names": "with u as (select url, min(coalesce(nullif(lower(trim(vendor)), ''), 'unknown')) as v from chunks where url is not null group by 1), s as (select url, v, regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '([^/]*)/*$', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from u) select url, case when slug = '' then v || '-index' else slug end || '-' || substr(sha256(url), 1, 8) || '.html' as file_name, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) as host from s",
        "f27_glossary": f"select cue_id, start_seconds, {glossed} as text from vtt_cues where text is not null",
        "f5_headers": "select distinct point_id, '[' || source || case when coalesce(content_type in ('video_transcript', 'video_frame'), false) and start_seconds is not null then ' t=' || printf('%.1f', start_seconds) || 's' else coalesce(' p.' || (page + 1), '') || coalesce(' §' || nullif(trim(section, ' '), ''), '') end || ']' as header from chunks where source is not null",
        "f6_bodies": "select distinct point_id, case when length(text) > 1000 then substr(text, 1, 1000) || '…' else text end as body from chunks where text is not null",
        "p11_captions": "select distinct point_id, case when length(t) < 15 then 'too short' when regexp_matches(t, '(?i)^\\s*ids?\\s*[=:]') then 'ids prefix' when regexp_matches(t, '\\[\\s*(?:\\d+\\.\\d+\\s*,\\s*)+\\d+\\.\\d+\\s*\\]') then 'decimal coordinate array' when length(regexp_replace(t, '[^0-9.,\\[\\] \\t]', '', 'g')) / length(t) > 0.5 then 'mostly coordinates/numbers' end as reason from (select point_id, coalesce(text, '') as t from chunks where content_type = 'image_caption')",
        "f7_steps": f"with m as (select doc_id, t, string_split(regexp_replace(t, '((?:^|\\n)\\s*(?:Step\\s+)?[0-9]{{1,2}}[.):]\\s+)', chr(1) || '\\1', 'gi'), chr(1)) as p from (select doc_id, {_strip('text')} as t from documents where text is not null) where t <> ''), q as (select doc_id, case when len(p) < 3 then [t] else list_filter(list_transform(list_slice(p, 2, len(p)), lambda x: {_strip('x')}), lambda x: x <> '') end as parts from m) select doc_id, cast(i as integer) as part_no, cast(length(part) as integer) as n, sha256(part) as digest from (select doc_id, unnest(range(len(parts))) as i, unnest(parts) as part from q)",
        "w10_sections": "with l as (select doc_id, unnest(range(len(s))) as i, unnest(s) as x, unnest(list_prepend('', s[:-2])) as before from (select doc_id, string_split(text, chr(10)) as s from documents where text <> '')), h as (select *, trim(x, ' ') <> '' and length(x) <= 80 and not regexp_matches(x, '[.:;,!?0-9)]\\s*$') and not regexp_matches(x, '^\\s*(?:[-*]|[0-9]+[.)])') and trim(before, ' ') = '' as is_heading from l), n as (select *, count(*) filter (is_heading) over (partition by doc_id order by i) as section_no from h) select doc_id, cast(section_no as integer) as section_no, max(trim(x, ' ')) filter (is_heading) as heading, cast(count(*) as integer) as n_lines from n group by 1, 2",
        "w13_fences": "with l as (select doc_id, unnest(range(len(s))) as i, unnest(s) as x from (select doc_id, string_split_regex(text, '\\r?\\n') as s from documents where text <> '')), f as (select *, starts_with(ltrim(x, ' '), '```') as fence from l), c as (select doc_id, i, x, fence or count(*) filter (fence) over (partition by doc_id order by i) % 2 = 1 as code from f), h as (select doc_id, i, x, case when not code and regexp_matches(x, '^#{1,6}\\s+\\S') then trim(regexp_replace(regexp_replace(regexp_replace(x, '^#{1,6}\\s+|\\s*#*\\s*$', '', 'g'), '[*_`]', '', 'g'), '\\s+', ' ', 'g'), ' ') end as heading from c where code or not regexp_matches(trim(x, ' '), '^!\\[[^\\]]*\\]\\([^)]*\\)$')), n as (select *, count(heading) over (partition by doc_id order by i) as section_no from h), o as (select doc_id, section_no, max(heading) as heading, regexp_replace(coalesce(string_agg(x, chr(10) order by i) filter (heading is null), ''), '^\\s+|\\s+$', '', 'g') as body from n group by 1, 2) select * from o where body <> '' or heading is not null",
        "f2_term_hashes": "with t as (select distinct unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents), h as (select term, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(term, ''), lambda c: ascii(c)::bigint)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::bigint) as place from t) select place, count(*) as n, min(term) as term from h group by 1",
        "f8_chunks": f"with recursive s as (select doc_id, text, 0 as chunk_index, 0 as start, {_piece_end_sql('0')} as stop from documents where text <> '' union all select doc_id, text, chunk_index + 1, nxt, {_piece_end_sql('nxt')} from (select doc_id, text, chunk_index, case when strpos(substr(text, lo + 1, stop - lo), ' ') > 0 then lo + strpos(substr(text, lo + 1, stop - lo), ' ') else stop end as nxt from (select *, greatest(stop - 150, start + 1) as lo from s where stop < length(text)))) select doc_id, chunk_index, cast(start as integer) as start, cast(stop as integer) as stop, trim(substr(text, start + 1, stop - start), ' ') as text from s where trim(substr(text, start + 1, stop - start), ' ') <> ''",
        "v38_headings": "select distinct section, page, trim(regexp_replace(regexp_replace(section, '[*_`]', '', 'g'), '\\s+', ' ', 'g'), ' ') as heading, cast(greatest(coalesce(page, 0) - 1, 0) as integer) as index from chunks where section is not null",
        "st5_stale_runs": f"with {_RUNS} select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as began, count(*) as n, arg_max(event_type, struct_pack(a := ts, b := event_id)) as last_type from r group by user_id, run",
        "st4_retained": f"with {_RUNS}, k as (select user_id, run, max(ts) as last_ts, count(*) as n from r group by 1, 2) select user_id, strftime(last_ts, '%Y-%m-%d %H:%M:%S') as last_ts, n from k where last_ts >= (select max(ts) from events) - interval 1 day",
        "f28_captions": "with c as (select distinct point_id, " + _caption_sql("text") + " as t from chunks where content_type = 'image_caption' and text is not null) select point_id, " + _cut_sql("t", 600) + " as caption, " + _cut_sql("t", 80) + " as short from c",
        "f29_snippets": f"select doc_id, {_snippet_sql('text', 1200)} as snippet, {_snippet_sql('text', 200)} as short from documents where text is not null",
        "v13_web_results": f"select distinct point_id, coalesce(section, '') || chr(10) || url || chr(10) || {_snippet_sql('text', 300)} as block from chunks where url is not null and text is not null",
        "w6_collapsed": f"select distinct cue_id, array_to_string({_COLLAPSED}, chr(10)) as text from vtt_cues where text is not null",
        "w7_fresh_lines": f"with {_FRESH} select video_id, cue_id, array_to_string(lines, chr(10)) as text from fresh",
        "w8_packed_windows": f"with recursive {_FRESH}, {_SPOKEN}, r as (select video_id, pos, 0 as window_no, start, \"end\", text, length(text) as n from s where pos = 0 union all select s.video_id, s.pos, case when over then r.window_no + 1 else r.window_no end, case when over then s.start else r.start end, s.\"end\", case when not over then r.text || ' ' || s.text when tail = '' then s.text else tail || ' ' || s.text end, case when over then length(tail) + length(s.text) + 1 else r.n + length(s.text) + 1 end from (select r.*, s.text as cue, r.n + length(s.text) + 1 > 1500 as over, trim(right(r.text, 150), ' ') as tail from r join s on s.video_id = r.video_id and s.pos = r.pos + 1) r join s on s.video_id = r.video_id and s.pos = r.pos + 1) select video_id, cast(window_no as bigint) as window_no, min(start) as start, arg_max(\"end\", pos) as \"end\", arg_max(text, pos) as text from r group by 1, 2",
        "w9_span_windows": f"with recursive {_FRESH}, {_SPOKEN}, {_SPANS} select video_id, cast(window_no as bigint) as window_no, start, \"end\", text from spans",
        "v30_transcript_chunks": f"with recursive {_FRESH}, {_SPOKEN}, {_SPANS}, h as (select *, sha1('\\x6b\\xa7\\xb8\\x11\\x9d\\xad\\x11\\xd1\\x80\\xb4\\x00\\xc0\\x4f\\xd4\\x30\\xc8'::blob || encode(video_id || '|video_transcript|' || printf('%.3f', start) || '|' || window_no)) as h from spans) select video_id, cast(window_no as bigint) as chunk_index, case when window_no = 0 then video_id end as section, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id, '[Video transcript, ' || video_id || ', t=' || printf('%.1f', start) || 's] ' || text as index_text from h",
        "x9_time_grid": "select video_id, cast(floor(start_seconds / 45) as bigint) as window_no, arg_min(cue_id, struct_pack(a := start_seconds, b := cue_id)) as first_cue_id, min(start_seconds) as start, max(greatest(start_seconds, end_seconds)) as \"end\", count(*) as n_cues from vtt_cues where video_id is not null and start_seconds is not null group by 1, 2",
        "w17_evenly_spaced": "with r as (select video_id, cue_id, row_number() over (partition by video_id order by coalesce(start_seconds, 0), cue_id) - 1 as pos, count(*) over (partition by video_id) as n from vtt_cues where video_id is not null), k as (select distinct video_id, case when least(n, 60) = 1 then 0 else cast(round_even(i * (n - 1)::double / (least(n, 60) - 1), 0) as bigint) end as pos from (select distinct video_id, n, unnest(range(least(n, 60))) as i from r)) select video_id, cue_id, pos from r join k using (video_id, pos)",
        "w5_history": "with r as (select *, row_number() over w as n from session_messages where session_id is not null and role in ('user', 'assistant') and content <> '' and created_at is not null window w as (partition by session_id order by created_at desc, id desc)), s as (select *, sum(length(content)) over (partition by session_id order by n) as spent from r where n <= 6) select session_id, id, case when spent > 4000 then substr(content, 1, cast(4000 - (spent - length(content)) as bigint)) || '…' else content end as content from s where spent - length(content) < 4000",
        "w19_rechunk": "with w as (select feedback_id, list_filter(string_split(answer, ' '), lambda x: x <> '') as ws from feedback where answer is not null), r as (select feedback_id, ws, unnest(range((len(ws) - 1) // 8 + 1)) as i from w where len(ws) > 0) select feedback_id, cast(i as integer) as i, array_to_string(list_slice(ws, i * 8 + 1, i * 8 + 8), ' ') || case when (i + 1) * 8 < len(ws) then ' ' else '' end as piece from r",
        "f32_subquestions": "select feedback_id, cast(i as integer) as i, part from (select feedback_id, unnest(range(len(p))) as i, unnest(p) as part from (select feedback_id, regexp_split_to_array(question, '(?i)[ ]+(?:and|;)[ ]+') as p from feedback where question is not null)) where trim(part, ' ') <> ''",
        "v52_session_touch": "select s.session_id, greatest(s.updated_at, m.last) as updated_at from (select session_id, max(updated_at) as updated_at from sessions where session_id is not null group by 1) s left join (select session_id, max(case when created_at > 1e11 then created_at / 1000 else created_at end) as last from session_messages where session_id is not null group by 1) m using (session_id)",
        "st1_event_windows": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as start, event_type, count(*) as n, round(sum(value), 4) as total from events where ts is not null group by 1, 2",
        "st3_job_states": "select user_id, count(*) as n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_ts, case when epoch((select max(ts) from events)) - epoch(max(ts)) > 7200 then 'stale' else arg_max(event_type, struct_pack(a := ts, b := event_id)) end as state from events where user_id is not null group by 1",
    }
