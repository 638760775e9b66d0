"""The registered queries of the numbered problems and the SQL to compare them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import boilerplate, conversation_sql, conversations, leakage, pairs, personal, repeated_lines, scanned, tokens, transcripts

Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.broken_conversations(spark, f"{d}/session_messages.parquet", table(spark, d, "sessions"))


def _p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.sound_conversations(spark, f"{d}/session_messages.parquet", table(spark, d, "sessions"))


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(table(spark, d, "feedback"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.noisy_lines(table(spark, d, "chunks"))


def _p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scanned.repaired(table(spark, d, "chunks"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.repeated_lines(table(spark, d, "chunks"))


def _p4_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, d, "chunks"))


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.turn_starts(table(spark, d, "vtt_cues"), table(spark, d, "video_speakers"))


def _p5_turns(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.turns(table(spark, d, "vtt_cues"), table(spark, d, "video_speakers"))


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture(table(spark, d, "chunks"))


def _p6_main_body(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_body(table(spark, d, "chunks"))


def _p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def _p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    ids = tokens.encode_corpus(table(spark, d, "documents"))
    return ids.select("doc_id", tokens.token_text(ids["ids"]).alias("text"))


def _p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _p8_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.near_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_items(table(spark, d, "documents"), table(spark, d, "given_names"))


def _p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "documents"), table(spark, d, "given_names"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _p1_found,
        "p1_conversations": _p1_conversations,
        "p2_found": _p2_found,
        "p3_found": _p3_found,
        "p3_repaired": _p3_repaired,
        "p4_found": _p4_found,
        "p4_cleaned": _p4_cleaned,
        "p5_found": _p5_found,
        "p5_turns": _p5_turns,
        "p6_found": _p6_found,
        "p6_main_body": _p6_main_body,
        "p7_ids": _p7_ids,
        "p7_decoded": _p7_decoded,
        "p8_found": _p8_found,
        "p8_near": _p8_near,
        "p9_found": _p9_found,
        "p9_redacted": _p9_redacted,
    }


_P4 = r"""
with c as (select distinct point_id, source, lower(trim(vendor)) as v, text from chunks where vendor is not null),
l as (select point_id, source, v, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from c where text is not null),
k as (select point_id, source, v, line_no, line, trim(regexp_replace(lower(line), '[^\p{L}]+', ' ', 'g')) as norm from l),
n as (select v, count(distinct source) as sources from c group by v),
f as (select v, norm from k join n using (v) where norm <> '' group by v, norm, sources having count(distinct source) >= 3 and count(distinct source) >= 0.1 * sources),
hit as (select distinct point_id, line_no from k join f using (v, norm))
"""

_P8 = r"""
with w as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') as w from documents where text is not null),
g as (select distinct doc_id, array_to_string(list_slice(w, i, i + 11), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from w where len(w) >= 12)),
iw as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{Nd}]+') as w from eval_items where passage is not null),
ig as (select distinct item_id, array_to_string(list_slice(w, i, i + 11), ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from iw where len(w) >= 12))
select distinct doc_id, item_id from g join ig using (g)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": conversation_sql.FOUND,
        "p1_conversations": conversation_sql.SOUND,
        "p4_found": _P4 + "select point_id, cast(line_no as integer) as line_no from hit",
        "p4_cleaned": _P4
        + """, gone as (select point_id, line_no from hit)
        select o.point_id, case when g.point_id is null then o.text else coalesce(r.text, '') end as text
        from (select distinct point_id, text from chunks) o
        left join (select distinct point_id from gone) g using (point_id)
        left join (select point_id, string_agg(line, chr(10) order by line_no) as text from k anti join gone using (point_id, line_no) group by point_id) r using (point_id)""",
        "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
        "p8_found": _P8,
    }
