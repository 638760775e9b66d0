"""Documents into sections, steps and chunks.

A null or empty text gives no rows; each stored document is split on its own, by array functions or in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 1500, 150
#: Fixed value: how a numbered step begins.
STEP = r"(?i)(?:^|\n)\s*(?:Step\s+)?[0-9]{1,2}[.):]\s+"


def steps(documents: DataFrame) -> DataFrame:
    """doc_id, part_no, text: a procedure (two numbered steps or more) cut before each step, without what stands before the first; else the whole text."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    marked = F.split(F.regexp_replace(text, f"({STEP})", "\u0001$1"), "\u0001", -1)
    cut = F.filter(F.transform(F.slice(marked, 2, F.size(marked)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = documents.where("text is not null").select("doc_id", text.alias("t"), F.when(F.size(marked) < 3, F.array(text)).otherwise(cut).alias("parts")).where("t != ''")
    return rows.select("doc_id", F.posexplode("parts").alias("part_no", "text"))


def sections(documents: DataFrame) -> DataFrame:
    """doc_id, section_no, heading, n_lines: a short line without a full stop after a blank line opens a section; each stored row on its own."""
    lines = F.split("text", "\n", -1)
    is_heading = lambda x, i: (F.length(F.trim(x)) > 0) & (F.length(x) <= 80) & ~x.rlike(r"[.:;,!?0-9)]\s*$") & ~x.rlike(r"^\s*(?:[-*]|[0-9]+[.)])") & ((i == 0) | (F.trim(F.element_at(lines, F.greatest(i, F.lit(1)))) == ""))
    marked = F.transform(lines, lambda x, i: F.when(is_heading(x, i), F.struct(i.alias("line_no"), F.trim(x).alias("heading"))))
    per = documents.where("text != ''").select("doc_id", F.size(lines).alias("n"), F.filter(marked, lambda x: x.isNotNull()).alias("hs"))
    ends = F.transform("hs", lambda h, i: F.struct((i + 1).alias("section_no"), h["heading"].alias("heading"), (F.coalesce(F.try_element_at("hs", i + 2)["line_no"], F.col("n")) - h["line_no"]).alias("n_lines")))
    lead = F.struct(F.lit(0).alias("section_no"), F.lit(None).cast("string").alias("heading"), F.coalesce(F.try_element_at("hs", F.lit(1))["line_no"], F.col("n")).alias("n_lines"))
    return per.select("doc_id", F.explode(F.concat(F.array(lead), ends)).alias("x")).where("x.n_lines > 0").select("doc_id", "x.section_no", "x.heading", "x.n_lines")


def clean_heading(raw: Column) -> Column:
    """A heading without signs of emphasis, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, "[*_`]", ""), r"\s+", " "))


def markdown_sections(documents: DataFrame) -> DataFrame:
    """doc_id, section_no, heading, body: text below each heading of one to six #; fences hide headings, lines that are only an image are dropped.

    Section 0 is what stands before the first heading. Lines of one text are numbered by array functions: the fences before a
    line say whether it is code, the headings before it which section it belongs to.
    """
    lines = F.split("text", r"\r?\n", -1)
    fenced = F.aggregate(lines, F.struct(F.lit(False).alias("code"), F.array().cast("array<struct<line:string,code:boolean>>").alias("out")), _fence_step, lambda acc: acc["out"])
    heading = lambda s: F.when(~s["code"] & s["line"].rlike(r"^#{1,6}\s+\S"), clean_heading(F.regexp_replace(s["line"], r"^#{1,6}\s+|\s*#*\s*$", "")))
    rows = documents.where("text != ''").select("doc_id", F.posexplode(fenced).alias("line_no", "s")).where(F.col("s.code") | ~F.trim("s.line").rlike(r"^!\[[^\]]*\]\([^)]*\)$"))
    rows = rows.select("doc_id", "line_no", "s.line", heading(F.col("s")).alias("heading"))
    no = F.count("heading").over(Window.partitionBy("doc_id").orderBy("line_no"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("heading").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = rows.withColumn("section_no", no).groupBy("doc_id", "section_no").agg(F.max("heading").alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    return out.where("body != '' or heading is not null")


def _fence_step(acc: Column, line: Column) -> Column:
    """Turns code on and off at each fence; a fence itself counts as code."""
    fence = F.ltrim(line).startswith("```")
    return F.struct(F.when(fence, ~acc["code"]).otherwise(acc["code"]).alias("code"), F.concat(acc["out"], F.array(F.struct(line.alias("line"), (acc["code"] | fence).alias("code")))).alias("out"))


def pieces(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of at most size characters that cover the text; each goes back up to overlap characters into the one before.

    A span ends at the last paragraph, line or space in its second half, else at size.
    """
    out: list[tuple[int, int]] = []
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in ("\n\n", "\n", " "):
                at = text.rfind(mark, start + size // 2, end)
                if at > start:
                    end = at + len(mark)
                    break
        out.append((start, end))
        if end == len(text):
            break
        back = text.find(" ", max(end - overlap, start + 1), end)
        start = back + 1 if back >= 0 else end
    return out


def chunked(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_index, start, stop, text of the pieces of each text, stripped; blank pieces are left out."""

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start": a, "stop": b} for a, b in pieces(t, size, overlap)] for t in texts], dtype=object)

    rows = documents.where("text != ''").select("doc_id", "text", F.posexplode(spans("text")).alias("chunk_index", "s"))
    piece: Column = F.trim(F.substr("text", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")))
    return rows.select("doc_id", "chunk_index", "s.start", "s.stop", piece.alias("text")).where("text != ''")
