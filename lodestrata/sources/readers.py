"""Readers of lists, JSON lines, WebVTT and HTML, and writers that replace a table as a whole."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timed import cue_line, seconds_of_clock


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file; for files that fit a row, such as lists, cue files and pages."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, entry: trimmed lines without blanks and comments (#), each entry of a file once, at its first line."""
    lines = whole_files(spark, path).select("path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("line_no", "line"))
    kept = lines.select("path", "line_no", F.trim("line").alias("entry")).where("entry != '' and not startswith(entry, '#')")
    return kept.groupBy("path", "entry").agg(F.min("line_no").alias("line_no")).select("path", "line_no", "entry")


def required_entries(spark: SparkSession, path: str) -> DataFrame:
    """list_entries; an error where a list has none."""
    entries = list_entries(spark, path)
    if entries.isEmpty():
        raise ValueError(f"no entries in {path}")
    return entries


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """path, kind (html, pdf or text) and text of each file; pdf files have no text here, their bytes go to a reader of their own."""
    kind = lambda c: F.when(F.lower(c).rlike(r"\.html?$"), "html").when(F.lower(c).endswith(".pdf"), "pdf").otherwise("text")
    files = whole_files(spark, path).withColumn("kind", kind(F.col("path")))
    return files.select("path", "kind", F.when(F.col("kind") != "pdf", F.col("text")).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with the given fields and malformed: the line as it stands where it can't be read, else null."""
    rows = spark.read.text(path).select(F.trim("value").alias("value")).where("value != '' and not startswith(value, '#')")
    parsed = rows.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.select("r.*", F.col("r._bad").alias("malformed")).drop("_bad")


def json_map(text: Column) -> Column:
    """A map of strings; empty for null or malformed text."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def vtt_files(spark: SparkSession, path: str) -> DataFrame:
    """video_id, lang, path, text of the cue file to use for each video: en before en-orig, other languages dropped."""
    name = F.regexp_extract("path", r"([^/]+)\.vtt$", 1)
    files = whole_files(spark, path).withColumn("video_id", F.regexp_extract(name, r"^(.*?)(?:\.[A-Za-z-]+)?$", 1)).withColumn("lang", F.regexp_extract(name, r"\.([A-Za-z-]+)$", 1))
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "en-orig", 1)
    best = files.where(rank.isNotNull()).groupBy("video_id").agg(F.min_by(F.struct("lang", "path", "text"), F.struct(rank, "path")).alias("f"))
    return best.select("video_id", "f.lang", "f.path", "f.text")


def vtt_cues(files: DataFrame) -> DataFrame:
    """video_id, cue_no, start_seconds, end_seconds, text of each cue; notes, styles and cues without a time are left out."""
    blocks = files.select("video_id", F.posexplode(F.split("text", r"(?:\r?\n){2,}")).alias("cue_no", "block"))
    time = r"((?:[0-9]+:)?[0-9]+:[0-9]+[.,][0-9]+)\s+-->\s+((?:[0-9]+:)?[0-9]+:[0-9]+[.,][0-9]+)[^\n]*\n?"
    clock = lambda i: seconds_of_clock(F.regexp_extract("block", time, i))
    lines = F.split(F.regexp_extract("block", rf"(?s){time}(.*)$", 3), r"\r?\n")
    text = F.array_join(F.filter(F.transform(lines, cue_line), lambda x: x != ""), "\n")
    return blocks.where(F.col("block").rlike(time)).select("video_id", "cue_no", clock(1).alias("start_seconds"), clock(2).alias("end_seconds"), text.alias("text"))


class _Sections(HTMLParser):
    """Collects the text below each heading; script, style, navigation and comments are left out."""

    SKIP = {"script", "style", "nav", "header", "footer", "iframe", "noscript", "template", "head"}
    HEADINGS = {"h1", "h2", "h3", "h4"}
    BLOCKS = {"p", "div", "li", "br", "tr", "section", "article", "ul", "ol", "table", "blockquote", "pre"}

    def __init__(self) -> None:
        super().__init__()
        self.found: list[list[str]] = [["", ""]]
        self.skipped, self.heading = 0, False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.SKIP:
            self.skipped += 1
        elif tag in self.HEADINGS:
            self.found.append(["", ""])
            self.heading = True
        elif tag in self.BLOCKS:
            self.found[-1][1] += "\n"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in self.HEADINGS:
            self.heading = False
        elif tag in self.BLOCKS:
            self.found[-1][1] += "\n"

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.found[-1][0 if self.heading else 1] += data


def html_sections(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages but html, with section_no, heading and body of each section that holds something.

    Inline elements don't split a paragraph; blocks end one; white space is squeezed; a null page has no sections.
    """

    @F.pandas_udf("array<struct<heading:string,body:string>>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                parser = _Sections()
                parser.feed(t or "")
                parser.close()
                squeezed = [(" ".join(h.split()), "\n".join(filter(None, (" ".join(x.split()) for x in b.split("\n"))))) for h, b in parser.found]
                out.append([{"heading": h or None, "body": b} for h, b in squeezed if h or b])
            yield pd.Series(out, dtype=object)

    rest = [c for c in pages.columns if c != html]
    return pages.select(*rest, F.posexplode(split(html)).alias("section_no", "s")).select(*rest, "section_no", "s.heading", "s.body")


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Writes df as a new version below root and names it as the current one; what is being read is never overwritten."""
    df.write.mode("errorifexists").parquet(f"{root}/{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{root}/_current")
    return f"{root}/{version}"


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{spark.read.text(f'{root}/_current').first().value}")
