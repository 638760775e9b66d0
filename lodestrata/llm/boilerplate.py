"""Problem 6: the main body of web pages, by a style tree of each site."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, join_checked
from .common import is_blank, lines_of

#: Pages that a tree compares, as if so many were drawn from each site; entropies are in units of theirs, so sites of any size are judged alike.
REFERENCE_PAGES = 500
#: Branches below this composite importance are removed.
LEAST_IMPORTANCE = 0.5
#: The part of the presentation above a node in its composite importance; the rest is that of its content.
PRESENTATION_WEIGHT = 0.1
#: The key of the tree of all pages.
MERGED = 0
#: Pages that must share a node before it counts as repeated at all.
LEAST_PAGES = 3

_GAP = r" {2,}|\t+|\s+[|·•]\s+"
_STEP = r"\s+(?:>|»|›|/|→)\s+"


def plain_form(line: Column, vendor: Column) -> Column:
    """Lower case, single spaces, the vendor's own name masked."""
    text = F.trim(F.regexp_replace(F.lower(line), r"[  ]+", " "))
    return F.when(F.length(F.coalesce(vendor, F.lit(""))) > 2, F.replace(text, vendor, F.lit("~"))).otherwise(text)


def style_of(line: Column) -> Column:
    """The presentation of a line: pager, arrow, item, path, menu, sentence, labelled or plain."""
    text = F.trim(line)
    return (
        F.when(text.rlike(r"^(?:\d+|…|\.\.\.|[«»‹›<>|])(?:\s+(?:\d+|…|\.\.\.|[«»‹›<>|]))+$"), "pager")
        .when(text.rlike(r"^[«‹←]\s|\s[»›→]$"), "arrow")
        .when(text.rlike(r"^(?:[-*•–]|\d+[.)])\s"), "item")
        .when(text.rlike(r"\S(?: {2,}|\t+|\s+[|·•]\s+)\S"), "menu")
        .when(text.rlike(r"\S\s+(?:>|»|›|/|→)\s+\S"), "path")
        .when(text.rlike(r"[.!?…][\"”»)\]]*$"), "sentence")
        .when(text.rlike(r"^[^:]{1,40} ?: \S"), "labelled")
        .otherwise("plain")
    )


def page_lines(chunks: DataFrame) -> DataFrame:
    """One row a line of the stored chunks with a url: where it stands, its style and its plain form."""
    rows = chunks.where("url is not null and text is not null")
    last_steps = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(_STEP)), lambda x: F.lower(F.trim(F.element_at(F.split(x, _STEP), F.lit(-1)))))
    rows = rows.select(
        "point_id",
        F.xxhash64("source").alias("page"),
        F.xxhash64(F.lit("host"), F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))).alias("host"),
        F.xxhash64(F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("lang"),
        F.lower(F.trim("vendor")).alias("vendor"),
        F.array_append(F.coalesce(last_steps, F.array().cast("array<string>")), F.lower(F.trim(F.coalesce("section", F.lit(""))))).alias("titles"),
        F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"),
        "text",
    )
    keep = ["point_id", "page", "host", "lang", "vendor", "titles", "chunk_index"]
    lines = lines_of(rows, *keep).where(~is_blank(F.col("line")))
    return lines.select("point_id", "page", "host", "lang", "chunk_index", "line_no", style_of(F.col("line")).alias("style"), plain_form(F.col("line"), F.col("vendor")).alias("form"), F.lower(F.trim("line")).alias("low"), F.array_contains("titles", F.lower(F.trim("line"))).alias("titled"))


def with_nodes(lines: DataFrame) -> DataFrame:
    """Adds nodes: of the style tree, the content (whole line), the links of a menu or path and the frame of a line.

    A link is an element of its own, whatever line holds it; all else stands below the style of its line. A sentence or item has only its content; digits are masked elsewhere. A frame is the label before the colon, the sign
    at the start, the first three words, or the first two and the last.
    """
    masked = F.regexp_replace("form", r"\d+", "#")
    links = F.transform(F.split(F.when(F.col("style") == "path", F.split("low", _STEP)[0]).otherwise(F.col("low")), _GAP), lambda x: F.concat(F.lit("link "), F.regexp_replace(F.trim(x), r"\d+", "#")))
    words = F.split(masked, " ")
    frame = lambda *parts: F.concat(F.lit("frame "), *parts)
    framed = F.array(
        frame(F.concat_ws(" ", F.slice(words, 1, 2)), F.lit(" .. "), F.element_at(words, F.lit(-1))),
        frame(F.concat_ws(" ", F.slice(words, 1, 3)), F.lit(" ..")),
        F.when(F.col("style") == "labelled", frame(F.regexp_extract(masked, r"^([^:]*:)", 1))).when(masked.rlike(r"^[^\p{L}#]"), frame(F.left(masked, F.lit(1)))).otherwise(frame(F.lit("-"))),
    )
    content = F.concat(F.lit("all "), F.when(F.col("style").isin("sentence", "item"), F.col("form")).otherwise(masked))
    nodes = (
        F.when(F.col("style").isin("sentence", "item"), F.array(content))
        .when(F.col("style") == "menu", F.array_union(F.array(content), links))
        .when(F.col("style") == "path", links)
        .when(F.col("style").isin("pager", "arrow"), F.array(F.concat(F.lit("style "), F.col("style"))))
        .when(F.size(words) < 3, F.array_union(F.array(content), links))
        .otherwise(F.array_union(F.array(content), F.array_remove(framed, "frame -")))
    )
    hashed = F.transform(nodes, lambda n: F.struct(F.xxhash64(n).alias("node"), (~n.startswith("frame ")).alias("sure"), F.when(n.startswith("link "), "link").otherwise(F.col("style")).alias("above")))
    return lines.withColumn("nodes", hashed).drop("form", "low")


def _trees() -> Column:
    """The trees a line counts in: its host's, the merged one of its language, and that of all pages."""
    return F.array("host", "lang", F.lit(MERGED).cast("bigint"))


def entropies(lines: DataFrame) -> DataFrame:
    """tree, above, node, sure, pages, n, h: how often a node stands below a style in the pages of a tree, and the entropy of the pages it stands on.

    Occurrences are counted a page before the shuffle; h = log n - sum(c log c) / n over the counts c of its pages.
    Path lines don't count, for their words prove nothing.
    """
    on_page = lines.where("style != 'path'").select("host", "lang", "page", F.inline("nodes").alias("node", "sure", "above")).groupBy("above", "node", "sure", "host", "lang", "page").agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c")
    by_node = on_page.select(F.explode(_trees()).alias("tree"), "above", "node", "sure", "c").groupBy("tree", "above", "node", "sure").agg(F.count(F.lit(1)).alias("pages"), n.alias("n"), (F.log(n) - F.sum(F.col("c") * F.log("c")) / n).alias("h"))
    return by_node


def presentations(nodes: DataFrame) -> DataFrame:
    """tree, above, diversity: the importance of a style node, the entropy of the contents below it: 1 where all differ, 0 where one fills it."""
    total = F.sum("n")
    h = (F.log(total) - F.sum(F.col("n") * F.log("n")) / total) / F.log(total)
    return nodes.where("sure").groupBy("tree", "above").agg(F.when(total > 1, h).otherwise(1.0).alias("diversity"))


def unimportant_nodes(lines: DataFrame, least: float = LEAST_IMPORTANCE, weight: float = PRESENTATION_WEIGHT) -> DataFrame:
    """tree, above, node of low composite importance: of the tree of each host and of the merged trees of each language and of all.

    A site's pages are merged into a tree of styles (the presentation of lines), with the contents, links and frames of
    lines as nodes below them. The importance of a node is one less the entropy of the pages it stands on, in units of that of
    REFERENCE_PAGES pages: what all pages of a site show evenly says nothing. The composite importance adds that of the
    presentation above it: a style whose contents all differ speaks for a node, one that repeats itself against it. The
    merged trees come out as one, for hosts with few pages.
    """
    nodes = entropies(lines)
    totals = lines.select("host", "lang", "page").distinct().select(F.explode(_trees()).alias("tree"), "page").groupBy("tree").agg(F.count(F.lit(1)).alias("all_pages"))
    above = presentations(nodes).join(totals, "tree").join(lines.select(F.col("host").alias("tree")).distinct().withColumn("own", F.lit(True)), "tree", "left")
    own = (F.log("all_pages") - F.col("h")) / math.log(REFERENCE_PAGES)
    composite = (1 - weight) * own + weight * F.col("diversity")
    rows = join_checked(nodes.where(F.col("pages") >= LEAST_PAGES), above, ["tree", "above"], "inner", salt_by="node")
    return rows.where(composite < least).select(F.when(F.col("own"), F.col("tree")).otherwise(MERGED).alias("tree"), "above", "node").distinct()


def furniture(chunks: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """point_id, line_no of the lines of web pages that aren't main body.

    A line goes if its branch has low importance: its content; a link of a menu; the first link of a path; for other lines
    but sentences and items its frame or style, unless it is the title: the first line of its page of that kind, or one
    that the section or the end of a path repeats. Blank lines, null texts and rows without url give no rows; chunks stored
    twice count once; hosts with few pages lean on the tree of their language; other columns are ignored.
    """
    lines = checkpointed(with_nodes(page_lines(chunks)))
    low = unimportant_nodes(lines, least)
    rows = lines.select("point_id", "line_no", "style", "titled", F.array("host", F.lit(MERGED).cast("bigint")).alias("trees"), F.inline("nodes").alias("node", "sure", "above"))
    rows = rows.select("point_id", "line_no", "style", "titled", "node", "sure", "above", F.explode("trees").alias("tree"))
    hits = join_checked(rows, low, ["tree", "above", "node"], "left_semi", salt_by="point_id").groupBy("point_id", "line_no", "style", "titled").agg(F.bool_or("sure").alias("sure"))
    hits = checkpointed(hits)
    at = ["point_id", "line_no"]
    open_ = lines.where("style in ('plain', 'labelled')").join(hits.where("sure"), at, "left_anti")
    first = open_.groupBy("page").agg(F.min(F.struct("chunk_index", "line_no", "point_id")).alias("f")).where("f.chunk_index = 0").select("f.point_id", "f.line_no")
    sure = hits.where("sure and not (titled and style in ('plain', 'labelled'))").select(*at)
    framed = hits.where("not sure and not titled").select(*at).join(first, at, "left_anti")
    return sure.unionByName(framed).distinct()


def main_body(chunks: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """point_id, text of each stored chunk with a url, without its furniture; null texts stay null."""
    gone = furniture(chunks, least).groupBy("point_id").agg(F.collect_set("line_no").alias("gone"))
    once = chunks.where("url is not null").select("point_id", "text").dropDuplicates(["point_id"])
    left = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    return once.join(gone, "point_id", "left").select("point_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))
