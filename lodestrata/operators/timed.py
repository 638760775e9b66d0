"""Transcripts, dialogues and other rows in order of time.

Rows are ordered within parts of a video or session and joined at the seams, so no video or session has to fit one task. Null
texts have no lines; equal starts are ordered by id; repeated rows count each unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import before, checkpointed, numbered

#: Seconds of a video that are ordered together.
PART_SECONDS = 300
#: Rows of a video that are folded together.
PART_ROWS = 5000
#: What a transcript writes for a term, and the term, in order; names of products are a matter of the corpus, so rules can be given.
GLOSSARY = [("hand eye", "hand-eye"), ("fire wall", "firewall"), ("point clouds?", "point cloud"), ("back up image", "backup image"), ("homoids", "humanoids"), ("cuttingedge", "cutting-edge")]


def cue_line(line: Column) -> Column:
    """Without tags, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, "<[^>]*>", ""), r"[ \t]+", " "))


def seconds_of_clock(clock: Column) -> Column:
    """[hh:]mm:ss[.fff] in seconds; null for anything else."""
    part = lambda i: F.nullif(F.regexp_extract(clock, r"^(?:([0-9]{1,3}):)?([0-9]{1,2}):([0-9]{1,2}(?:[.,][0-9]{1,3})?)$", i), F.lit(""))
    return F.coalesce(part(1).cast("double"), F.lit(0.0)) * 3600 + part(2).cast("double") * 60 + F.replace(part(3), F.lit(","), F.lit(".")).cast("double")


def glossed(text: Column, rules: list[tuple[str, str]] | None = None) -> Column:
    """The text with each rule's spelling replaced, in order, whatever its capitals."""
    for pattern, term in GLOSSARY if rules is None else rules:
        text = F.regexp_replace(text, rf"(?i)\b{pattern}\b", term)
    return text


def collapsed(lines: Column) -> Column:
    """Rolling captions: of lines in a row of which one begins like the other, whatever their capitals, the longer one stays."""
    alike = lambda a, b: F.startswith(F.lower(a), F.lower(b)) | F.startswith(F.lower(b), F.lower(a))
    last = lambda kept: F.try_element_at(kept, F.lit(-1))
    put = lambda kept, x: F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))
    step = lambda kept, x: F.when((F.size(kept) == 0) | ~alike(last(kept), x), F.concat(kept, F.array(x))).when(F.length(x) > F.length(last(kept)), put(kept, x)).otherwise(kept)
    return F.aggregate(F.filter(lines, lambda x: x != ""), F.array().cast("array<string>"), step)


def fresh_lines(cues: DataFrame) -> DataFrame:
    """video_id, cue_id, start, end, lines: each cue's collapsed lines that no line of the cue before begins with, whatever its capitals."""
    start = F.coalesce("start_seconds", F.lit(0.0))
    lines = collapsed(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), cue_line))
    rows = cues.where("video_id is not null").select("video_id", F.floor(start / PART_SECONDS).alias("part"), start.alias("start"), F.coalesce("end_seconds", start).alias("end"), "cue_id", lines.alias("lines"))
    rows = rows.where(F.size("lines") > 0)
    both = before(rows, "video_id", "lines", "seen", ["start", "cue_id"])
    fresh = F.filter("lines", lambda x: ~F.exists(F.coalesce("seen", F.array().cast("array<string>")), lambda s: F.startswith(F.lower(s), F.lower(x))))
    return both.select("video_id", "cue_id", "start", "end", fresh.alias("lines"))


def spoken_cues(cues: DataFrame) -> DataFrame:
    """video_id, cue_id, start, end, text: what each cue says anew, as one line; cues that say nothing are left out."""
    text = F.trim(F.regexp_replace(F.array_join("lines", " "), r"\s+", " "))
    return fresh_lines(cues).select("video_id", "cue_id", "start", "end", text.alias("text")).where("text != ''")


Row = tuple[int, float, float, str]


def _folded(cues: DataFrame, fold: Callable[[list[Row], list], tuple[list, list]], part_rows: int) -> DataFrame:
    """video_id, window_no, start, end, text of windows that depend on where the one before ended.

    fold takes rows (position, start, end, text) and the state, and gives finished windows and the state after them. Videos are
    cut into parts of part_rows rows; the parts with one number are folded together, all videos at once, and hand one state row a video to
    the next, so that no task ever holds more than a part. Most videos are one part.
    """
    placed = checkpointed(numbered(cues.select("video_id", "cue_id", "start", "end", "text"), ["video_id"], ["start", "cue_id"], "pos").withColumn("part", F.floor(F.col("pos") / part_rows)))
    last = placed.agg(F.max("part")).first()[0]
    schema = "video_id string, state boolean, window_no bigint, start double, end double, text string, chars bigint, carried string"

    def run(key: tuple, rows: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        state = kept.iloc[0][["window_no", "start", "end", "text", "chars", "carried"]].tolist() if len(kept) else None
        done, state = fold(list(zip(rows["pos"], rows["start"], rows["end"], rows["text"], strict=True)), state)
        out = [(key[0], False, *w, 0, "") for w in done] + ([(key[0], True, *state)] if state else [])
        return pd.DataFrame(out, columns=["video_id", "state", "window_no", "start", "end", "text", "chars", "carried"])

    spark = cues.sparkSession
    state, out = spark.createDataFrame([], schema), None
    for i in range(0 if last is None else last + 1):
        part = placed.where(F.col("part") == i).select("video_id", "pos", "start", "end", "text")
        held = state.join(part.select("video_id").distinct(), "video_id", "left_semi")
        over = state.join(part.select("video_id").distinct(), "video_id", "left_anti")
        step = checkpointed(part.groupBy("video_id").cogroup(held.groupBy("video_id")).applyInPandas(run, schema).unionByName(over))
        done = step.where("not state")
        out = done if out is None else out.unionByName(done)
        state = step.where("state")
    all_rows = state if out is None else out.unionByName(state)
    return all_rows.where("text != ''").select("video_id", "window_no", "start", "end", "text")


def packed_windows(cues: DataFrame, chars: int = 1500, overlap: int = 150, part_rows: int = PART_ROWS) -> DataFrame:
    """video_id, window_no, start, end, text: cues packed in order up to so many characters, each window after the first
    beginning with the last characters of the one before. A cue longer than that is a window of its own."""

    def fold(rows: list[Row], state: list | None) -> tuple[list, list]:
        done = []
        no, begin, end, text, count, _ = state or [0, None, None, "", 0, ""]
        for _, s, e, cue in rows:
            extra = len(cue) + bool(text)
            if text and count + extra > chars:
                done.append((no, begin, end, text))
                tail = text[-overlap:].strip() if overlap else ""
                no, begin, text, count = no + 1, s, tail, len(tail)
            begin, end, text, count = s if begin is None else begin, e, f"{text} {cue}" if text else cue, count + extra
        return done, [no, begin, end, text, count, ""]

    return _folded(cues, fold, part_rows)


def span_windows(cues: DataFrame, seconds: float = 45.0, part_rows: int = PART_ROWS) -> DataFrame:
    """video_id, window_no, start, end, text: cues joined in order as long as they end within so many seconds of the window's first start."""

    def fold(rows: list[Row], state: list | None) -> tuple[list, list]:
        done = []
        no, begin, end, text, _, _ = state or [0, None, None, "", 0, ""]
        for _, s, e, cue in rows:
            if begin is not None and e - begin > seconds:
                done.append((no, begin, end, text))
                no, begin, text = no + 1, s, ""
            begin, end, text = s if begin is None else begin, e, f"{text} {cue}" if text else cue
        return done, [no, begin, end, text, 0, ""]

    return _folded(cues, fold, part_rows)


def time_windows(cues: DataFrame, seconds: int = 45) -> DataFrame:
    """video_id, window_no, first_cue_id, start, end, n_cues of each span of so many seconds that has cues."""
    rows = cues.where("video_id is not null and start_seconds is not null")
    return rows.groupBy("video_id", F.floor(F.col("start_seconds") / seconds).alias("window_no")).agg(F.min_by("cue_id", F.struct("start_seconds", "cue_id")).alias("first_cue_id"), F.min("start_seconds").alias("start"), F.max(F.greatest("start_seconds", "end_seconds")).alias("end"), F.count(F.lit(1)).alias("n_cues"))


def evenly_spaced(cues: DataFrame, most: int = 60) -> DataFrame:
    """video_id, cue_id, pos of at most so many rows a video, evenly spread (half to even), the first and the last among them."""
    rows = numbered(cues.where("video_id is not null").select("video_id", F.coalesce("start_seconds", F.lit(0.0)).alias("start"), "cue_id"), ["video_id"], ["start", "cue_id"], "pos")
    sizes = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    picks = sizes.withColumn("k", F.least("n", F.lit(most))).select("video_id", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1), lambda i: F.when(F.col("k") == 1, F.lit(0).cast("bigint")).otherwise(F.bround(i * (F.col("n") - 1) / (F.col("k") - 1)).cast("bigint")))).alias("pos")).distinct()
    return rows.join(picks, ["video_id", "pos"]).select("video_id", "cue_id", "pos")


def recent_history(messages: DataFrame, turns: int = 6, chars: int = 4000) -> DataFrame:
    """session_id, id, content: the last turns of user and assistant, newest first up to so many characters.

    The message at the limit keeps its beginning and an ellipsis. Only the newest turns of a session are ever ordered
    together: each part of a session hands on as many as can count.
    """
    rows = messages.where("session_id is not null and role in ('user', 'assistant') and content != '' and created_at is not null").select("session_id", "id", "content", "created_at")
    salted = Window.partitionBy("session_id", "salt").orderBy(F.desc("created_at"), F.desc("id"))
    first = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= turns)
    newest = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    kept = first.drop("n", "salt").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= turns)
    spent = kept.withColumn("spent", F.sum(F.length("content")).over(newest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("spent") - F.length("content"))
    cut = F.when(F.col("spent") > chars, F.concat(F.substr("content", F.lit(1), (F.lit(chars) - F.col("before")).cast("int")), F.lit("…"))).otherwise(F.col("content"))
    return spent.where(F.col("before") < chars).select("session_id", "id", cut.alias("content"))
