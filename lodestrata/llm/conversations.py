"""Problem 1: chat messages, stored as rows, back into whole conversations."""

from __future__ import annotations

import sys
from datetime import timezone

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import seconds_of
from ..session import fresh_dir
from ..streaming.events import read_stream, run_to_end, with_end
from .common import is_blank

#: Spellings of the roles, in lower case without outer blanks.
ROLE_SPELLINGS = {
    "user": ["user", "usr", "human", "customer"],
    "assistant": ["assistant", "ai", "bot", "model"],
    "system": ["system", "sys"],
}
#: Length of the event-time window that holds one part of a session in state.
PART = "10 minutes"
#: How long the watermark waits for late rows in a running stream, and how long a silent conversation stays open.
DELAY, IDLE = "1 day", "1 day"


def role_of(role: Column) -> Column:
    """user, assistant or system; null for anything else."""
    known = F.create_map(*[F.lit(x) for name, spellings in ROLE_SPELLINGS.items() for s in spellings for x in (s, name)])
    return known[F.lower(F.trim(role))]


def prepared(messages: DataFrame, untimed_at: Column) -> DataFrame:
    """Messages with a session and content, roles and times in one form.

    ts is the event time; a message without time has that of its arrival, untimed_at, and no at.
    """
    at = seconds_of(F.col("created_at"))
    return messages.where(F.col("session_id").isNotNull() & ~is_blank(F.col("content"))).select(
        "session_id",
        "id",
        F.col("role").alias("raw_role"),
        role_of(F.col("role")).alias("role"),
        "content",
        at.alias("at"),
        F.coalesce(F.timestamp_micros((at * 1e6).cast("bigint")), untimed_at).alias("ts"),
    )


def buffered(rows: DataFrame, part: str = PART, delay: str = DELAY) -> DataFrame:
    """Keyed streaming state: the messages of each session and window of event time, emitted when the watermark closes it.

    Rows that come late wait in the state of their window; rows behind the watermark are dropped and counted by Spark
    (numRowsDroppedByWatermark). Of messages alike in session, role, content and time the first id counts. A session is
    split by windows, so that none has to fit one group. Of messages without time only their role is kept, once a window:
    they break their conversation.
    """
    timed = F.col("at").isNotNull()
    entry = F.struct(F.coalesce("at", F.lit(-1.0)).alias("at"), F.when(timed, F.col("raw_role")).alias("raw_role"), F.when(timed, F.col("content")).otherwise("").alias("content"), F.when(timed, F.col("id")).alias("id"), "role", (~timed).alias("no_time"))
    parts = rows.withWatermark("ts", delay).groupBy("session_id", F.window("ts", part).alias("part")).agg(F.sort_array(F.collect_set(entry)).alias("all"))
    same = lambda x, y: (x["at"] == y["at"]) & x["raw_role"].eqNullSafe(y["raw_role"]) & (x["content"] == y["content"]) & ~x["no_time"]
    once = F.filter("all", lambda x, i: (i == 0) | ~same(x, F.element_at("all", F.greatest(i, F.lit(1)))))
    message = lambda x: F.struct(x["at"].alias("at"), x["id"].alias("id"), x["role"].alias("role"), x["content"].alias("content"), x["no_time"].alias("no_time"))
    return parts.select("session_id", F.window_time("part").alias("ts"), F.sort_array(F.transform(once, message)).alias("messages"))


#: One letter for each kind of message; y is a system message without time, x another that breaks the conversation.
LETTERS = {"user": "u", "assistant": "a", "system": "s"}
#: What breaks a conversation or leaves a user without reply inside a part, and where one message follows another (^ and $ are its ends).
BROKEN, UNANSWERED, PRESENT = "[xy]|[ua]s|[sa]a", "u[us]", "[uax]"
BREAKS, LEAVES = {"us", "as", "sa", "aa", "^a"}, {"uu", "us", "u$"}


def summarised(parts: DataFrame) -> DataFrame:
    """One short row a part: its first and last letter and what its letters say among themselves."""
    letter = lambda m: F.when(m["no_time"], F.when(m["role"] == "system", "y").otherwise("x")).otherwise(F.coalesce(*[F.when(m["role"] == k, v) for k, v in LETTERS.items()], F.lit("x")))
    rows = parts.select("session_id", "ts", F.array_join(F.transform("messages", letter), "").alias("r"))
    return rows.select("session_id", "ts", F.left("r", F.lit(1)).alias("first"), F.right("r", F.lit(1)).alias("last"), F.col("r").rlike(PRESENT).alias("present"), F.col("r").rlike(BROKEN).alias("broken"), F.col("r").rlike(UNANSWERED).alias("unanswered"))


class Conversation(StatefulProcessor):
    """The state of one conversation: its last letter and what has been seen; a timer on event time closes it.

    Parts come in order of time, for a window closes only once the watermark has passed it; those of one batch are sorted
    here, a short row each. When the watermark has passed the last part by idle seconds, the verdict is emitted and the
    state is dropped (at once, where it has passed when the part comes); a session that speaks again after that is a new
    conversation.
    """

    def __init__(self, idle_seconds: int):
        self.idle_ms = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "last string, present boolean, broken boolean, unanswered boolean, closes bigint")

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:
            return iter(())
        last, present, broken, unanswered, closes = self.kept.get() or ("^", False, False, False, 0)
        ends = closes
        for r in sorted(rows, key=lambda r: r.ts):
            broken = broken or r.broken or last + r.first in BREAKS
            unanswered = unanswered or r.unanswered or last + r.first in LEAVES
            present = present or r.present
            last = r.last
            ends = max(ends, int(r.ts.replace(tzinfo=timezone.utc).timestamp() * 1000) + self.idle_ms)
        if ends < timerValues.getCurrentWatermarkInMs():
            if closes:
                self.handle.deleteTimer(closes)
                self.kept.clear()
            return iter((self.verdict(key, last, present, broken, unanswered),))
        if ends != closes:
            if closes:
                self.handle.deleteTimer(closes)
            self.handle.registerTimer(ends)
        self.kept.update((last, present, broken, unanswered, ends))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, present, broken, unanswered, _ = self.kept.get()
        self.kept.clear()
        yield self.verdict(key, last, present, broken, unanswered)

    def verdict(self, key, last, present, broken, unanswered) -> Row:
        return Row(session_id=key[0], present=present, broken=broken, unanswered=unanswered or last + "$" in LEAVES)

    def close(self) -> None:
        pass


def closed(summaries: DataFrame, idle: int) -> DataFrame:
    """session_id, present, broken, unanswered of each conversation, emitted when it has been silent for idle seconds.

    The processor travels by value: the worker that sets up its state beside the driver doesn't see files added to the session.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    return summaries.groupBy("session_id").transformWithState(Conversation(idle), "session_id string, present boolean, broken boolean, unanswered boolean", "Append", "EventTime")


_PARTS = "session_id string, ts timestamp, messages array<struct<at:double,id:bigint,role:string,content:string,no_time:boolean>>"


def _span(spark: SparkSession, path: str) -> tuple[Column, int]:
    """The last event time of a table and the seconds between its first and last."""
    at = seconds_of(F.col("created_at"))
    r = spark.read.parquet(path).agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    return F.timestamp_micros(F.lit(int((r.b or 0.0) * 1e6))), int((r.b or 0.0) - (r.a or 0.0)) + 1


def _messages(spark: SparkSession, path: str, files_per_batch: int | None, delay: str | None) -> tuple[DataFrame, str, int]:
    latest, span = _span(spark, path)
    return prepared(read_stream(spark, path, files_per_batch), latest), delay or f"{span + 3600} seconds", span + 3600


def run_bounded(spark: SparkSession, path: str, part: str = PART, delay: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """session_id, present, broken, unanswered of all sessions in a folder of parquet files, by one stream with two keyed states.

    The files of a table come in any order of time, so the watermark waits for the table's whole span and a conversation
    stays open until the end of input; files_per_batch bounds what a batch reads. State and output lie in the shared folder.
    With a delay, as for files in order of time, what comes later than that is dropped.
    """
    out = fresh_dir(spark, "conversations")
    rows, wait, span = _messages(spark, path, files_per_batch, delay)
    rows, end = with_end(rows, out)
    return run_to_end(closed(summarised(buffered(rows, part, wait)), span), end, out)


def run_parts(spark: SparkSession, path: str, part: str = PART, delay: str | None = None, files_per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The parts with their messages, written by a first stream, and the verdicts that a second one makes of their summaries.

    So the messages of a long session stay spread over its parts; only a short row a part meets in the session's state.
    """
    out = fresh_dir(spark, "parts")
    rows, wait, span = _messages(spark, path, files_per_batch, delay)
    rows, end = with_end(rows, out)
    parts = run_to_end(buffered(rows, part, wait), end, out)
    then = fresh_dir(spark, "conversations")
    summaries, end = with_end(summarised(spark.readStream.schema(_PARTS).parquet(f"{out}/rows")), then)
    return parts, run_to_end(closed(summaries.withWatermark("ts", f"{span + 3600} seconds"), span), end, then)


def judged(verdicts: DataFrame, messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, defect of every conversation; defect is null where it is sound."""
    known = sessions.where("session_id is not null").select("session_id").distinct().withColumn("known", F.lit(True))
    named = messages.where("session_id is not null").select("session_id").distinct()
    all_ids = known.join(named, "session_id", "full_outer").join(verdicts, "session_id", "left")
    defect = (
        F.when(~F.coalesce("present", F.lit(False)), "empty")
        .when(F.col("known").isNull() | F.col("broken"), "broken")
        .when(F.col("unanswered"), "missing_reply")
    )
    return all_ids.select("session_id", defect.alias("defect"))


def broken_conversations(spark: SparkSession, messages_path: str, sessions: DataFrame, part: str = PART, files_per_batch: int | None = None, delay: str | None = None) -> DataFrame:
    """session_id, defect (empty, broken or missing_reply, the first that holds) of the conversations to drop.

    Messages without session are left out; null, blank and repeated messages don't count; messages without time break
    their conversation; equal times are ordered by id; empty tables give an empty result; other columns are ignored.
    """
    verdicts = run_bounded(spark, messages_path, part, delay, files_per_batch)
    return judged(verdicts, spark.read.parquet(messages_path), sessions).where("defect is not null")


def sound_conversations(spark: SparkSession, messages_path: str, sessions: DataFrame, part: str = PART, files_per_batch: int | None = None) -> DataFrame:
    """session_id, seq (from 1), role, content, created_at (seconds) of each message of the sound conversations, in order."""
    parts, verdicts = run_parts(spark, messages_path, part, None, files_per_batch)
    sound = judged(verdicts, spark.read.parquet(messages_path), sessions).where("defect is null").select("session_id")
    order = Window.partitionBy("session_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.select("session_id", "ts", F.coalesce(F.sum(F.size("messages")).over(order), F.lit(0)).alias("offset"))
    rows = parts.join(sound, "session_id").join(sizes, ["session_id", "ts"]).select("session_id", "offset", F.posexplode("messages").alias("i", "m"))
    return rows.select("session_id", (F.col("offset") + F.col("i") + 1).alias("seq"), "m.role", "m.content", F.col("m.at").alias("created_at"))
