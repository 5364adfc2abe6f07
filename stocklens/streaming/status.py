"""Platform status polls: normalisation, changes, alerts, state; batch and streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

c = F.col

# Indicator of a status page and its status; anything else is unknown.
INDICATORS = {"none": "operational", "minor": "degraded", "major": "partial_outage", "critical": "major_outage"}
# Phrases of status feeds, first match wins.
FEED_PHRASES = [("operational", [" is operational"]), ("degraded", [" is degraded", "degraded performance"]),
                ("partial", ["partial outage"]), ("major", ["major outage"]), ("maintenance", ["maintenance"])]
CALM = ["operational", "degraded", "unknown"]
OUTAGE = ["partial_outage", "major_outage"]


def status_of(indicator: Column) -> Column:
    pairs = [F.lit(x) for kv in INDICATORS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), indicator), F.lit("unknown"))


def parse_json_poll(payload: Column) -> Column:
    """(status, status_text, indicator) of a status page answer; unreadable is unknown."""
    s = F.from_json(payload, "struct<status:struct<indicator:string,description:string>>")["status"]
    return F.struct(status_of(s["indicator"]).alias("status"),
                    F.coalesce(s["description"], F.lit("Unable to fetch status")).alias("status_text"),
                    F.coalesce(s["indicator"], F.lit("unknown")).alias("indicator"))


def parse_feed_poll(payload: Column) -> Column:
    """(status, status_text) of a status feed; the worst service decides."""
    texts = F.transform(F.regexp_extract_all(F.coalesce(payload, F.lit("")), F.lit(
        r"(?i)<description>([^<]+)</description>"), F.lit(1)), F.lower)

    def label(t: Column) -> Column:
        out = None
        for name, phrases in FEED_PHRASES:
            hit = F.lit(False)
            for p in phrases:
                hit = hit | t.contains(p)
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    labels = F.transform(texts, label)
    n = lambda *names: F.size(F.filter(labels, lambda x: x.isin(*names)))
    says = lambda word, k: F.concat(F.lit(f"{word} ("), k.cast("string"), F.lit(" services)"))
    major, partial, degraded, fine = n("major"), n("partial"), n("degraded", "maintenance"), n("operational")
    status = F.when(major > 0, "major_outage").when(partial > 0, "partial_outage").when(
        degraded > 0, "degraded").when(fine > 0, "operational").otherwise("unknown")
    text = F.when(major > 0, says("Major Outage", major)).when(partial > 0, says("Partial Outage", partial)).when(
        degraded > 0, says("Degraded", degraded)).when(fine > 0, "All Systems Operational").otherwise(
        "Unable to determine status")
    return F.struct(status.alias("status"), text.alias("status_text"))


def should_alert(previous: Column, status: Column) -> Column:
    return (previous.isNull() | previous.isin(CALM)) & status.isin(OUTAGE)


def status_changes(polls: DataFrame, state: DataFrame | None = None, block: str = "day") -> DataFrame:
    """Each poll with the previous status of its platform.

    There are few platforms, so a window per platform would be a handful of tasks. Polls are
    ordered inside (platform, day) blocks, and the last status of the block before is joined to
    them. ``state`` (platform, status) holds what was known before the first poll.
    """
    order = F.struct("ts", "poll_id")
    rows = polls.withColumn("_block", F.date_trunc(block, c("ts")))
    lasts = rows.groupBy("platform", "_block").agg(F.max_by("status", order).alias("_last"))
    carried = lasts.select("platform", "_block", F.lag("_last").over(
        Window.partitionBy("platform").orderBy("_block")).alias("_carried"))
    inside = F.lag("status").over(Window.partitionBy("platform", "_block").orderBy("ts", "poll_id"))
    joined = rows.join(carried, ["platform", "_block"]).withColumn("_inside", inside)
    before = F.coalesce("_inside", "_carried")
    if state is not None:
        # one row per platform, so this stays far below any broadcast limit; Spark checks the size
        joined = joined.join(state.select("platform", c("status").alias("_known")), "platform", "left")
        before = F.coalesce(before, c("_known"))
    out = joined.withColumn("previous", before)
    return out.select(*polls.columns, "previous",
                      (c("previous").isNull() | (c("previous") != c("status"))).alias("changed"),
                      should_alert(c("previous"), c("status")).alias("alert"))


def next_state(changes: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One row per platform after these polls: status, texts, last check, last change."""
    order = F.struct("ts", "poll_id")
    now = changes.groupBy("platform").agg(
        F.max_by("status", order).alias("status"), F.max_by("status_text", order).alias("status_text"),
        F.max_by("indicator", order).alias("indicator"), F.max("ts").alias("last_checked"),
        F.max(F.when(c("changed"), c("ts"))).alias("last_changed"))
    if state is None:
        return now
    old = state.select("platform", *[c(x).alias(f"o_{x}") for x in now.columns if x != "platform"])
    both = now.join(old, "platform", "full")
    seen = c("status").isNotNull()
    return both.select("platform", *[
        F.when(seen, c(x)).otherwise(c(f"o_{x}")).alias(x) for x in ("status", "status_text", "indicator", "last_checked")],
        F.coalesce("last_changed", "o_last_changed").alias("last_changed"))


def current_view(platforms: DataFrame, state: DataFrame) -> DataFrame:
    """All known platforms; those never polled are unknown."""
    return platforms.select("platform").join(state, "platform", "left").select(
        "platform", F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("status_text", F.lit("Not yet checked")).alias("status_text"),
        F.coalesce("indicator", F.lit("unknown")).alias("indicator"), "last_checked", "last_changed")


# What the state store keeps of a platform; times as microseconds since 1970.
STATE = "status string, status_text string, indicator string, last_checked bigint, last_changed bigint"


def _track(_key, frames, state):
    """Polls of one platform in one micro-batch, each with what was known before it; the state moves on to the last one."""
    polls = pd.concat(list(frames), ignore_index=True).sort_values(["_us", "poll_id"], kind="stable")
    known = state.get if state.exists else (None, None, None, None, None)
    if known[3] is not None:
        polls = polls[polls["_us"] > known[3]]
    if polls.empty:
        return
    before = polls["status"].shift(1).astype(object)
    before.iloc[0] = known[0]
    before = before.where(before.notna(), None)
    changed = before.isna() | (before != polls["status"])
    alert = (before.isna() | before.isin(CALM)) & polls["status"].isin(OUTAGE)
    last = polls.iloc[-1]
    moved = int(polls["_us"][changed].iloc[-1]) if changed.any() else known[4]
    state.update((last["status"], last["status_text"], last["indicator"], int(last["_us"]), moved))
    yield polls.drop(columns="_us").assign(previous=before, changed=changed.astype(bool), alert=alert.astype(bool))


def tracked(polls: DataFrame) -> DataFrame:
    """The polls of a stream with previous status, whether it changed, and whether it calls for an alert.

    The state store keeps one row per platform. Polls not newer than a platform's last check, and polls without
    a time, are ignored. A task sorts the polls of one platform in a micro-batch; the source bounds these.
    """
    out = StructType([*polls.schema.fields, StructField("previous", StringType()), StructField("changed", BooleanType()), StructField("alert", BooleanType())])
    timed = polls.filter(c("ts").isNotNull()).withColumn("_us", F.unix_micros(c("ts").cast("timestamp")))
    return timed.groupBy("platform").applyInPandasWithState(_track, out, STATE, "append", "NoTimeout")


def monitor(polls: DataFrame, folder: str, interval: str | None = "5 minutes") -> StreamingQuery:
    """A stream of polls to the table of alerts under ``folder``; the state is in the stream's checkpoint there.

    A batch that is repeated after a failure finds the state of the batch before, and its files count once. A state that
    is missing stops the stream. Without an interval all polls that are there are read, and the stream ends.
    """
    writer = tracked(polls).filter("alert").writeStream.format("parquet").outputMode("append").option(
        "path", f"{folder}/alerts").option("checkpointLocation", f"{folder}/progress")
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def read_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/alerts")


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """One row per platform, out of the state store: status, texts, last check, last change."""
    rows = spark.read.format("statestore").load(f"{folder}/progress")
    kept = c("value.groupState")
    time = lambda x: F.timestamp_micros(kept[x]).alias(x)
    return rows.select(c("key.platform").alias("platform"), kept["status"].alias("status"), kept["status_text"].alias("status_text"),
                       kept["indicator"].alias("indicator"), time("last_checked"), time("last_changed"))


# A line of a poll log: when and for whom an answer was asked for, its kind (json or feed) and its text, null if none came.
POLL_LINE = "poll_id bigint, fetched_at timestamp, platform string, kind string, body string"


def parse_poll_lines(lines: DataFrame) -> DataFrame:
    """Polls (poll_id, ts, platform, status, status_text, indicator) of the lines of a poll log.

    An answer that did not come or can't be read is a row of its own with the status unknown. A line that is no JSON
    names no platform and no time; it is left out.
    """
    r = lines.select(F.from_json("value", POLL_LINE).alias("r")).select("r.*").filter("platform is not null and fetched_at is not null")
    json, feed = parse_json_poll(c("body")), parse_feed_poll(c("body"))
    is_feed = c("kind") == "feed"
    answered = r.withColumn("json", json).withColumn("feed", feed)
    pick = lambda x: F.when(is_feed, c(f"feed.{x}")).otherwise(c(f"json.{x}")).alias(x)
    return answered.select("poll_id", c("fetched_at").alias("ts"), "platform", pick("status"), pick("status_text"),
                           F.when(is_feed, F.lit("unknown")).otherwise(c("json.indicator")).alias("indicator"))


def poll_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Polls of a growing folder of poll logs, one JSON object in a line (:data:`POLL_LINE`).

    The stream keeps the files that it has read as its offset, so each poll is read once, also after a restart. A micro-batch
    reads ``files_per_batch`` files at most, oldest first.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse_poll_lines(lines)
