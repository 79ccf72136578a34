"""Scans of files as they arrive, and a limit of requests for each client."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lintel.operators import detect
from lintel.sources import files as sources


def watch(spark: SparkSession, folder: str, sink: str, checkpoint: str, skipped: str | None = None, **trigger):
    """Scans Parquet files of (path, content) as they come; findings are appended by batch.

    Fingerprints need the findings of one file together and a file comes whole,
    so no state is kept between batches. Files that are left out (too large, excluded, binary) go
    to `skipped` as (path, reason), by batch as well.
    """
    stream = spark.readStream.schema("path string, content string").parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        files = df.select("path", F.encode("content", "UTF-8").alias("content")).withColumn("size", F.octet_length("content").cast("long"))
        kept = sources.admitted(files)
        text, errors = sources.readable(kept)
        if skipped:
            out = sources.left_out(files, kept).unionByName(errors.select(F.col("file").alias("path"), F.col("message").alias("reason")))
            out.write.mode("overwrite").parquet(f"{skipped}/batch={number}")
        found = detect.scan(sources.parsed(text))
        found.write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a batch that is run again replaces itself

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _limit(events: pd.DataFrame, start, used: int, limit: int, seconds: int):
    """Allowed or not for one client's events in order; the window restarts, full, once it has run out."""
    out = []
    for at in events["ts"]:
        if start is None or at - start >= pd.Timedelta(seconds=seconds):
            start, used = at, 0
        used += 1
        out.append(used <= limit)
    return out, start, used


def rate_limited(events: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """(event_id, user_id, allowed) of a table of (event_id, user_id, ts), each client on its own.

    A window begins where the last one has run out, so a client's events are a
    chain; they pass by in order, batch after batch, and only the last client's
    window is kept, however many events one client has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, start, used = None, None, 0
        for pdf in batches:
            allowed: list[bool] = []
            for user, part in pdf.groupby("user_id", sort=False, dropna=False):
                if last is None or not (user == last[0] or pd.isna(user) and pd.isna(last[0])):
                    start, used = None, 0
                last = (user,)
                own, start, used = _limit(part, start, used, limit, seconds)
                allowed += own
            yield pdf[["event_id", "user_id"]].assign(allowed=allowed)

    ordered = events.select("event_id", "user_id", "ts").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return ordered.mapInPandas(run, "event_id long, user_id long, allowed boolean")


def rate_limited_stream(events: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """The same of a stream; a client's window is its state and goes when event time has passed it."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = (pd.Timestamp(state.get[0], unit="ns"), state.get[1]) if state.exists else (None, 0)
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        allowed, start, used = _limit(pdf, start, used, limit, seconds)
        state.update((start.value, used))
        state.setTimeoutTimestamp(max(int(start.value // 1_000_000) + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        yield pdf[["event_id", "user_id"]].assign(allowed=allowed)

    grouped = events.select("event_id", "user_id", "ts").withWatermark("ts", f"{seconds} seconds").groupBy("user_id")
    return grouped.applyInPandasWithState(run, "event_id long, user_id long, allowed boolean", "start long, used int", "append", GroupStateTimeout.EventTimeTimeout)
