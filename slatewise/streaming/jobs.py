"""Structured Streaming jobs; every function takes a streaming or a batch frame of events and returns one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from slatewise.functions import scalars as S
from slatewise.sources import files


def events_stream(spark: SparkSession, path: str, schema: StructType | str, *, per_trigger: int = 1, fmt: str = "parquet") -> DataFrame:
    """The event log as a stream of files; delivery is at least once, so see `without_repeats`."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def parse_events(raw: DataFrame) -> DataFrame:
    """Typed events from string columns: item ids of digits only, session falling back to user, bad JSON empty; rows without session or item go."""
    extra = F.coalesce(F.from_json("extra", "map<string,string>"), F.create_map().cast("map<string,string>"))
    item = F.when(F.col("item_id").rlike(r"^\d+$"), F.col("item_id").try_cast("long"))
    ts = F.coalesce(F.try_to_timestamp("ts"), F.current_timestamp())
    rows = raw.withColumn("item_id", item).withColumn("ts", ts).withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), F.col("user_id"))).withColumn("extra", extra)
    return rows.filter("session_id is not null and item_id is not null")


def without_repeats(events: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark; later events are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def trending_now(events: DataFrame, *, length: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Weighted counts per item in sliding windows; old events age out one by one."""
    rows = events.withWatermark("ts", delay).groupBy(F.window("ts", length, slide), "item_id").agg(F.sum(S.event_weight(F.col("event_type"))).alias("score"))
    return rows.select(F.col("window.start").alias("window_start"), "item_id", "score")


def recent_items(events: DataFrame, *, n: int = 50, idle: str = "7 days", distinct: bool = False) -> DataFrame:
    """(session_id, ids): a session's newest items first, kept as state until it is idle."""
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: list[tuple[int, int]] = list(zip(*state.get, strict=True)) if state.exists else []
        for pdf in pdfs:
            held += [(int(t.value), int(i)) for t, i in zip(pdf["ts"], pdf["item_id"], strict=True)]
        held.sort(reverse=True)
        if distinct:
            seen: set[int] = set()
            held = [x for x in held if not (x[1] in seen or seen.add(x[1]))]
        held = held[:n]
        state.update(([t for t, _ in held], [i for _, i in held]))
        state.setTimeoutTimestamp(max(held[0][0] // 1_000_000, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame({"session_id": [key[0]], "ids": [[i for _, i in held]]})

    marked = events.withWatermark("ts", "1 hour").select("session_id", "item_id", "ts")
    return marked.groupBy("session_id").applyInPandasWithState(update, "session_id string, ids array<bigint>", "times array<bigint>, ids array<bigint>", "update", GroupStateTimeout.EventTimeTimeout)


def session_counts(events: DataFrame, *, gap: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("n"))
    return rows.select("session_id", F.col("session_window.start").alias("started"), "n")


def click_through(impressions: DataFrame, *, length: str = "1 hour") -> DataFrame:
    """Impressions, clicks and their ratio by source and position in tumbling windows."""
    rows = impressions.withWatermark("ts", "1 hour").groupBy(F.window("ts", length), "source", "position").agg(F.count_if(F.col("event_type") == "view").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    return rows.select(F.col("window.start").alias("window_start"), "source", "position", "impressions", "clicks", F.when(F.col("impressions") == 0, 0.0).otherwise(F.col("clicks") / F.col("impressions")).alias("ctr"))


def matched_clicks(requests: DataFrame, clicks: DataFrame, *, within: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(request_id, source, ts, position, item_id, click_id, clicked_at): each item of each request's list with the clicks that followed it.

    requests: (request_id, user_id, source, ts, items); clicks: (click_id, user_id, item_id, ts). A click belongs to every showing
    of its item to its user at most `within` before it; a showing that no click followed comes once with nulls, as soon as the
    watermark of both streams has passed its time. Clicks later than `delay` are dropped, so state is bounded by time alone.
    Positions count from 0; a null or empty list shows nothing, and a null user or item is never matched (such clicks don't move the watermark). Batch frames work alike.
    """
    shown = requests.withWatermark("ts", delay).select("request_id", "user_id", "source", "ts", F.posexplode("items").alias("position", "item_id"))
    after = clicks.withColumnsRenamed({"user_id": "_user", "item_id": "_item", "ts": "clicked_at"}).withWatermark("clicked_at", delay).select("click_id", "_user", "_item", "clicked_at")
    same = F.expr(f"user_id = _user AND item_id = _item AND clicked_at >= ts AND clicked_at <= ts + INTERVAL {within}")
    return shown.join(after, same, "left_outer").select("request_id", "source", "ts", "position", "item_id", "click_id", "clicked_at")


def share_alert(metrics: DataFrame, hit: str, *, length: str, limit: float, keys: tuple[str, ...] = (), exclude: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """Windows with the share of rows that meet `hit` (an SQL condition), by keys, and whether it is over the limit."""
    rows = metrics if not exclude else metrics.filter(~F.col(keys[0]).isin(*exclude))
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.withWatermark("ts", "1 hour").groupBy(window, *keys).agg(F.count("*").alias("n"), F.avg(F.expr(f"double({hit})")).alias("share"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", "share", (F.col("share") > limit).alias("alert"))


def mean_alert(metrics: DataFrame, column: str, *, length: str, least: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Windows whose mean falls under `least`."""
    out = metrics.withWatermark("ts", "1 hour").groupBy(F.window("ts", length), *keys).agg(F.avg(column).alias("mean"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "mean", (F.col("mean") < least).alias("alert"))


def quantile_alert(metrics: DataFrame, column: str, *, length: str, limit: float, q: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    out = metrics.withWatermark("ts", "1 hour").groupBy(F.window("ts", length), *keys).agg(F.percentile_approx(column, q, 10_000).alias("p"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "p", (F.col("p") > limit).alias("alert"))


def write_events(rows: DataFrame, path: str, *, keep_days: int | None = None, now: Column | None = None) -> None:
    """Append events; retention is by time, counted back from `now` (the current time)."""
    kept = rows if keep_days is None else rows.filter(F.col("ts") >= (F.current_timestamp() if now is None else now) - F.make_interval(days=F.lit(keep_days)))
    kept.write.mode("append").parquet(path)


def commit_batch(rows: DataFrame, n: int, path: str, *, query: str = "events") -> None:
    """Put batch `n` of a stream under its query and number, as a new attempt; the attempt counts once all its files are there.

    A batch that comes again after a failure, whether it died half-way or only its acknowledgement was lost, takes the place of
    its earlier attempts, and readers see one whole attempt or the other. One run of a query writes at a time.
    """
    there = files.whole_folders(rows.sparkSession, path, f"query={query}/batch={n}/attempt=*")
    attempt = 1 + max((int(f.rsplit("=", 1)[1]) for f in there), default=0)
    rows.write.mode("overwrite").parquet(f"{path}/query={query}/batch={n}/attempt={attempt}")


def committed_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of every batch that `commit_batch` put at `path`, each batch by its latest whole attempt."""
    latest: dict[str, int] = {}
    for f in files.whole_folders(spark, path, "query=*/batch=*/attempt=*"):
        batch, attempt = f.rsplit("/attempt=", 1)
        latest[batch] = max(latest.get(batch, 0), int(attempt))
    reader = spark.read.schema(schema)
    return reader.parquet(*[f"{b}/attempt={a}" for b, a in sorted(latest.items())]) if latest else spark.createDataFrame([], schema)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append") -> None:
    """Run a stream over what is there, each batch to the sink, acknowledged by the checkpoint after it."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
