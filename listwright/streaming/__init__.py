"""Event streams: choices, heartbeats, rate limits, job states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The event types that are kept, and the limits of the online service.
EVENT_TYPES = ("choice", "reveal", "regenerate", "abandon")
HEARTBEAT_S, WINDOW_S, KEPT_JOBS = 10, 3600, 50


def allowed(events: DataFrame, types: tuple[str, ...] = EVENT_TYPES) -> DataFrame:
    """X-07, K-12: events of known types; the others are dropped, never an error. Batch or stream."""
    return events.where(F.col("event_type").isin(*types))


def append_once(events: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """X-09: each key once, within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def agreement(events: DataFrame, time: str, agreed: str, every: str = "1 day") -> DataFrame:
    """X-08: the share of choices that agreed with the ranking, by window."""
    return events.groupBy(F.window(time, every).alias("w")).agg(F.count(agreed).alias("n"), F.avg(F.col(agreed).cast("int")).alias("rate")).select(F.col("w.start").alias("start"), "n", "rate")


def first_choice(events: DataFrame, job: str, choice: str, time: str) -> DataFrame:
    """X-05: the first choice of a job stands; later ones change nothing."""
    return events.groupBy(job).agg(F.min_by(choice, F.struct(time, choice)).alias("choice"))


def latest_status(events: DataFrame, job: str, status: str, time: str, tie: str) -> DataFrame:
    """X-03: a job's status is that of its last event."""
    return events.groupBy(job).agg(F.max_by(status, F.struct(time, tie)).alias("status"))


def evicted(jobs: DataFrame, created: str, key: str, kept: int = KEPT_JOBS) -> DataFrame:
    """X-04: jobs beyond the most recent ones."""
    return jobs.join(jobs.orderBy(F.desc(created), F.desc(key)).limit(kept), key, "left_anti")


def assembled(choices: DataFrame, ranking: DataFrame) -> DataFrame:
    """X-06: a choice event joined to the server's ranking: rank, shown position, whether it was the first choice.
    choices: job, chosen, shown (array); ranking: job, display_id, rank."""
    ranks = ranking.withColumnRenamed("display_id", "chosen")
    shown = F.nullif(F.array_position("shown", F.col("chosen")), F.lit(0)) - 1
    return choices.join(ranks, ["job", "chosen"], "left").select("job", "chosen", F.col("rank").alias("chosen_rank"), shown.cast("int").alias("shown_position"), (F.col("rank") == 1).alias("agreed_top1"))


def rate_limited(calls: DataFrame, token: str, time: str, most: int, window_s: int = WINDOW_S) -> DataFrame:
    """X-02: calls with allowed: at most `most` allowed calls of a token within the window; refused ones don't count, and an
    allowed call leaves the window when it is older than it. Calls of a token go through in time order."""

    def each(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.Timestamp] = []  # at most `most`
        span = pd.Timedelta(seconds=window_s)
        for part in parts:
            out = []
            for at in part[time]:
                held = [t for t in held if at - t <= span]
                ok = len(held) < most
                if ok:
                    held.append(at)
                out.append(ok)
            yield part.assign(allowed=out)

    return _in_order(calls, token, time, each, "allowed boolean")


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def spaced(calls: DataFrame, host: str, time: str, gap_s: float, tie: str) -> DataFrame:
    """X-10: calls with starts_at: the earliest time that keeps a gap to the host's call before. Unrolled, the recurrence says
    that call n starts n gaps after the latest of all (time - its number * gap) up to it: a running maximum."""
    w, gap = Window.partitionBy(host).orderBy(time, tie), int(gap_s * 1_000_000)
    n = F.row_number().over(w).cast("long") * gap
    late = F.max(_micros(time) - F.col("__n")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("__n", n).withColumn("starts_at", F.timestamp_micros(late + F.col("__n")).cast(calls.schema[time].dataType)).drop("__n")


def _in_order(rows: DataFrame, by: str, time: str, each, new: str) -> DataFrame:
    """Run a function over each key's rows in order of time, batch by batch, so that no key is held whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for key, part in b.groupby(by, sort=False, dropna=False):
                if key not in held:
                    held.clear()  # rows are sorted by key: earlier keys are over
                    box: list[pd.DataFrame] = []
                    held[key] = (box, each((key,), _pulled(box)))
                box, out = held[key]
                box.append(part)
                yield next(out)

    shape = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.repartition(by).sortWithinPartitions(by, time).mapInPandas(run, f"{shape}, {new}")


def _pulled(box: list) -> Iterator[pd.DataFrame]:
    while True:
        yield box.pop(0)


def heartbeats(times: list[float], end: float, every: float = HEARTBEAT_S) -> list[float]:
    """X-01: when heartbeats are due between messages at given times (sorted): after each `every` seconds of silence."""
    out, last = [], 0.0
    for t in [*times, end]:
        while last + every <= t and not (t in times and last + every == t):
            last += every
            out.append(last)
        last = t
    return out


def beats(messages: DataFrame, job: str, time: str, tie: str, every_s: int = HEARTBEAT_S) -> DataFrame:
    """X-01 on a table: (job, beats) due between the messages of each job, one after each `every_s` seconds of silence; a
    message at that very moment stands for it."""
    silence = _micros(time) - F.lag(_micros(time)).over(Window.partitionBy(job).orderBy(time, tie))
    due = F.greatest(F.lit(0), F.ceil(silence / (every_s * 1_000_000)) - 1)
    return messages.withColumn("__due", F.coalesce(due, F.lit(0))).groupBy(job).agg(F.sum("__due").cast("long").alias("beats"))


def job_stream(messages: DataFrame, job: str = "job", kind: str = "kind", every_ms: int = HEARTBEAT_S * 1000) -> DataFrame:
    """X-01 on a stream: messages of each job pass through; a job that is silent for a while gets a heartbeat; done and
    error end it. State for a job is its count of messages."""

    def each(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame({"job": [key[0]], "kind": ["heartbeat"]})
            state.setTimeoutDuration(every_ms)
            return
        seen, over = state.get[0] if state.exists else 0, False
        for part in parts:
            seen += len(part)
            over |= bool(part[kind].isin(["done", "error"]).any())
            yield pd.DataFrame({"job": part[job], "kind": part[kind]})
        if over:
            state.remove()
        else:
            state.update((seen,))
            state.setTimeoutDuration(every_ms)

    return messages.groupBy(job).applyInPandasWithState(each, "job string, kind string", "seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def append_sink(events: DataFrame, path: str, checkpoint: str, types: tuple[str, ...] = EVENT_TYPES):
    """K-12: an append-only event log as Parquet, exactly once by its checkpoint; returns the started query."""
    return allowed(events, types).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def recent(jobs: DataFrame, created: str, n: int) -> DataFrame:
    """T-04: the most recent jobs."""
    return jobs.orderBy(F.desc(created)).limit(n)


def running_total(events: DataFrame, by: str, time: str, tie: str) -> DataFrame:
    """X-03: how many events of its key came up to each one."""
    return events.withColumn("n_so_far", F.count(F.lit(1)).over(Window.partitionBy(by).orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)))
