"""Sliding quotas over event time: how many of a user's requests are accepted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, SECONDS = 20, 300


def trailing_count(events: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """Events with the number of the same user's events in the seconds up to them."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(w))


def accept(times: list[float], held: list[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Whether each request, in order, is accepted; refused ones take no room."""
    out = []
    for t in times:
        held = [h for h in held if t - h <= seconds]
        ok = len(held) < limit
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


def accepted(events: DataFrame, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """(event_id, user, accepted) over a finished table. Rows are streamed in order of user
    and time, and only a window of at most ``limit`` times is held."""
    rows = events.select("user", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id").repartition("user").sortWithinPartitions("user", "at", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = object(), []
        for b in batches:
            users, at, ids = (b.column(i).to_pylist() for i in range(3))
            out = []
            for u, t in zip(users, at):
                if u != now:
                    now, held = u, []
                (ok,), held = accept([t], held, limit, seconds * 1_000_000)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), pa.array(out, pa.bool_())], ["event_id", "user", "accepted"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"event_id {kinds['event_id']}, user {kinds['user']}, accepted boolean")


def accept_stream(events: DataFrame, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """The same over a stream (event_id, user, ts): accepted times are kept as state."""

    def step(key, frames, state):
        held = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        times = frame["ts"].astype("int64") / 1e9 if str(frame["ts"].dtype).endswith("[ns]") or "ns" in str(frame["ts"].dtype) else frame["ts"].map(lambda t: t.timestamp())
        ok, held = accept(list(times), held, limit, seconds)
        state.update((held,))
        yield pd.DataFrame({"event_id": frame["event_id"].to_numpy(), "user": frame["user"].to_numpy(), "accepted": ok})

    kind = dict(events.dtypes)["user"]
    return events.groupBy("user").applyInPandasWithState(step, f"event_id bigint, user {kind}, accepted boolean", "held array<double>", "append", "NoTimeout")


def tumbling(events: DataFrame, seconds: int = 25) -> DataFrame:
    """(start, n, users): events in windows that follow one another."""
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user").alias("users")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "users")


def failures(events: DataFrame, limit: int = 10, seconds: int = SECONDS) -> DataFrame:
    """(event_id, by, blocked): attempts (event_id, user, ip, ts, ok) refused because their user
    or address failed ``limit`` times in the seconds before, since their last success."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    out = None
    for by in ("user", "ip"):
        w = Window.partitionBy(by).orderBy(at, "event_id")
        streak = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = events.withColumn("_at", at).withColumn("_since", F.coalesce(streak, F.lit(0)))
        v = Window.partitionBy(by, "_since").orderBy("_at").rangeBetween(-seconds * 1_000_000, -1)
        one = marked.select("event_id", F.lit(by).alias("by"), (F.count_if(~F.col("ok")).over(v) >= limit).alias("blocked"))
        out = one if out is None else out.unionByName(one)
    return out
