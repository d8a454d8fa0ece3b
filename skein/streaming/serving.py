"""Serving state over event tables and streams: token buckets, request metrics, incremental upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def bucket_step(tokens: float, last: float, now: float, rate: float, burst: float) -> tuple[bool, float, float]:
    """Whether a request passes, the seconds to wait if it doesn't, and the tokens left."""
    tokens = min(burst, tokens + max(0.0, now - last) * rate)
    if tokens >= 1:
        return True, 0.0, tokens - 1
    return False, (1 - tokens) / rate, tokens


def limit_requests(events: DataFrame, rate: float, burst: float, idle: float = 300.0) -> DataFrame:
    """``(client, ts, request_id, allowed, wait)`` for ``(client, ts, request_id)``, a batch or a stream.

    The state of a client is its tokens and last time; it expires after `idle`
    seconds without events, when its bucket is full again anyway. A stream that
    takes what is available and stops waits for that too, unless
    ``spark.sql.streaming.noDataMicroBatches.enabled`` is false. In a batch
    each micro-batch is all input; the rows of a client are handled in order of
    time.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        pdf = pd.concat(list(frames)).sort_values(["ts", "request_id"])
        ok, wait = [], []
        for t in pdf["ts"].astype("int64") / 1e9 if str(pdf["ts"].dtype).startswith("datetime64[ns") else pdf["ts"].map(lambda x: x.timestamp()):
            a, w, tokens = bucket_step(tokens, t if last is None else last, t, rate, burst)
            last = t if last is None else max(last, t)
            ok.append(a)
            wait.append(w)
        state.update((float(tokens), float(last)))
        state.setTimeoutDuration(int(idle * 1000))
        yield pdf.assign(client=key[0], allowed=ok, wait=wait)[["client", "ts", "request_id", "allowed", "wait"]]

    rows = events.select("client", "ts", "request_id").filter("client IS NOT NULL AND ts IS NOT NULL")
    out = "client string, ts timestamp, request_id bigint, allowed boolean, wait double"
    return rows.groupBy("client").applyInPandasWithState(step, out, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def limit_requests_batch(events: DataFrame, rate: float, burst: float) -> DataFrame:
    """The same over a batch.

    After a pause in which the bucket fills up whatever was left, a client's
    events no longer depend on those before: they are cut there, and the
    stretches are spread over the tasks. A task walks through its stretches in
    order of time, batch by batch, and holds no more than a bucket.
    """
    rows = events.select("client", "ts", "request_id").filter("client IS NOT NULL AND ts IS NOT NULL")
    w = Window.partitionBy("client").orderBy("ts", "request_id")
    now = F.unix_micros("ts")
    full = F.coalesce((now - F.lag(now).over(w)) / 1e6 * rate >= burst, F.lit(True))
    cut = rows.withColumn("full", full.cast("int")).withColumn("stretch", F.sum("full").over(w))
    cut = cut.repartition("client", "stretch").sortWithinPartitions("client", "stretch", "ts", "request_id").withColumn("us", F.unix_micros("ts"))

    def run(batches):
        key, tokens, last = None, float(burst), 0.0
        for b in batches:
            ok, wait = [], []
            for client, stretch, us in zip(b.column("client").to_pylist(), b.column("stretch").to_pylist(), b.column("us").to_pylist()):
                t = us / 1e6
                if (client, stretch) != key:
                    key, tokens, last = (client, stretch), float(burst), t
                passed, seconds, tokens = bucket_step(tokens, last, t, rate, burst)
                last = t
                ok.append(passed)
                wait.append(seconds)
            yield pa.RecordBatch.from_arrays([b.column("client"), b.column("ts"), b.column("request_id"), pa.array(ok, pa.bool_()), pa.array(wait, pa.float64())], names=["client", "ts", "request_id", "allowed", "wait"])

    return cut.select("client", "stretch", "ts", "request_id", "us").mapInArrow(run, "client string, ts timestamp, request_id bigint, allowed boolean, wait double")


def client_ip(forwarded: str, real: str) -> Column:
    """First forwarded address, else the real one, else the local host."""
    first = F.trim(F.element_at(F.split(F.col(forwarded), ","), 1))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.trim(F.col(real)), F.lit("")), F.lit("127.0.0.1"))


def normalize_path(path: str) -> Column:
    return F.regexp_replace(F.col(path), r"^/vectors/(?!batch$|upsert$|text$|text/)[^/]+", "/vectors/:id")


def request_metrics(requests: DataFrame, window: str | None = None) -> DataFrame:
    """Counts and latency percentiles by method, path and status, per time window if one is given."""
    rows = requests.withColumn("path", normalize_path("path"))
    keys = ["method", "path", "status"]
    group = rows.groupBy(F.window("ts", window).alias("window"), *keys) if window else rows.groupBy(*keys)
    return group.agg(F.count("*").alias("requests"), F.avg("latency").alias("mean_latency"), *[F.percentile_approx("latency", p / 100, 10_000).alias(f"p{p}") for p in (50, 95, 99)])


def upsert_stream(stream: DataFrame, collection, checkpoint: str):
    """Micro-batches of ``(id, vector, tags)`` upserted into a collection; a batch that is retried changes nothing more."""
    return stream.writeStream.foreachBatch(lambda df, _: collection.upsert(df)).option("checkpointLocation", checkpoint).start()
