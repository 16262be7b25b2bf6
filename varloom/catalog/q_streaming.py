"""Streaming jobs driven over the given event tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from varloom.catalog.registry import query
from varloom.session import scratch_path
from varloom.streaming import jobs


def _paths(t, name):
    root = scratch_path(t.spark, f"{name}-{uuid.uuid4().hex[:8]}")
    return f"{root}/in", f"{root}/out", f"{root}/state"


def _events(t):
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("str_incremental_counts", "", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def str_incremental_counts(t):
    src, out, state = _paths(t, "counts")
    _events(t).repartition(4, "event_id").write.parquet(src)
    return jobs.incremental_counts(jobs.event_stream(t.spark, src, files_per_batch=1), ["user_id", "event_type"], out, state)


@query("str_dedup_events", "", "SELECT DISTINCT event_id, user_id, event_type, round(value,6) AS value FROM events")
def str_dedup_events(t):
    src, out, state = _paths(t, "dedup")
    ev = _events(t)
    ev.unionByName(ev.filter("event_id % 3 = 0")).repartition(4, "event_id").write.parquet(src)
    return jobs.deduplicated(jobs.event_stream(t.spark, src), ["event_id"], "1 hour", out, state).select("event_id", "user_id", "event_type", "value")


@query("str_burden_windows", "", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, user_id, count(*) AS n, round(sum(value),6) AS total FROM events GROUP BY ALL")
def str_burden_windows(t):
    src, out, state = _paths(t, "windows")
    _events(t).repartition(2, "event_id").write.parquet(src)
    w = jobs.burden_windows(jobs.event_stream(t.spark, src), "user_id", "1 hour", "1 day", out, state)
    return w.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))
