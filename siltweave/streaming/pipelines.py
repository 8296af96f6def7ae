"""Structured Streaming counterparts: incremental fetch and convert, cooldowns, issue states, progress (STM1 to STM7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from siltweave.operators.lifecycle import STEPS


def new_pages(spark: SparkSession, path: str, schema, files_per_batch: int | None = 64) -> DataFrame:
    """Stored pages as they arrive, each file once; the batch size bounds the work in flight (STM2, STM3). Without one all
    files there are make a batch, as a replay of a store needs whose files aren't in order of time: no row is late then.

    The path becomes a pattern, as a stream takes a table of a single file only by pattern.
    """
    if not any(c in path for c in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def convert_incrementally(pages: DataFrame, convert: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Convert each micro-batch and write it under its batch number, so a repeated batch overwrites itself (STM1)."""

    def write(batch: DataFrame, number: int) -> None:
        convert(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_versions(pages: DataFrame, late: str = "7 days") -> DataFrame:
    """The first arrival of each page; state older than the watermark is dropped (STM2)."""
    return pages.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["platform", "domain", "title"])


def cooldowns(log: DataFrame, gap: str = "3 hours", late: str = "2 days") -> DataFrame:
    """Rate-limit sessions of each site; rows ingested late by more than ``late`` are ignored (STM5)."""
    hits = log.where("http_status = 429 or error_type = 'rate_limited'").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return hits.groupBy("domain", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("domain", F.col("w.start").alias("began"), F.col("w.end").alias("until"), "n")


def status_windows(log: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Fetches of each site and status in tumbling windows (an extension, not a counterpart)."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "domain", "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("began"), "domain", "status", "n")


def issue_states(events: DataFrame) -> DataFrame:
    """(issue, state, n_steps) after each batch of transitions (issue, ts, state); illegal steps are ignored (STM6, KI3)."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("open", 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "state"])
        for s in rows["state"]:
            if s in STEPS.get(now, ()):
                now, n = s, n + 1
        state.update((now, n))
        yield pd.DataFrame({"issue": [key[0]], "state": [now], "n_steps": [n]})

    return events.groupBy("issue").applyInPandasWithState(step, "issue long, state string, n_steps int", "state string, n_steps int", "update", "NoTimeout")


class Progress(StreamingQueryListener):
    """Rows seen so far, reported every ``every`` rows (STM7)."""

    def __init__(self, report: Callable[[int], None], every: int = 50):
        self.report, self.every, self.rows = report, every, 0

    def onQueryStarted(self, event) -> None:
        self.rows = 0

    def onQueryProgress(self, event) -> None:
        before = self.rows // self.every
        self.rows += event.progress.numInputRows
        if self.rows // self.every > before:
            self.report(self.rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
