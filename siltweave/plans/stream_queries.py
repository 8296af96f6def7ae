"""Streaming programs run to the end of the stored input, their results read back."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweave.io import table
from siltweave.plans.registry import query
from siltweave.session import shared_folder
from siltweave.streaming import pipelines


def _log(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.new_pages(spark, os.path.join(d, "fetch_log.parquet"), table(spark, d, "fetch_log").schema, files_per_batch=None)


def _finish(spark: SparkSession, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all input there is; each batch replaces or adds to a table in the shared folder."""
    folder = shared_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        out = f"{folder}/out" if mode == "complete" else f"{folder}/out/batch={number}"
        batch.write.mode("overwrite").parquet(out)

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("""
select domain, status, count(*) as n, max(ts) as last from fetch_log group by all""")
def stream_status_counters(spark: SparkSession, d: str) -> DataFrame:
    """STM1, STM3, AGG1: counters kept over micro-batches of stored fetches."""
    counted = _log(spark, d).groupBy("domain", "status").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return _finish(spark, counted, "complete", "counters").select("domain", "status", "n", "last")


@query("""
with h as (select domain, ts from fetch_log where http_status = 429 or error_type = 'rate_limited'),
g as (select domain, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 3 hour then 1 else 0 end as fresh from h window w as (partition by domain order by ts)),
s as (select domain, ts, sum(fresh) over (partition by domain order by ts rows unbounded preceding) as k from g)
select domain, min(ts) as began, max(ts) + interval 3 hour as until, count(*) as n from s group by domain, k""")
def stream_cooldowns(spark: SparkSession, d: str) -> DataFrame:
    """STM5: rate-limit sessions as the stream sees them. Sessions of all time are given out, so state is one row a session."""
    return _finish(spark, pipelines.cooldowns(_log(spark, d)), "complete", "cooldowns").select("domain", F.col("began").cast("timestamp_ntz").alias("began"), F.col("until").cast("timestamp_ntz").alias("until"), "n")


@query("select distinct url, engine, status, ts from fetch_log")
def stream_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """STM2: fetches without the rows that were delivered again; state older than the watermark leaves."""
    log = _log(spark, d).select("url", "engine", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "30 days")
    once = log.dropDuplicatesWithinWatermark(["url", "engine", "status", "ts"])
    return _finish(spark, once, "append", "once").select("url", "engine", "status", F.col("ts").cast("timestamp_ntz").alias("ts"))
