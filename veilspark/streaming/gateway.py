"""The realtime gateway and its rate limit as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.engine import Policy, scan
from veilspark.plans.audit import WINDOW_SECONDS, audit_rows


def decisions(requests: DataFrame, text: str = "text", policy: Policy | None = None) -> DataFrame:
    """A stream of requests with BLOCK or ALLOW: stateless, so it scales with its partitions."""
    return scan(requests, text, policy)


def start_gateway(requests: DataFrame, out: str, checkpoint: str, policy: Policy | None = None, audit: str | None = None, org_id: int = 1, text: str = "text", **trigger):
    """Writes decisions (without the text) to out, and audit rows of what was found to audit. Batches of one number are written once each:
    a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.drop(text).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if audit:
            audit_rows(rows, "API_REALTIME_DLP_SCAN", org_id).write.mode("overwrite").parquet(f"{audit}/batch={number}")
        rows.unpersist()

    return decisions(requests, text, policy).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def request_rates(requests: DataFrame, key: str, ts: str = "ts", seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(key, window_start, requests) of fixed windows; counts are kept for twice the window's length of late events."""
    counts = requests.withWatermark(ts, f"{2 * seconds} seconds").groupBy(F.window(ts, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("requests"))
    return counts.select(key, F.col("w.start").alias("window_start"), "requests")


def over_limit(requests: DataFrame, key: str, limit: int, ts: str = "ts", seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Windows of keys that went over the limit; a limit of 0 is 1000."""
    return request_rates(requests, key, ts, seconds).filter(F.col("requests") > (limit or 1000))
