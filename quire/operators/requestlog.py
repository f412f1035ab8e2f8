"""Request logs: what each attempt was, how each request ended, counts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default and largest retry budget.
DEFAULT_RETRIES = 2
MAX_RETRIES = 5


def attempt_class() -> Column:
    """timeout, error, http_500, http, empty or ok, from timed_out, error, status, body_len."""
    status = F.col("status")
    return (
        F.when(F.col("timed_out"), "timeout")
        .when(F.col("error").isNotNull(), "error")
        .when(status == 500, "http_500")
        .when(~status.between(200, 299), "http")
        .when(F.coalesce(F.col("body_len"), F.lit(0)) == 0, "empty")
        .otherwise("ok")
    )


def retryable() -> Column:
    """Whether an attempt that ended this way is tried again."""
    again = (F.col("status") == 429) | F.col("status").between(500, 599)
    kind = F.col("class")
    return kind.isin("timeout", "error", "empty") | (kind.isin("http", "http_500") & again)


def classified(log: DataFrame) -> DataFrame:
    """``log(request_key, attempt_id, ts, status, timed_out, error, body_len)`` with class, retryable."""
    return log.withColumn("class", attempt_class()).withColumn("retryable", retryable())


def outcomes(log: DataFrame, retries: int = DEFAULT_RETRIES) -> DataFrame:
    """Final outcome per request: request_key, outcome, success, attempts.

    Only the first ``retries + 1`` attempts of a request can matter; the rank filter is
    applied before the exchange, so a request with very many log rows sends few of them.
    """
    budget = max(0, min(MAX_RETRIES, int(retries or 0))) + 1
    w = Window.partitionBy("request_key").orderBy("ts", "attempt_id")
    first = (
        classified(log)
        .select("request_key", "ts", "attempt_id", "class", "retryable")
        .withColumn("n", F.row_number().over(w))
        .filter(F.col("n") <= budget)
    )
    final = F.coalesce(F.min(F.when(~F.col("retryable"), F.col("n"))), F.max("n"))
    ended = first.groupBy("request_key").agg(
        final.alias("attempts"),
        F.map_from_entries(F.collect_list(F.struct("n", "class"))).alias("by_n"),
    )
    outcome = F.element_at("by_n", F.col("attempts"))
    return ended.select(
        "request_key",
        outcome.alias("outcome"),
        (outcome == "ok").alias("success"),
        F.col("attempts").cast("long").alias("attempts"),
    )


def run_stats(log: DataFrame) -> DataFrame:
    """One row: requests_total, http_errors, timeouts, http_500, elapsed_seconds."""
    at = F.col("ts").cast("timestamp")
    seconds = F.max(at).cast("double") - F.min(at).cast("double")
    return classified(log).agg(
        F.count("*").alias("requests_total"),
        F.count_if(F.col("class") != "ok").alias("http_errors"),
        F.count_if(F.col("class") == "timeout").alias("timeouts"),
        F.count_if(F.col("class") == "http_500").alias("http_500"),
        F.coalesce(seconds, F.lit(0.0)).alias("elapsed_seconds"),
    )
