"""Rules over streams. Status columns look at one document at a time, so they are the same on a stream as on a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluate import Rules, checks, compile_rules, results, status_text


def stream_results(stream: DataFrame, rules: Rules, keep: list[str], document: str | None = None) -> DataFrame:
    """keep, rule, status for each document of a stream, without state."""
    return results(stream, rules, keep, document)


def stream_checks(stream: DataFrame, rules: Rules, keep: list[str], document: str | None = None) -> DataFrame:
    return checks(stream, rules, keep, document)


def windowed_tallies(stream: DataFrame, rules: Rules, time: str, window: str, late: str, document: str | None = None) -> DataFrame:
    """start, rule, status, n by windows of event time. Counts of a window are final once the watermark, late behind the
    newest time, has passed it, so the state that is kept is bounded by the windows still open."""
    done = compile_rules(stream.withWatermark(time, late), rules, document)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), status_text(done.status(r)).alias("status")) for r in done.names])
    rows = done.frame.select(time, F.explode(each).alias("__each")).select(time, "__each.*")
    counted = rows.groupBy(F.window(time, window).alias("__window"), "rule", "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("__window.start").alias("start"), "rule", "status", "n")


def write(rows: DataFrame, path: str, checkpoint: str, every: str = "30 seconds") -> StreamingQuery:
    """Rows as Parquet, each exactly once."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(processingTime=every).start(path)


def for_each_batch(rows: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
