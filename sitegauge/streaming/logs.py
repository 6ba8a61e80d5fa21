"""Crawl log: classified and cleaned events, for batch and streaming frames alike.

``events`` is stateless, so it runs unchanged in a streaming query. ``stream_progress`` keeps one count for each
crawl from batch to batch. ``progress_per_batch`` counts analysed
pages in a table-backed ``foreachBatch``: each micro-batch adds its count once, however often it is tried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from sitegauge.functions.text import js_trim
from sitegauge.plans.staging import staged

#: Prefixes that are cut, marks by level, icons.
PREFIXES = ("SitemapCrawler", "Sitemap", "SitemapDiscovery", "API")
ICONS = {"success": "✓", "warning": "⚠", "error": "✗"}
EVERY = 10


def level_of(message: Column, level: Column) -> Column:
    """success before warning before error before the level as written (lower case, null is info)."""
    low = F.lower(message)
    return (
        F.when(message.rlike("✓|Successfully|Found sitemap"), "success")
        .when(message.contains("⚠") | low.contains("warning"), "warning")
        .when(message.contains("✗") | low.contains("error") | low.contains("failed"), "error")
        .otherwise(F.coalesce(F.lower(level), F.lit("info")))
    )


def clean(message: Column) -> Column:
    return js_trim(F.regexp_replace(message, r"\[(?:" + "|".join(PREFIXES) + r")\]\s*", ""))


def events(log: DataFrame) -> DataFrame:
    """(log_id, ts, level, message, icon) of every log row that says something; null messages don't."""
    out = log.select("log_id", "ts", level_of(F.col("message"), F.col("level")).alias("level"), clean(F.col("message")).alias("message"))
    icon = F.lit("→")
    for name, mark in ICONS.items():
        icon = F.when(F.col("level") == name, mark).otherwise(icon)
    return out.filter("message <> ''").withColumn("icon", icon)


def frames(events_: DataFrame) -> DataFrame:
    """Events as the text frames of an event stream."""
    body = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "level", "message"))
    return events_.select("log_id", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("frame"))


def stringified(args: Column) -> Column:
    """Arguments of a log call, given as JSON texts, as one message: texts as they are, others as JSON, joined by a space.

    Objects and arrays keep their JSON on one line; null arguments say null.
    """
    text = lambda a: F.when(F.substring(a, 1, 1) == '"', F.from_json(F.concat(F.lit("["), a, F.lit("]")), "array<string>")[0]).otherwise(a)
    return F.array_join(F.transform(args, lambda a: F.coalesce(text(a), F.lit("null"))), " ")


def complete() -> str:
    """The frame that ends a stream."""
    return 'data: {"type":"complete"}\n\n'


def stream_frames(events_: DataFrame) -> DataFrame:
    """(log_id, frame): the frames of a finished log; the last, which has a null id, says that it is complete."""
    end = events_.sparkSession.createDataFrame([(None, complete())], "log_id long, frame string")
    return frames(events_).unionByName(end)


def progress(log: DataFrame, total: int | None = None) -> DataFrame:
    """(analysed, ts): a row at every tenth analysed page, and at the last where ``total`` is told.

    Pages are numbered by time, then id, in two passes: running sums of the counts per minute, then the place
    within the minute, so that no task sorts more than a minute of the log. Repeated rows count once.
    """
    rows = staged(log.filter(F.col("message").contains("Analyzed ")).select("log_id", "ts").distinct().withColumn("minute", F.date_trunc("minute", "ts")))
    counts = rows.groupBy("minute").agg(F.count("*").alias("n"))
    # one row per minute: half a million a year, summed up in one task
    before = counts.select("minute", (F.sum("n").over(Window.orderBy("minute")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("minute").orderBy("ts", "log_id"))
    numbered = rows.withColumn("k", within).join(before, "minute").select((F.col("k") + F.col("before")).alias("analysed"), "ts")
    last = F.lit(False) if total is None else F.col("analysed") == total
    return numbered.filter((F.col("analysed") % EVERY == 0) | last)


class _Counter(StatefulProcessor):
    """Counts the analysed pages of a crawl and tells every tenth."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("analysed", "n long")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        seen = self.count.get()[0] if self.count.exists() else 0
        told = []
        for part in rows:
            for ts in part.sort_values(["ts", "log_id"])["ts"]:
                seen += 1
                if seen % EVERY == 0:
                    told.append((key[0], seen, ts))
        self.count.update((seen,))
        yield pd.DataFrame(told, columns=["crawl", "analysed", "ts"])

    def close(self) -> None:
        pass


def stream_progress(log: DataFrame, crawl: Column) -> DataFrame:
    """(crawl, analysed, ts) of a streaming log: an event at every tenth analysed page of each crawl, counted across batches.

    The state is one number per crawl; it needs the RocksDB state store provider.
    """
    rows = log.filter(F.col("message").contains("Analyzed ")).select(crawl.alias("crawl"), "log_id", "ts")
    return rows.groupBy("crawl").transformWithStateInPandas(_Counter(), "crawl string, analysed long, ts timestamp", "Append", "None")


def run(log: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a streaming query that hands every micro-batch of events to ``sink`` and ends with the input."""
    return events(log).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch's number of analysed pages to ``path``/batch=id, replaced when retried."""

    def write(batch: DataFrame, number: int) -> None:
        counted = batch.filter(F.col("message").contains("Analyzed ")).agg(F.count("*").alias("analysed"))
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
