"""Running counts of tags over streams: an extension, with the same definitions as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from samphire.operators.frequency import document_frequency, term_frequency


def running_term_frequency(samples: DataFrame) -> DataFrame:
    """(tag, n) of a stream of samples; write it in complete or update mode."""
    return term_frequency(samples)


def running_document_frequency(samples: DataFrame) -> DataFrame:
    return document_frequency(samples)


def windowed_tag_counts(events: DataFrame, time_col: str, tag_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, tag, n) of timed tags; a window closes ``late`` after its end, so its state is bounded by time."""
    return events.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window"), F.col(tag_col).alias("tag")).agg(F.count("*").alias("n"))


def merge_counts(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's counts below ``folder``, one folder a batch: a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        term_frequency(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
