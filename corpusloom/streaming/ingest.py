"""Streams of documents: new files only, each text once, counts by period. An extension; batch runs are the exact ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.stats import period
from ..functions.text import text_hash


def document_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet", files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def unique_texts(stream: DataFrame, text: str, ts: str, delay: str = "1 day") -> DataFrame:
    """The first row of each text within the delay; the state is dropped after it."""
    return stream.withColumn("h", text_hash(text)).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["h"])


def period_counts(stream: DataFrame, ts: str, groups: list[str], width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rows of each group in each tumbling window."""
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *groups).agg(F.count("*").alias("doc_count")).select(F.col("window.start").alias("start"), *groups, "doc_count")


def append_new(stream: DataFrame, key: str, state: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends rows whose key the state table hasn't seen, exactly, without an unbounded state store; runs until the input is used up."""

    def write(batch: DataFrame, number: int) -> None:
        from pyspark.errors import AnalysisException

        spark = batch.sparkSession
        rows = batch.withColumn("h", text_hash(key)).dropDuplicates(["h"])
        try:
            # what this very batch wrote before a crash doesn't count as seen
            rows = rows.join(spark.read.parquet(state).where(F.col("batch") != number).select("h"), "h", "left_anti")
        except AnalysisException:
            pass
        rows = rows.cache()
        rows.drop("h").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)
        rows.select("h").withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(state)
        rows.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def labelled_periods(stream: DataFrame, ts: str, granularity: str = "month") -> DataFrame:
    return stream.withColumn("period_label", period(F.col(ts), granularity))
