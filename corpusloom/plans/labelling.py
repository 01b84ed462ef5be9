"""Labelling runs that break off and go on: rows are dealt to chunks once, and every finished chunk is a table that counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import checked_answer
from ..operators.dedup import fingerprint, signature
from .ml import Client, label_posts


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _dealt(df: DataFrame, folder: str, chunk_rows: int) -> int:
    """Rows by chunk in `folder`/rows, written once: the chunk is that of a hash of the whole row, so equal rows share one.

    Returns the number of chunks. Rows other than those of an earlier run are an error.
    """
    spark, place = df.sparkSession, f"{folder}/rows"
    now = fingerprint(df).first()[0]
    if _exists(spark, f"{place}/_SUCCESS"):
        kept = spark.read.json(f"{folder}/plan").first()
        if kept["fingerprint"] != now:
            raise ValueError(f"{folder} holds a run over other rows")
        return kept["chunks"]
    chunks = max(1, -(-df.count() // chunk_rows))
    spark.createDataFrame([(now, chunks)], "fingerprint string, chunks long").coalesce(1).write.mode("overwrite").json(f"{folder}/plan")
    chunk = F.pmod(signature(df.columns), F.lit(chunks)).cast("int")
    df.withColumn("_chunk", chunk).repartition("_chunk").write.mode("overwrite").partitionBy("_chunk").parquet(place)
    return chunks


def label_in_chunks(df: DataFrame, make_client: Callable[[], Client], prompt: Callable[[str], str], folder: str, text: str = "text", chunk_rows: int = 10_000, tasks: int = 8, **how) -> DataFrame:
    """As `label_posts`, a chunk of about `chunk_rows` rows after another, each written below `folder` once it is done.

    A run that broke off is called again with the same rows: finished chunks aren't asked again, but for answers that do not
    hold up when they are checked anew; those are asked once more, and the chunk is written anew. A chunk that broke
    off is asked as a whole. `how` goes to `label_posts`.
    """
    spark, folder = df.sparkSession, folder.rstrip("/")
    chunks = _dealt(df, folder, chunk_rows)
    rows = spark.read.schema(StructType([*df.schema, StructField("_chunk", IntegerType())])).parquet(f"{folder}/rows")
    kinds: dict[str, list[int]] = {"new": [], "again": []}
    for k in range(chunks):
        kinds["again" if _exists(spark, f"{folder}/done/{k}/_SUCCESS") else "new"].append(k)
    ask = lambda some: label_posts(some.repartition(tasks), make_client, prompt, text, **how)
    for k in kinds["new"]:
        ask(rows.where(F.col("_chunk") == k).drop("_chunk")).write.mode("overwrite").parquet(f"{folder}/done/{k}")
    for k in kinds["again"]:
        kept = spark.read.parquet(f"{folder}/done/{k}").withColumn("_a", checked_answer(F.when(F.col("fixed_raw") != "", F.col("fixed_raw")).otherwise(F.col("raw"))))
        agree = F.col("_a.ok") & (F.col("label") == F.col("_a.label")) & (F.col("exclusion") == F.col("_a.exclusion")) & (F.col("confidence") == F.col("_a.confidence"))
        bad = kept.where(~F.coalesce(agree, F.lit(False)))
        if bad.limit(1).count():
            good = kept.where(F.coalesce(agree, F.lit(False))).drop("_a")
            both = good.unionByName(ask(bad.select(*df.columns)).select(*good.columns))
            both.write.mode("overwrite").parquet(f"{folder}/mended/{k}")  # aside first: its own rows are read while it is written
            spark.read.parquet(f"{folder}/mended/{k}").write.mode("overwrite").parquet(f"{folder}/done/{k}")
    return spark.read.parquet(*[f"{folder}/done/{k}" for k in range(chunks)])
