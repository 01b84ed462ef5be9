"""From raw CSV files to merged, cleaned and deduplicated tables, file by file as they appear or change."""

from __future__ import annotations

import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_post, emoji_names, emoji_placeholder
from ..operators.dedup import changed_files, dedup_by_id, dedup_by_text
from ..sources.files import RAW_COLUMNS, raw_files, read_raw_csv
from ..sources.sinks import PART_ROWS, dropped, export_csv, save_json, written

SHORTEST, LONGEST = 2, 2000
TEXT = "微博正文"
ORDER = ["year", "month", "day", "keyword", "source_file", "row_idx"]
TABLES = ("merged", "preprocessed", "text_dedup")


def preprocess(df: DataFrame, text: str = TEXT, names: bool = True) -> DataFrame:
    """Adds cleaned_text (emoji as a mark), cleaned_text_with_emoji (as names) and text_raw; drops texts under two characters, cuts at 2000."""
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a row for each row: no filter or projection works it out a second time
    base = df.withColumn("text_raw", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_base", once(clean_post(text)))
    out = base.withColumn("cleaned_text", once(emoji_placeholder("_base"))).where(F.length("cleaned_text") >= SHORTEST)
    out = out.withColumn("cleaned_text_with_emoji", emoji_names("_base") if names else F.col("_base"))
    return out.withColumns({c: F.substring(c, 1, LONGEST) for c in ("cleaned_text", "cleaned_text_with_emoji")}).drop("_base")


MANIFEST = "path string, size long, mtime_ns long, keyword string, seen_at string"


class Collection:
    """Tables and state of one collection below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _written(self, name: str, schema: str | None) -> DataFrame:
        """All batches of a table, finished or not."""
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException:
            if schema is None:
                raise
            return self.spark.createDataFrame([], f"{schema}, batch int")

    def finished(self) -> int:
        """Number of the last batch whose manifest was written, which happens last; 0 before the first."""
        return self._written("manifest", MANIFEST).agg(F.max("batch")).first()[0] or 0

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        return self._written(name, schema).where(F.col("batch") <= self.finished()).drop("batch")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        """Puts the rows in place of those that a run which broke off left for the same batch."""
        df.write.mode("overwrite").option("maxRecordsPerFile", PART_ROWS).parquet(f"{self.path(name)}/batch={batch}")

    def reset(self) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in (*TABLES, "seen_ids", "seen_texts", "manifest"):
            path = hadoop(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def run(self, raw: str, rebuild: bool = False) -> dict:
        """Reads new and changed files only, appends rows with new ids, then those with new texts, and the state. Returns counters.

        Each run is a batch, which counts once its manifest is written. A run after a crash writes the same batch anew, so
        nothing is lost and nothing repeats. Rows of changed files
        whose ids are known stay as they were. Files that can't be read keep their old manifest entry and are tried again.
        """
        if rebuild:
            self.reset()
        manifest, batch = self.table("manifest", MANIFEST), self.finished() + 1
        latest = manifest.groupBy("path").agg(F.max_by(F.struct("size", "mtime_ns"), "seen_at").alias("_s")).select("path", "_s.*")
        # names, sizes and times first; then only files that changed are opened, and no content meets the manifest
        files = written(changed_files(raw_files(self.spark, raw).drop("content"), latest))
        changed = [r["file"] for r in files.select("file").collect()]  # the driver lists files anyway
        rows = read_raw_csv(raw_files(self.spark, raw, changed)).cache()
        failed = rows.where("error is not null").select(F.col("source_file").alias("path")).distinct()
        good = rows.where("error is null")
        new, counts, ids = dedup_by_id(good, self.table("seen_ids", "h string"), ORDER)
        new = new.cache()
        self._write(new.select(*RAW_COLUMNS, "keyword", "source_file"), "merged", batch)
        clean = preprocess(new).cache()
        kept = [*[c for c in RAW_COLUMNS if c != TEXT], "keyword", "source_file", "cleaned_text", "cleaned_text_with_emoji", "text_raw"]
        self._write(clean.select(*kept), "preprocessed", batch)
        unique = dedup_by_text(clean.drop("h"), self.table("seen_texts", "h string"), ORDER).cache()
        self._write(unique.select(*kept), "text_dedup", batch)
        report = {"files": files.count(), "failed_files": failed.count(), "id_dedup": counts.first().asDict(), "preprocessed_rows": clean.count(), "text_dedup_rows": unique.count()}
        self._write(ids, "seen_ids", batch)
        self._write(unique.select("h"), "seen_texts", batch)
        now = datetime.datetime.now(datetime.UTC).isoformat()
        self._write(files.join(failed, "path", "left_anti").select("path", "size", "mtime_ns", "keyword", F.lit(now).alias("seen_at")), "manifest", batch)
        for df in (rows, new, clean, unique):
            df.unpersist()
        dropped(files)
        return report

    def status(self) -> dict:
        """Rows of each table."""
        return {name: self.table(name, "id string").count() for name in TABLES}

    def export(self, target: str, folder: str) -> dict[str, int]:
        """CSV files of one table or all."""
        Path(folder).mkdir(parents=True, exist_ok=True)
        names = TABLES if target == "all" else (target,)
        out = {name: export_csv(self.table(name), f"{folder}/{name}.csv") for name in names}
        save_json(f"{folder}/export.json", out)
        return out
