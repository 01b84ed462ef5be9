"""One output file for each input file, of the same name, which all appear together or not at all."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
import pyarrow.csv
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING = "_staging-"


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has finished aside: where they lie and where they go."""

    files: list[tuple[str, str]]


def _target(origin: str) -> str:
    """The file name of an input, as Parquet or CSV by its ending."""
    name = origin.rstrip("/").rsplit("/", 1)[-1] or "unnamed"
    return name if name.endswith((".csv", ".parquet")) else f"{name}.parquet"


class PerFileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, origin: str, overwrite: bool):
        self.folder, self.origin, self.overwrite = folder, origin, overwrite
        self.staging = f"{folder}/{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows come sorted by their origin. Each attempt of a task has a folder of its own."""
        own = f"{self.staging}/{uuid.uuid4().hex}"
        os.makedirs(own)
        done, now, out = [], None, None
        for batch in iterator:
            origins = batch.column(self.origin).to_pylist()
            rows = batch.drop_columns([self.origin])
            at = 0
            while at < len(origins):
                end = next((k for k in range(at, len(origins)) if origins[k] != origins[at]), len(origins))
                if out is None or origins[at] != now:
                    if out is not None:
                        out.close()
                    now = origins[at]
                    name = _target(now or "")
                    out = (pa.csv.CSVWriter if name.endswith(".csv") else pa.parquet.ParquetWriter)(f"{own}/{len(done)}", rows.schema)
                    done.append((f"{own}/{len(done)}", name))
                out.write(pa.Table.from_batches([rows.slice(at, end - at)]))
                at = end
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        clash = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
        there = set() if self.overwrite else {n for n in names if Path(self.folder, n).exists()}
        if clash or there:
            self.abort(messages)
            raise FileExistsError(f"output files clash: {sorted(clash | there)[:3]}")
        for aside, name in files:
            os.replace(aside, f"{self.folder}/{name}")
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class PerFile(DataSource):
    """`df.write.format("corpusloom_per_file")` with options path and origin."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_per_file"

    def writer(self, schema, overwrite: bool) -> PerFileWriter:
        return PerFileWriter(self.options["path"], self.options["origin"], overwrite)


def save_per_file(df: DataFrame, folder: str, origin: str = "__input_file", overwrite: bool = True) -> None:
    """Writes the rows of each value of `origin`, a path, to a file of its name below `folder`, without that column.

    `folder` lies on a file system that the driver and all executors have mounted. Files are written aside and moved when the
    whole job is done; a job that fails leaves none, and what was there stays. Two origins of one name are an error, and so is
    a file that is there already, unless `overwrite`. Rows without an origin go to `unnamed.parquet`. One file is one task's work.
    """
    df.sparkSession.dataSource.register(PerFile)
    Path(folder).mkdir(parents=True, exist_ok=True)
    rows = df.withColumn(origin, F.coalesce(F.col(origin), F.lit(""))).repartition(origin).sortWithinPartitions(origin)
    rows.write.format("corpusloom_per_file").mode("overwrite" if overwrite else "append").option("path", folder).option("origin", origin).save()
