"""Writers: Parquet parts, one-file CSV exports, JSON and Markdown reports."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PART_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; a temporary one in a local session without it, an error on a cluster."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root or "file://" + tempfile.mkdtemp()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends here, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of tables that `written` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def append_parts(df: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    df.write.mode("append").option("maxRecordsPerFile", part_rows).parquet(path)


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, or CSV by name. Spark writes aside and renames, so a crash leaves no half file among the results."""
    writer = df.write.mode(mode)
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.parquet(path)


def export_csv(df: DataFrame, path: str, mark: bool = True) -> int:
    """One local CSV file, with a byte-order mark for spreadsheets; rows stream through the driver partition by partition."""
    import csv

    rows = 0
    with Path(path).open("w", encoding="utf-8-sig" if mark else "utf-8", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if v is None else v for v in row])
            rows += 1
    return rows


def save_json(path: str, payload: object) -> None:
    """Written aside and moved into place."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False, encoding="utf-8") as out:
        json.dump(payload, out, ensure_ascii=False, indent=2, default=str)
    os.replace(out.name, target)


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A small report table; `limit` bounds what the driver gets."""
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join([*lines, *("| " + " | ".join(map(shown, r)) + " |" for r in df.limit(limit).collect())]) + "\n"


def html(sections: dict[str, DataFrame], limit: int = 200) -> str:
    from html import escape

    body = []
    for title, df in sections.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(limit).collect())
        body.append(f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{rows}</table>")
    return "<!DOCTYPE html><meta charset=utf-8>" + "".join(body)
