"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one block of documents holds on average.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads: `doc_id` long and `text` string, null texts as empty ones."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about `block_bytes` the texts fill: one aggregate, and never fewer than keep all tasks busy."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(-(-total // block_bytes), 2 * shuffle_partitions(docs.sparkSession))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder of the cluster.

    A local session that names none (tests, a laptop) gets a temporary folder of this machine, which all its tasks see; on a
    cluster that is an error, since each node would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        root = spark.conf.get("spark.corpusloom.test.dir", None) or "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.corpusloom.test.dir", root)
    return f"{root.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again: lineage ends here, and lost executors lose nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the folder that `materialise` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pack(*arrays: np.ndarray) -> bytes:
    """Numpy arrays as one compressed blob, byte planes apart so that small numbers cost little."""
    head = [np.array([len(arrays)], np.uint32).tobytes()]
    body = []
    for a in arrays:
        head.append(a.dtype.str.encode().ljust(4) + np.array([len(a)], np.uint32).tobytes())
        body.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (count,) = np.frombuffer(raw, np.uint32, 1)
    at, out = 4 + 8 * int(count), []
    for k in range(count):
        head = raw[4 + 8 * k : 12 + 8 * k]
        dtype, n = np.dtype(head[:4].decode().strip()), int(np.frombuffer(head, np.uint32, 1, 4)[0])
        size = n * dtype.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size
    return out


#: Labels that a classifier is learned for, at most.
MOST_LABELS = 1000


def labelled_sample(rows: DataFrame, id_col: str, label_col: str, per_label: int, most: int | None = None) -> list:
    """At most about `per_label` rows of each label, the same ones for the same rows: those whose id hashes lowest.

    One count by label sets a threshold for the hash; rows below it are fetched, never more than 1.25 `per_label` of a label,
    and of many labels fewer of each, so that they are no more than 1.25 `most`. Over MOST_LABELS labels are an error.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels")
    if not counts:
        return []
    per_label = min(per_label, max(1, (most or per_label * len(counts)) // len(counts)))
    rank = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 40))
    below = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, int(min(1.0, per_label / n) * (1 << 40)))])
    found = rows.withColumn("_rank", rank).where(F.col("_rank") < F.element_at(below, F.col(label_col))).orderBy("_rank", id_col).limit(per_label * len(counts) * 5 // 4 + 1).drop("_rank").collect()
    taken, out = dict.fromkeys(counts, 0), []
    for row in found:
        taken[row[label_col]] += 1
        if taken[row[label_col]] <= max(1, per_label * 5 // 4):
            out.append(row)
    return out


def bounded_texts(rows: DataFrame, most_bytes: int) -> list:
    """Rows of (doc_id, text, ...) with whole texts of `most_bytes` in all, in an order that a hash of the id gives.

    Sizes come to the driver first; only texts that fit together follow. A text that doesn't fit is passed over.
    """
    rank = lambda i, n: ((i * 0x9E3779B97F4A7C15 >> 20) % (1 << 40), i, n)
    sizes = sorted(((r[0], r[1]) for r in rows.groupBy("doc_id").agg(F.sum(F.octet_length("text"))).collect()), key=lambda r: rank(*r))
    total, ids = 0, []
    for k, n in sizes:
        if total + n <= most_bytes:
            total += n
            ids.append((k,))
    small = rows.sparkSession.createDataFrame(ids, "doc_id long")
    return sorted(rows.join(F.broadcast(small), "doc_id").collect(), key=lambda r: (*rank(r["doc_id"], 0), r["text"]))


def with_text_results(docs: DataFrame, text_col: str, fields: dict[str, str], make, rows_at_once: int = 200) -> DataFrame:
    """All columns of `docs`, then `fields` (name: DDL type) that `make()(texts)` gives as one array each for a list of texts.

    Texts are bytes, null ones empty. The caller picks names that `docs` doesn't have, see `unused`.
    """
    text = unused(docs, "_text")
    rows = docs.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary"))
    schema = StructType(list(docs.schema))
    for name, kind in fields.items():
        schema = schema.add(name, kind)
    kept = list(docs.columns)

    def run(batches):
        import pyarrow as pa

        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                found = work(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *found], [*kept, *fields])

    return rows.mapInArrow(run, schema)


def unused(docs: DataFrame, name: str) -> str:
    """`name`, with as many underscores before it as make it new to `docs`."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = "_" + name
    return name
