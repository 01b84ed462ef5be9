"""Raw CSV files with their place in the collection, term lists, rule files, and tables of mixed formats."""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import Path

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import strip, truthy
from ..operators.dedup import fingerprint
from ..operators.resolve import unique_headers

ENCODINGS = ("utf-8-sig", "gb18030")
#: Cells that the reader of whole files takes for missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
RAW_COLUMNS = ["id", "微博正文", "发布时间", "话题", "转发数", "评论数", "点赞数", "ip"]


def path_parts(path: Column) -> Column:
    """Struct keyword, year, month, day of a path with a component csv: the next component is the keyword, two numeric ones after
    it year and month, a numeric file name the day. Missing numbers are 9999 and 99; keyword is null without csv."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, F.lower), "csv")
    rest = F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(0)))
    keyword = F.when((at > 0) & (F.size(rest) > 1), F.get(rest, F.lit(0)))
    number = lambda c, none: F.coalesce(F.when(c.rlike("^\\d+$"), c.try_cast("int")), F.lit(none))
    numeric = F.filter(F.slice(rest, 2, F.greatest(F.size(rest) - 2, F.lit(0))), lambda p: p.rlike("^\\d+$"))
    stem = F.regexp_replace(F.element_at(parts, -1), "\\.[^.]*$", "")
    return F.struct(keyword.alias("keyword"), number(F.get(numeric, F.lit(0)), 9999).alias("year"), number(F.get(numeric, F.lit(1)), 99).alias("month"), number(stem, 99).alias("day"))


def raw_files(spark: SparkSession, folder: str, only: Sequence[str] | None = None) -> DataFrame:
    """CSV files below `folder` (not backups) that lie in a csv folder: file, path, size, mtime_ns, keyword, year, month, day, content.

    The content of a file is read only where a plan uses that column. With `only`, values of `file` that an earlier listing gave,
    no other file is opened or looked for.
    """
    reader = spark.read.format("binaryFile")
    if only is None:
        found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    else:
        found = reader.load([re.sub(r"([\\\[\]{}*?])", r"\\\1", f) for f in only]) if only else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    base = folder.rstrip("/").split("://")[-1]
    rel = F.replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit(base + "/"), F.lit(""))
    out = found.select(F.col("path").alias("file"), rel.alias("path"), F.col("length").alias("size"), (F.unix_micros(F.col("modificationTime")) * 1000).alias("mtime_ns"), "content")
    out = out.where(~F.contains(F.element_at(F.split("path", "/"), -1), F.lit(".backup")))
    return out.select("*", path_parts(F.col("path")).alias("_p")).select("file", "path", "size", "mtime_ns", "_p.*", "content").where("keyword is not null")


def parse_csv(data: bytes) -> pd.DataFrame:
    """All cells as text: UTF-8 with or without a mark, else GB 18030. Lines of too many cells are skipped, short ones filled up."""
    for encoding in ENCODINGS:
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            if encoding == ENCODINGS[-1]:
                raise
    return pd.read_csv(io.StringIO(text), dtype=str, on_bad_lines="skip", engine="c") if text.strip() else pd.DataFrame()


#: Files above this many bytes are read as a stream of records by one task, not as one value. A value holds 2 GB at most.
LARGE = 256 << 20


def read_raw_csv(files: DataFrame, columns: Sequence[str] = RAW_COLUMNS, large: int = LARGE) -> DataFrame:
    """Rows of the files of `raw_files`: columns by name in any order (missing ones empty), keyword, source_file, file order columns,
    row_idx, and error of files that can't be read (one row of empty cells). Files spread over tasks; one file is one parse."""
    meta = ["path", "keyword", "year", "month", "day"]
    schema = ", ".join([*(f"`{c}` string" for c in columns), "keyword string", "source_file string", "year int", "month int", "day int", "row_idx long", "error string"])
    rows = files.where(F.col("size") <= large).select("content", *meta)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for f in frame.itertuples():
                try:
                    table, error = parse_csv(f.content), None
                except Exception as problem:  # noqa: BLE001  a broken file is reported, not fatal
                    table, error = pd.DataFrame({c: [None] for c in columns}), f"{type(problem).__name__}: {problem}"[:300]
                out = table.reindex(columns=list(columns)).fillna("").astype(str)
                yield out.assign(keyword_=f.keyword, source_file=f.path, year=f.year, month=f.month, day=f.day, row_idx=range(len(out)), error=error).rename(columns={"keyword_": "keyword"})

    out = rows.mapInPandas(run, schema)
    for f in files.where(F.col("size") > large).select("file", *meta).collect():  # few: each has more than `large` bytes
        out = out.unionByName(_large_csv(files.sparkSession, f, columns))
    return out


def _large_csv(spark: SparkSession, file: Row, columns: Sequence[str]) -> DataFrame:
    """As `parse_csv` for one file that is too large for a value. Not UTF-8 is GB 18030; bytes that are neither become marks."""
    path = re.sub(r"([\\\[\]{}*?])", r"\\\1", file["file"])
    other = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    if other:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else Spark reads no GB 18030; the setting stays, as the table is read later
    header = _headers(spark, [file["file"]], encoding=ENCODINGS[-1] if other else "utf-8-sig")[0]
    schema = StructType([StructField(c, StringType()) for c in [*header, "_more"]])  # a cell beyond the header: the line has too many
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "GB18030" if other else "UTF-8").csv(path)
    rows = rows.where("_more is null").withColumn("_row", F.monotonically_increasing_id())  # one task, in the order of the file
    cells = [(F.coalesce(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")), F.lit("")) if c in header else F.lit("")).alias(c) for c in columns]
    places = [F.lit(file[c]).cast("int").alias(c) for c in ("year", "month", "day")]
    return rows.select(*cells, F.lit(file["keyword"]).alias("keyword"), F.lit(file["path"]).alias("source_file"), *places, F.col("_row").alias("row_idx"), F.lit(None).cast("string").alias("error"))


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches, in order, in any store that Spark reads. An absolute pattern that matches nothing is tried without its first slash; no match is an error."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def found(text: str) -> list[str]:
        path = jvm.org.apache.hadoop.fs.Path(text)
        return sorted(s.getPath().toString() for s in path.getFileSystem(conf).globStatus(path) or [])

    files = found(pattern) or (found(pattern.lstrip("/")) if pattern.startswith("/") else [])
    if not files:
        raise FileNotFoundError(f"no files match {pattern}")
    return files


def _headers(spark: SparkSession, files: Sequence[str], threads: int = 16, encoding: str = "utf-8-sig") -> list[list[str]]:
    """Column names of each CSV file: its first record, of which no more than needed is read. Empty files have none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def header(file: str) -> list[str]:
        path = jvm.org.apache.hadoop.fs.Path(file)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        stream = path.getFileSystem(conf).open(path)
        stream = codec.createInputStream(stream) if codec else stream
        try:
            data, size = b"", 1 << 14
            while True:
                more = bytes(stream.readNBytes(size))
                data, size = data + more, 2 * size
                text = data.decode(encoding, "ignore").lstrip("\r\n")
                ends = [m.start() for m in re.finditer("[\r\n]", text)]
                end = next((k for k in ends if text.count('"', 0, k) % 2 == 0), None)
                if end is not None or len(more) < size // 2:
                    return unique_headers(next(csv.reader(io.StringIO(text[:end], newline=""), strict=False), []))
        finally:
            stream.close()

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(header, files))


def _alike(spark: SparkSession, files: Sequence[str]) -> list[DataFrame]:
    """Parquet files as one table where their types fit together, else one for each schema."""
    read = lambda some: spark.read.option("mergeSchema", True).parquet(*some)
    try:
        return [read(files)]
    except (Py4JJavaError, PySparkException) as problem:
        if "CANNOT_MERGE_SCHEMAS" not in str(problem):
            raise
        by: dict[str, list[str]] = {}
        for f in files:
            by.setdefault(spark.read.parquet(f).schema.json(), []).append(f)
        return [read(some) for some in by.values()]


def read_tables(spark: SparkSession, pattern: str, origin: str = "__input_file") -> DataFrame:
    """Parquet and CSV files of a pattern as one table by column name, with each row's whole path.

    Each CSV file has its columns in an order of its own, blank and repeated names as in `unique_headers`; files of one
    header are read together, all cells as text. Columns that a file lacks are null there; one of different types is text. Other
    kinds of files are an error.
    """
    files = matching_files(spark, pattern)
    by = {kind: [f for f in files if re.search(rf"\.{kind}(\.\w+)?$", f)] for kind in ("parquet", "csv")}
    if odd := sorted(set(files) - set(by["parquet"]) - set(by["csv"])):
        raise ValueError(f"neither Parquet nor CSV: {odd[:3]}")
    tables = _alike(spark, by["parquet"]) if by["parquet"] else []
    of_header: dict[tuple[str, ...], list[str]] = {}
    for file, header in zip(by["csv"], _headers(spark, by["csv"]), strict=True):
        of_header.setdefault(tuple(header), []).append(file)
    for header, some in of_header.items():
        if header:
            reader = spark.read.schema(StructType([StructField(c, StringType()) for c in header]))
            tables.append(reader.option("header", True).option("multiLine", True).option("escape", '"').csv(some))
    if not tables:
        return spark.createDataFrame([], f"`{origin}` string")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    tables = [t.withColumn(origin, F.regexp_replace(path, "^file:/+", "/")) for t in tables]
    kinds: dict[str, set[str]] = {}
    for t in tables:
        for c, kind in t.dtypes:
            kinds.setdefault(c, set()).add(kind)
    text = {c for c, found in kinds.items() if len(found) > 1}
    tables = [t.withColumns({c: F.col(f"`{c}`").cast("string") for c in t.columns if c in text}) if text & set(t.columns) else t for t in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str, required: bool = False) -> DataFrame:
    """A CSV table, or an empty one where there is none; an error instead if it is required."""
    try:
        return spark.read.option("header", True).option("multiLine", True).schema(schema).csv(path)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], schema)


def term_list(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """Trimmed, distinct, non-blank lines; with `comments`, lines that start with # are left out."""
    terms = spark.read.text(path).select(strip("value").alias("term")).where("term <> ''").distinct()
    return terms.where(~F.col("term").startswith("#")) if comments else terms


def bucket_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file in order: kind, ord, bucket, markers."""
    marker = "array<struct<bucket: string, markers: array<string>>>"
    raw = spark.read.option("multiLine", True).schema(f"theme_buckets {marker}, context_buckets {marker}").json(path)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("rules")) for k in ("theme_buckets", "context_buckets")])).alias("k")
    return raw.select(kinds).select("k.kind", F.posexplode("k.rules").alias("ord", "r")).select("kind", "ord", "r.bucket", F.filter("r.markers", lambda m: F.trim(m) != "").alias("markers"))


def bucket_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Enabled hand-made rules that set something."""
    columns = ["keyword", "period_label", "term", "override_context_bucket", "override_theme_bucket", "enabled", "note"]
    raw = read_or_empty(spark, path, ", ".join(f"{c} string" for c in columns))
    raw = raw.select(*[F.coalesce(strip(c), F.lit("")).alias(c) for c in columns])
    return raw.where(((F.col("enabled") == "") | truthy("enabled")) & (F.concat("override_context_bucket", "override_theme_bucket") != ""))


def workbook_layout(rows: Sequence[Sequence[str | None]], known: Sequence[str]) -> tuple[int, list[str]]:
    """First data row and column names of a sheet whose header is in row 1, row 2 or nowhere (then columns are in the known order).

    A header has three different known names or more.
    """
    for k, row in enumerate(rows[:2]):
        if len({(c or "").strip().lower() for c in row} & set(known)) >= 3:
            return k + 1, unique_headers([(c or "").strip().lower() for c in row])
    return 0, [*known][: max(map(len, rows), default=0)]


def read_workbook(spark: SparkSession, path: str, known: Sequence[str], sheet: int | str = 0) -> DataFrame:
    """A hand-made sheet as text columns; needs openpyxl. Sheets are small, so the driver reads them."""
    cells = pd.read_excel(path, sheet_name=sheet, header=None, dtype=str)
    rows = [[None if pd.isna(c) else str(c) for c in r] for r in cells.itertuples(index=False)]
    first, names = workbook_layout(rows, known)
    return spark.createDataFrame([tuple(r[: len(names)]) for r in rows[first:]], ", ".join(f"`{n}` string" for n in names))


#: Names that a header of hand-labelled rows may hold.
LABELLED_HEADERS = ("id", "cleaned_text", "cleaned_text_with_emoji", "text_raw", "broad", "strict", "label", "tangping_related", "tangping_related_label", "类型", "发布时间", "话题", "keyword")


def promoted_header(rows: Sequence[Sequence[str | None]], known: Sequence[str] = LABELLED_HEADERS) -> tuple[int, list[str]]:
    """First data row and column names of hand-labelled rows: the names are in the first row, or in the second if that has
    three different known names or more, in any case. Blank names are unnamed_0 and so on, by place."""
    if not rows:
        return 0, []
    cells = {(c or "").strip().lower() for c in rows[1]} if len(rows) > 1 else set()
    at = 1 if len(cells & {k.lower() for k in known}) >= 3 else 0
    return at + 1, unique_headers(rows[at], 0)


def labelled_table(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """Hand-labelled rows of a CSV file, or of a sheet whose header may be in its second row; all cells are text."""
    if path.endswith(".csv"):
        return read_tables(spark, path).drop("__input_file")
    if not path.endswith((".xlsx", ".xls")):
        raise ValueError(f"neither CSV nor a workbook: {path}")
    cells = pd.read_excel(path, sheet_name=sheet, header=None, dtype=str)  # needs openpyxl; sheets are small, so the driver reads them
    rows = [[None if pd.isna(c) else str(c) for c in r] for r in cells.itertuples(index=False)]
    first, names = promoted_header(rows)
    return spark.createDataFrame([tuple(r) for r in rows[first:]], StructType([StructField(n, StringType()) for n in names]))


def config(path: str) -> dict:
    """Settings of a TOML file as one flat dict; those of section x are x_name, those of [labeler] bare."""
    tables = tomllib.loads(Path(path).read_text("utf-8"))
    out = {k: v for k, v in tables.items() if not isinstance(v, dict)}
    for section, values in tables.items():
        if isinstance(values, dict):
            out |= {k if section == "labeler" else f"{section}_{k}": v for k, v in values.items()}
    return out


def first_existing(candidates: Sequence[str]) -> str:
    for path in candidates:
        if Path(path).exists():
            return path
    raise FileNotFoundError(f"none of {list(candidates)}")


def save_vectors(vectors: DataFrame, path: str, documents: DataFrame) -> None:
    """A table of vectors, and beside it the fingerprint of the documents it was made from."""
    vectors.write.mode("overwrite").parquet(path)
    fingerprint(documents).coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.documents")


def vectors(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """A table of vectors; an error if it was made from other documents than `expected`, or has not as many rows where `save_vectors` left no fingerprint."""
    df = spark.read.parquet(path)
    if expected is not None:
        try:
            kept = spark.read.json(f"{path.rstrip('/')}.documents").first()["fingerprint"]
            same = kept == fingerprint(expected).first()["fingerprint"]
        except AnalysisException:
            same = df.count() == expected.count()
        if not same:
            raise ValueError(f"{path} was made from other documents")
    return df


def read_json(path: str) -> dict:
    p = Path(path)
    return json.loads(p.read_text("utf-8")) if p.exists() and p.read_text("utf-8").strip() else {}
