"""WARC records of web pages, and fixity audits that compare hash trees instead of archives.

A file holds the records of IDS_PER_FILE neighbouring ids, so where a record stands depends on nothing but the ids and
bytes beside it. Each record's hash covers its bytes and its offset range. FANOUT neighbours make a node, nodes of a file a
tree, roots of all files one more tree. Two replicas with one root are equal; otherwise only the children of nodes that
differ are compared, level by level, down to the records that are corrupt, missing or new.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialise, table

FANOUT = 64
IDS_PER_FILE = 512
CRLF = "\r\n"


def warc_record(url: Column, body: Column, name: Column, date: str = "1970-01-01T00:00:00Z") -> Column:
    """One WARC/1.1 resource record as bytes; a null url becomes urn:unknown, a null body an empty one."""
    body = F.coalesce(body, F.lit("")).cast("binary")
    uuid = F.regexp_replace(F.md5(name.cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    url = F.regexp_replace(F.coalesce(url, F.lit("urn:unknown")), r"[\r\n]", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), url, F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(f">{CRLF}WARC-Block-Digest: sha256:"), F.sha2(body, 256), F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF),
    )
    return F.concat(head.cast("binary"), body, F.lit(CRLF + CRLF).cast("binary"))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Pages as WARC records: page_id long, file long, record binary. A file holds a range of `ids_per_file` (4 or more) ids.

    So the deal is the same on every cluster and whatever other pages there are. Files of ids from 0 on have odd numbers,
    those of negative ids even ones, and null ids are in file 0. An empty table gives an empty result; repeated rows stay
    repeated records. Ids should be dense: each lone id is a file.
    """
    if ids_per_file < 4:
        raise ValueError("ids_per_file must be 4 or more")
    number = F.col(f"`{id_col}`").cast("long")
    record = warc_record(F.col(f"`{url_col}`"), F.col(f"`{body_col}`"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")))
    rows = pages.select(number.alias("page_id"), record.alias("record"))
    file = F.expr(f"case when page_id is null then 0L when page_id >= 0 then 2 * (page_id div {ids_per_file}) + 1 else 2 * (-(page_id + 1) div {ids_per_file} + 1) end")
    return rows.select("page_id", file.cast("long").alias("file"), "record")


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an uncompressed WARC file. Raises on a broken one."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        if end + 8 + size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield at, end + 8 + size - at, headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def read_warc(files: DataFrame, name_col: str = "path", data_col: str = "content") -> DataFrame:
    """Records of whole WARC files, as `spark.read.format("binaryFile")` gives them: file string, offset, length long, url string, record, block binary."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(name, at, n, h.get("warc-target-uri"), data[at : at + n], block) for at, n, h, block in parse_warc(data or b"")]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
                columns = zip(*found, strict=True) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "offset", "length", "url", "record", "block"])

    return files.select(F.col(name_col).cast("string"), F.col(data_col).cast("binary")).mapInArrow(run, "file string, offset long, length long, url string, record binary, block binary")


def leaves(records: DataFrame) -> DataFrame:
    """(file, page_id, record) to ordered leaves: file, ordinal, page_id, start, length, copies long, hash string.

    Records of a file are ordered by page_id, then digest; `copies` equal records of an id are one leaf, which covers
    `length` bytes in all. Only digests move. Copies are counted before they do; where an id has many records, those are
    numbered in parts by digest, and sums over the parts, of which an id has at most 4096, say where each part starts.
    """
    found = records.select("file", "page_id", F.octet_length("record").cast("long").alias("_size"), F.sha2("record", 256).alias("_digest"))
    found = found.groupBy("file", "page_id", "_size", "_digest").agg(F.count("*").alias("copies"))
    found = found.withColumn("length", F.col("_size") * F.col("copies")).withColumn("_part", F.substring("_digest", 1, 3)).withColumn("_id", F.coalesce("page_id", F.lit(0)))
    inner = Window.partitionBy("file", "_id", "_part").orderBy("_digest", "_size").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.groupBy("file", "_id", "_part").agg(F.sum("copies").alias("_n"), F.sum("length").alias("_bytes"))
    outer = Window.partitionBy("file").orderBy("_id", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    sums = sums.select("file", "_id", "_part", before("_n", outer).alias("_n"), before("_bytes", outer).alias("_bytes"))
    placed = found.withColumn("_k", before("copies", inner)).withColumn("_at", before("length", inner)).join(sums, ["file", "_id", "_part"])
    placed = placed.withColumn("ordinal", F.col("_n") + F.col("_k")).withColumn("start", F.col("_bytes") + F.col("_at"))
    hashed = F.sha2(F.concat_ws("|", F.lit("leaf"), "start", "length", "copies", "_digest"), 256)
    return placed.select("file", "ordinal", "page_id", "start", "length", "copies", hashed.alias("hash"))


def parents(nodes: DataFrame, groups: list[str]) -> DataFrame:
    """The level above: (groups, ordinal, start, length, hash) of every FANOUT neighbours. At most FANOUT rows meet in a group."""
    child = F.array_sort(F.collect_list(F.struct("ordinal", "hash")))
    up = nodes.groupBy(*groups, F.expr(f"ordinal div {FANOUT}").alias("ordinal")).agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("_end"), F.array_join(F.transform(child, lambda c: F.concat_ws(":", c["ordinal"], c["hash"])), "|").alias("_hashes")
    )
    return up.select(*groups, "ordinal", "start", (F.col("_end") - F.col("start")).alias("length"), F.sha2(F.concat(F.lit("node|"), "_hashes"), 256).alias("hash"))


class Tree:
    """Levels of one replica, leaves first: those of files, then one over the roots of all files (`top`)."""

    def __init__(self, records: DataFrame):
        tall = lambda nodes: (nodes.agg(F.max("ordinal")).first()[0] or 0) > 0
        self.levels = [materialise(leaves(records))]
        while tall(self.levels[-1]):
            self.levels.append(materialise(parents(self.levels[-1], ["file"])))
        self.top = [self.levels[-1].select(F.col("file").alias("ordinal"), F.lit(0).cast("long").alias("start"), "length", "hash")]
        while tall(self.top[-1]):
            self.top.append(materialise(parents(self.top[-1], [])))

    def root(self) -> str | None:
        """One hash of the whole replica; None of an empty one."""
        row = self.top[-1].first()
        return row["hash"] if row else None

    def drop(self, keep_leaves: bool = False) -> None:
        """Deletes the written levels."""
        for level in [*self.levels[int(keep_leaves) :], *self.top[1:]]:
            drop_table(level)


def _differing(a: DataFrame, b: DataFrame, keys: list[str], within: DataFrame | None, above: list[str]) -> DataFrame:
    """Nodes that differ or stand on one side only, with `_a` and `_b`, their (hash, start, length) on each side.

    Only those below `within`, whose keys `above` and ordinal are those of parents.
    """
    if within is not None:
        parent = lambda df: df.withColumn("_parent", F.expr(f"ordinal div {FANOUT}")).join(within.select(*above, F.col("ordinal").alias("_parent")), [*above, "_parent"], "left_semi").drop("_parent")
        a, b = parent(a), parent(b)
    side = lambda df, name: df.select(*keys, F.struct("hash", "start", "length").alias(name))
    both = side(a, "_a").join(side(b, "_b"), keys, "full_outer")
    return both.where(~F.col("_a.hash").eqNullSafe(F.col("_b.hash")))


def audit(trusted: Tree, replica: Tree) -> DataFrame:
    """Leaves that differ: file, ordinal long, start, length long (of the trusted copy, else the replica's), status string.

    status: corrupt (other bytes, place or number of copies), missing (only the trusted copy has the ordinal) or extra. A
    record lost or added inside a file moves all that follow in that file, which are then corrupt too: their offsets are
    wrong. Equal roots end the audit. Trees of different heights meet at the top of the lower one.
    """
    written, within = [], None
    if len(trusted.top) == len(replica.top) and trusted.root() == replica.root():
        return trusted.levels[0].limit(0).select("file", "ordinal", "start", "length", F.lit("").alias("status"))
    for k in range(min(len(trusted.top), len(replica.top)) - 1, -1, -1):
        within = materialise(_differing(trusted.top[k], replica.top[k], ["ordinal"], within, []).select("ordinal"))
        written.append(within)
    files, within = within.withColumnRenamed("ordinal", "file"), None
    below = lambda df: df.join(files, "file", "left_semi")
    for k in range(min(len(trusted.levels), len(replica.levels)) - 1, 0, -1):
        within = materialise(_differing(below(trusted.levels[k]), below(replica.levels[k]), ["file", "ordinal"], within, ["file"]).select("file", "ordinal"))
        written.append(within)
    lost = _differing(below(trusted.levels[0]), below(replica.levels[0]), ["file", "ordinal"], within, ["file"])
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("corrupt")
    place = F.coalesce("_a", "_b")
    out = materialise(lost.select("file", "ordinal", place["start"].alias("start"), place["length"].alias("length"), status.alias("status")))
    for t in written:
        drop_table(t)
    return out


def decayed(records: DataFrame, one_in: int = 53) -> DataFrame:
    """A replica in which one bit of one byte of about one record in `one_in` has flipped, chosen by a hash of its id."""
    pick = F.pmod(F.xxhash64(F.lit("decay"), F.coalesce("page_id", F.lit(0))), F.lit(one_in)) == 0
    at = F.pmod(F.xxhash64(F.lit("place"), F.coalesce("page_id", F.lit(0))), F.octet_length("record")).cast("int") + 1
    byte = F.conv(F.hex(F.substring("record", at, F.lit(1))), 16, 10).cast("int")
    flipped = F.concat(F.substring("record", F.lit(1), at - 1), F.unhex(F.lpad(F.hex(byte.bitwiseXOR(F.lit(1))), 2, "0")), F.substring("record", at + 1, F.octet_length("record")))
    return records.withColumn("record", F.when(pick, flipped).otherwise(F.col("record")))


def op10_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Every page's record with its place and hash, and what an audit of a decayed replica says of it.

    One row for each leaf, that is for each distinct record of an id, with the number of its copies.
    """
    records = archive(table(spark, sf_dir, "pages"))
    trusted, replica = Tree(records), Tree(decayed(records))
    found = audit(trusted, replica).select("file", "ordinal", "status")
    trusted.drop(keep_leaves=True)
    replica.drop()
    return trusted.levels[0].join(found, ["file", "ordinal"], "left").select("page_id", "file", "ordinal", "start", "length", "copies", "hash", F.coalesce("status", F.lit("intact")).alias("status"))
