"""Threshold-scaled document fingerprints: every word shingle's hash below a fixed fraction of the hash range is kept.

Whether a hash is kept depends on nothing but itself. So the sketch of a union is the union of sketches, and shares of
common hashes estimate containment even between a page and a book. Built from Spark's own functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, shuffle_partitions, table, text_blocks

SHINGLE_WORDS = 5
#: One in so many shingles is kept, and of short texts this many at least (parameter `least`; 0 keeps to the fixed fraction).
SCALE, LEAST = 8, 32
#: Hashes lie from 0 to below this.
TOP = (1 << 63) - 1
#: Knots of the id distribution, and parts of the id range that the driver knows by their first id.
KNOTS, MOST_PARTS = 64, 1 << 20


def with_sketch(rows: DataFrame, text: str, name: str, scale: int = SCALE, words: int = SHINGLE_WORDS, least: int = LEAST) -> DataFrame:
    """Adds array<long> `name`, the kept hashes of the text's shingles, sorted and distinct, and long `name`_limit.

    Words lie between white space, in lower case. A text of fewer words is one shingle; texts without words share one.
    Where the fraction keeps under `least` hashes, the `least` smallest stay. The limit says below what nothing was left out;
    sketches of different limits are compared below the smaller one.
    """
    split, hashes, below = f"_{name}_words", f"_{name}_hashes", f"_{name}_below"
    rows = rows.withColumn(split, F.split(F.trim(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")), " +"))
    at = F.sequence(F.lit(0), F.greatest(F.size(split) - words, F.lit(0)))
    rows = rows.withColumn(hashes, F.transform(at, lambda i: F.xxhash64(*[F.get(split, i + k) for k in range(words)]).bitwiseAND(F.lit(TOP))))
    rows = rows.withColumn(below, F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(TOP // scale)))))
    few = F.size(below) < least
    rows = rows.withColumn(name, F.when(few, F.slice(F.array_sort(F.array_distinct(hashes)), 1, least)).otherwise(F.col(below)) if least else F.col(below))
    limit = F.when(~few, F.lit(TOP // scale)).when(F.size(name) < least, F.lit(TOP)).otherwise(F.element_at(name, -1) + 1)
    return rows.withColumn(f"{name}_limit", limit).drop(split, hashes, below)


def merged(a: str, b: str) -> Column:
    """Sketch of two texts taken together, complete below the smaller of their limits."""
    limit = F.least(f"{a}_limit", f"{b}_limit")
    return F.filter(F.array_sort(F.array_union(a, b)), lambda h: h < limit)


def _below_both(a: str, b: str) -> tuple[Column, Column]:
    limit = F.least(f"{a}_limit", f"{b}_limit")
    return F.filter(a, lambda h: h < limit), F.filter(b, lambda h: h < limit)


def likeness(a: str, b: str) -> Column:
    """Estimated share of common shingles among all of both."""
    x, y = _below_both(a, b)
    common, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(x, y))
    return F.when(F.col(a) == F.col(b), 1.0).when(both == 0, 0.0).otherwise(F.least(common / both, F.lit(1.0)))


def containment(a: str, b: str) -> Column:
    """Estimated share of the shingles of a that b has; 0 where a keeps none below both limits."""
    x, _ = _below_both(a, b)
    return F.when(F.col(a) == F.col(b), 1.0).when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(x))


def encoded(sketch: str) -> Column:
    """The limit in hexadecimal, a colon, and the hashes as one base64 string: all that a comparison needs."""
    return F.concat(F.hex(f"{sketch}_limit"), F.lit(":"), F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), "\\s", ""))


def _tree(key: Column, knots: list[int], leaf, lo: int, hi: int) -> Column:
    """Binary search among knots as nested conditions."""
    if hi - lo <= 1:
        return leaf(lo)
    mid = (lo + hi) // 2
    return F.when(key < F.lit(knots[mid]), _tree(key, knots, leaf, lo, mid)).otherwise(_tree(key, knots, leaf, mid, hi))


def with_next(rows: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """Adds `next_<c>` for each of `columns`: its value in the row of the next doc_id; the last row's next is the first.

    Rows of one id follow each other by a hash of the text, then text; null ids come first. Ids are cut into ranges by a
    monotone function fitted to their quantiles; null ids, and an id that several of the KNOTS quantiles fall on, are cut by
    the hash instead. One partition holds a range, and with it the first row of the next range, so all rows move once.
    """
    spark = rows.sparkSession
    found = rows.agg(F.percentile_approx("doc_id", [k / KNOTS for k in range(KNOTS)], 10_000), F.max("doc_id"), F.min("doc_id")).first()
    knots = sorted({found[2], *found[0]}) if found[0] else [0]
    hot = {k for k in knots if found[0] and found[0].count(k) > 1}
    sub = -(-min(parts, MOST_PARTS // 2) // len(knots))
    rows = rows.withColumn("_hash", F.xxhash64("text"))

    def by_hash(ranges: int) -> Column:
        """0 to below `ranges`, in order of the hash."""
        return F.expr(f"cast((shiftright(_hash, 32) + 2147483648L) * {ranges}L div 4294967296L as int)")

    def leaf(j: int) -> Column:
        """Each knot has `sub` ranges for its own id, if that is hot, and `sub` for the ids up to the next knot."""
        width = max(1, -(-((knots[j + 1] if j + 1 < len(knots) else (found[1] or 0) + 1) - knots[j]) // sub))
        rest = F.lit((2 * j + 1) * sub) + F.expr(f"cast((doc_id - {knots[j]}L) div {width}L as int)")
        return F.when(F.col("doc_id") == F.lit(knots[j]), F.lit(2 * j * sub) + by_hash(sub)).otherwise(rest) if knots[j] in hot else rest

    part = F.when(F.col("doc_id").isNull(), by_hash(max(2, min(parts, MOST_PARTS // 2))) - F.lit(MOST_PARTS)).otherwise(_tree(F.col("doc_id"), knots, leaf, 0, len(knots)))
    rows = rows.withColumn("_part", part.cast("int"))
    firsts = rows.groupBy("_part").agg(F.min(F.struct("doc_id", "_hash")).alias("f"))  # one row a part, at most 1.5 MOST_PARTS
    every = Window.partitionBy(F.lit(0)).orderBy("_part")
    host = F.coalesce(F.lag("_part").over(every), F.max("_part").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = F.broadcast(firsts.select(F.col("f.doc_id").alias("_first"), F.col("f._hash").alias("_first_hash"), host.alias("_host")))
    rows = rows.join(guests, F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("_hash") == F.col("_first_hash")), "left")
    seats = F.array_compact(F.array(F.struct(F.col("_part").alias("part"), F.lit(False).alias("guest")), F.when(F.col("_host").isNotNull(), F.struct(F.col("_host").alias("part"), F.lit(True).alias("guest")))))
    rows = rows.withColumn("_seat", F.explode(seats)).drop("_part", "_first", "_first_hash", "_host")
    rows = rows.withColumn("_part", F.col("_seat.part")).withColumn("_guest", F.col("_seat.guest")).drop("_seat")
    order = Window.partitionBy("_part").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "_hash", "text")
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where(~F.col("_guest")).drop("_part", "_guest", "_hash")


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's sketch, its edited text and that one's sketch, to compare with `likeness` and `containment`.

    The edited text has the last quarter of code points (rounded down) replaced by the first as many, or all, of the next
    document. Columns: doc_id, n_chars long, edited string, sketch, edited_sketch, next_sketch array<long> and their limits. One row for each row
    of `docs`; null texts count as empty; a single document is its own next. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col)
    parts = max(text_blocks(rows), 2 * shuffle_partitions(docs.sparkSession))
    rows = with_next(with_sketch(rows, "text", "sketch"), ["text", "sketch", "sketch_limit"], parts)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.expr("cast(n_chars div 4 as int)")
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 4 as int))"), F.left("next_text", quarter)))
    return with_sketch(rows.drop("text", "next_text"), "edited", "edited_sketch")


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and their edited texts, and how alike they are to those and to the next document's; one row a document, null texts are empty."""
    out = neighbour_fingerprints(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), encoded("sketch").alias("fingerprint"), encoded("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "edited_sketch").alias("contained_edited"), containment("sketch", "next_sketch").alias("contained_next"),
    )
