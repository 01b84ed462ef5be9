"""SimHash fingerprints, and groups of near duplicates found with a Gray-order hierarchical index.

Fingerprints that differ in at most `bits` places agree on all but `bits` of any blocks the word is cut into. The top
nodes of the index are such masked patterns, one mask for each choice of blocks that must agree; they spread over the
cluster. Below a top node the fingerprints are sorted by Gray rank, so that neighbours differ little. Nodes of FANOUT
neighbours keep the bits all their members share, nodes of nodes again; the differences between two nodes on the bits
that both share bound those of all their members from below, and pairs of nodes beyond `bits` are pruned whole.
So are pairs whose members are known to be connected already.

`similar_documents` links texts by the exact similarity of their shingle sets. The same index, over wider fingerprints and
masks of sampled bits, finds which texts may be alike; every link is then confirmed on the sets themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, id_and_text, materialise, shuffle_partitions
from .components import components, local_roots

FANOUT = 16
#: Members that a top node should have on average, when all are unlike; masks have more bits the more fingerprints there are.
NODE = 256
#: 64-bit words of the wider fingerprints.
WORDS = 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: bytes, shingle_words: int, seed: int = 42) -> np.ndarray:
    words = text.translate(LOWER).split()
    n = len(words) - shingle_words + 1
    joined = b" ".join(words)
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, seed)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray, mixed=None, part: int = 1 << 12) -> np.ndarray:
    """Of hashes of some words each (n, words), the bits set in over half; zero of none. `mixed` makes those words from `part` rows at a time."""
    counts, n = 0, len(hashes)
    for lo in range(0, max(n, 1), part):
        x = np.ascontiguousarray(mixed(hashes[lo : lo + part]) if mixed else hashes[lo : lo + part])
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), 8 * x.shape[1]), axis=1, bitorder="little")
        counts = counts + (np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64) if n else np.zeros(bits.shape[1], np.int64))
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def wide_fingerprint(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """`words` words of majority bits over all hashes, each mixed anew for every word."""
    first, second = np.random.default_rng(words).integers(1 << 62, size=(2, words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def mixed(part):
        x = part[:, None] * first
        x = (x ^ (x >> np.uint64(31))) * second
        return x ^ (x >> np.uint64(29))

    return majority(hashes, mixed)


def fingerprint(text: bytes, shingle_words: int = 4, seed: int = 42) -> int:
    return int(majority(shingle_hashes(text, shingle_words, seed)[:, None])[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """doc_id long, fp long (the 64 bits): majority bits of the XXH64 of all word shingles, repeats included.

    A-Z count as a-z; words lie between ASCII white space. A text with fewer words is one shingle; one without words, as
    a null text, has fingerprint zero.
    """

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fp long")


def block_masks(bits: int, agree: int = 2) -> list[int]:
    """One mask for each choice of `agree` among bits+agree blocks: words at most `bits` apart agree on one of them."""
    edges = np.linspace(0, 64, bits + agree + 1).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(blocks, agree)]


def agreeing_blocks(count: int, bits: int) -> int:
    """Blocks that must agree, so many that `count` fingerprints spread to NODE a top node: two to 600 million, then three."""
    agree = 2
    while count > NODE << int(64 * agree / (bits + agree)):
        agree += 1
    return agree


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its number and the elements, one after another."""
    which = np.repeat(np.arange(len(first)), count)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def apart(x: np.ndarray) -> np.ndarray:
    """Set bits of each row of words."""
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


class GrayIndex:
    """Fingerprints (rows of uint64 words, sorted by top node and Gray rank) and the nodes above them.

    `root` has a number for each fingerprint: those of one number are known to be connected. It may be changed, to connect
    more, while `pairs` runs.
    """

    def __init__(self, fps: np.ndarray, top: np.ndarray, root: np.ndarray):
        self.fps, self.root = fps, root
        # levels of nodes: first and end of children, shared bits and their values, top node
        self.levels = [(None, None, np.full_like(fps, ~np.uint64(0)), fps, top)]
        while True:
            _, _, shared, value, node_top = self.levels[-1]
            size = len(value)
            start = np.flatnonzero(np.diff(node_top, prepend=node_top[0] - 1 if size else 0))
            if len(start) == size:
                break
            nth = np.arange(size) - np.repeat(start, np.diff(start, append=size))
            at = np.flatnonzero(nth % FANOUT == 0)
            both, any_ = np.bitwise_and.reduceat(value, at, axis=0), np.bitwise_or.reduceat(value, at, axis=0)
            mask = np.bitwise_and.reduceat(shared, at, axis=0) & ~(both ^ any_)
            self.levels.append((at, np.append(at[1:], size), mask, both & mask, node_top[at]))

    def one_roots(self) -> list[np.ndarray]:
        """For each level the one root of all members of a node, or a negative number of its own."""
        out = [self.root]
        for at, *_ in self.levels[1:]:
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1 - np.arange(len(at))))
        return out

    def pairs(self, bits: int, block: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of one top node at most `bits` apart whose roots differ, some at a time; at most `block` a level are held."""
        roots, seen, age = self.one_roots(), self.root, 0
        a = b = np.arange(len(self.levels[-1][3]))
        stack, span = [(len(self.levels) - 1, a, b, 0)], max(1, block // FANOUT**2)
        while stack:
            depth, a, b, at = stack.pop()
            if depth == 0:
                keep = self.root[a] != self.root[b]
                a, b = a[keep], b[keep]
                total = np.zeros(len(a), np.int64)
                for w in range(0, self.fps.shape[1], 2):  # differences add up, and most pairs are over the limit soon
                    total += apart(self.fps[a, w : w + 2] ^ self.fps[b, w : w + 2])
                    keep = total <= bits
                    a, b, total = a[keep], b[keep], total[keep]
                if len(a):
                    yield a, b
                continue
            if at + span < len(a):
                stack.append((depth, a, b, at + span))
            age += 1
            if seen is not self.root and age >= 8:
                roots, seen, age = self.one_roots(), self.root, 0
            a, b = a[at : at + span], b[at : at + span]
            (first, end, mask, value, _), r = self.levels[depth], roots[depth]
            keep = (apart((value[a] ^ value[b]) & mask[a] & mask[b]) <= bits) & ~((r[a] == r[b]) & (r[a] >= 0))
            a, b = a[keep], b[keep]
            which, left = _expand(first[a], end[a] - first[a])
            pair, right = _expand(first[b[which]], (end[b] - first[b])[which])
            left = left[pair]
            ordered = left < right if depth == 1 else left <= right
            stack.append((depth - 1, left[ordered], right[ordered], 0))


def linked(fps: np.ndarray, top: np.ndarray, bits: int, block: int = 1 << 17) -> np.ndarray:
    """Smallest index that each of `fps` (rows of uint64 words, sorted by top node and Gray rank) reaches by links inside its top node."""
    n = len(fps)
    near = (top[1:] == top[:-1]) & (apart(fps[1:] ^ fps[:-1]) <= bits)
    index = GrayIndex(fps, top, local_roots(n, np.flatnonzero(near), np.flatnonzero(near) + 1))
    for a, b in index.pairs(bits, block):
        a, b = index.root[a], index.root[b]
        index.root = local_roots(n, np.concatenate([np.arange(n), a]), np.concatenate([index.root, b]))
    return index.root


def _link(masks: list[int], bits: int):
    def run(key, rows):
        mask = rows.column("mask").to_numpy()
        fps = rows.column("fp").to_numpy().view(np.uint64)
        pattern = fps & np.array(masks, np.uint64)[mask]
        order = np.lexsort((gray_rank(fps), pattern, mask))
        fps, pattern, mask = fps[order], pattern[order], mask[order]
        new = np.ones(len(fps), bool)
        new[1:] = (pattern[1:] != pattern[:-1]) | (mask[1:] != mask[:-1])
        root = linked(fps[:, None], np.cumsum(new), bits)
        far = root != np.arange(len(fps))
        vertex = fps.view(np.int64)
        return pa.table({"u": pa.array(vertex[far]), "v": pa.array(vertex[root[far]])})

    return run


def group_fingerprints(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, rep, component) of each distinct fingerprint in (doc_id, fp): its smallest doc_id, and the smallest reached.

    A null id counts as the largest long. Copies were folded before anything is linked, so a group of any size of copies is
    one row. Fingerprints are the vertices, ids only labels: those of null or repeated ids are not linked by their id.
    """
    spark = fps.sparkSession
    last = F.lit((1 << 63) - 1)
    distinct = materialise(fps.groupBy("fp").agg(F.min(F.coalesce("doc_id", last)).alias("rep")))
    count = distinct.count()
    masks = block_masks(bits, agreeing_blocks(count, bits))
    buckets = max(-(-count * len(masks) // 200_000), 2 * shuffle_partitions(spark))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("pattern")) for k, m in enumerate(signed)
    ])).alias("x")).select("fp", "x.mask", F.pmod(F.xxhash64("x.mask", "x.pattern"), F.lit(buckets)).cast("int").alias("bucket"))
    links = keyed.groupBy("bucket").applyInArrow(_link(masks, bits), "u long, v long")
    groups = _labelled(distinct.withColumnRenamed("fp", "v"), components(links), distinct.select("fp", "rep", F.col("fp").alias("v")))
    return groups.select("fp", "rep", F.col("component_id").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, bits: int = 4) -> DataFrame:
    """doc_id long, fp long, component_id long: the smallest id reachable over fingerprints at most `bits` apart.

    One row for each row of `docs`; repeated rows share a component. All texts without words, null ones too, have
    fingerprint zero and are linked like any other. Rows of null id get the smallest id of their group, or the largest
    long if it has none. Other columns are not read; an empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle_words))
    groups = group_fingerprints(fps, bits)
    return fps.join(groups.select("fp", F.col("component").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def expected_difference(similarity: float) -> float:
    """Share of bits that differ between texts of equal size with that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


#: Share of bits in which four shingles differ from the same and one more. No larger sets 0.8 alike differ in more.
FEW_SHINGLES, FEW = 0.1875, 20


def limits(similarity: float, words: int = WORDS) -> tuple[int, int]:
    """Bits in which sets of that similarity differ at most, but for three standard deviations: large sets, and below FEW."""
    return tuple(int(64 * words * p + 3 * math.sqrt(64 * words * p * (1 - p))) for p in (expected_difference(similarity), max(FEW_SHINGLES, expected_difference(similarity))))


def sampled_masks(count: int, bits: int, words: int, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((count, 64 * words), np.uint8)
    for row in out:
        row[rng.choice(64 * words, bits, replace=False)] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def masks_for(count: int, similarity: float, recall: float, words: int = WORDS) -> tuple[np.ndarray, int]:
    """Masks of sampled bits that spread `count` fingerprints to NODE a top node, and how many of them large sets need.

    So many that a pair of exactly that similarity meets under one with probability `recall`: under any if a set has few
    shingles, under the first ones else.
    """
    bits = max(10, (count // NODE).bit_length())
    need = lambda differ: math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits))
    all_, large = need(max(FEW_SHINGLES, expected_difference(similarity))), need(expected_difference(similarity))
    return sampled_masks(all_, bits, words), large


def hub_links(fps: np.ndarray, limit: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(hub, member) among the fingerprints of one top node: the one nearest to the majority of all bits, then that of what is left.

    Ends when a hub has few near members. What it leaves out is compared pair by pair later.
    """
    rest, hubs, members = np.arange(len(fps)), [], []
    while len(rest) >= least:
        hub = rest[apart(fps[rest] ^ majority(fps[rest])).argmin()]
        near = apart(fps[rest] ^ fps[hub]) <= limit
        star = rest[near & (rest != hub)]
        if len(star) + 1 < least:
            break
        hubs.append(np.full(len(star), hub))
        members.append(star)
        rest = rest[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *hubs]), np.concatenate([none, *members])


def shared_signs(v: np.ndarray, hub: np.ndarray, extra: pa.ChunkedArray, words: int = 4) -> np.ndarray:
    """Bits of what a text has besides its hub's shingles and another text of the hub has too: without a common bit, two share nothing of it."""
    out = np.zeros((len(v), words), np.uint64)
    blobs = [np.frombuffer(x, np.uint64) if x else np.zeros(0, np.uint64) for x in extra.to_pylist()]
    first = np.unique(v, return_index=True)[1]  # a text is here once for each mask
    row, value = np.repeat(first, [len(blobs[k]) for k in first]), np.concatenate([np.zeros(0, np.uint64), *(blobs[k] for k in first)])
    key = (value ^ hub[row].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    count = np.unique(key, return_inverse=True, return_counts=True)
    bit = key[(common := count[2][count[1]] > 1)] >> np.uint64(56)
    np.bitwise_or.at(out, (row[common], (bit >> np.uint64(6)).astype(np.int64) % words), np.uint64(1) << (bit & np.uint64(63)))
    return out[first[np.unique(v, return_inverse=True)[1]]]


class _Candidates:
    """Pairs of (v, n, part, fp) that may be alike: nodes of an index under masks, spread over the cluster."""

    def __init__(self, spark, count: int, similarity: float, recall: float):
        (self.masks, self.large), self.limit = masks_for(count, similarity, recall), limits(similarity)
        self.similarity, self.buckets = similarity, max(-(-count * len(self.masks) // 100_000), 2 * shuffle_partitions(spark))

    def key(self, fps: np.ndarray, k: int) -> np.ndarray:
        """A hash of each row under mask k."""
        h = np.full(len(fps), k + 1, np.uint64)
        for w in np.flatnonzero(self.masks[k]):
            h = (h ^ (fps[:, w] & self.masks[k][w])) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def first_met(self, x: np.ndarray, y: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Whether the node is that of the first mask under which two rows agree."""
        out, left = np.zeros(len(x), bool), np.arange(len(x))
        for k, mask in enumerate(self.masks):
            some = np.flatnonzero(mask)
            met = ~((x[left][:, some] ^ y[left][:, some]) & mask[some]).any(axis=1)
            at, left = left[met], left[~met]
            out[at] = self.key(x[at], k).view(np.int64) == node[at]
        return out

    def dealt(self, rows: DataFrame, masks: int, salts: int):
        """`rows` once for each of the first `masks`, grouped by bucket of top nodes; a node is dealt to `salts` of them.

        Beyond the masks that large sets need, only those go on that are small enough to be like one of few shingles.
        """
        most = FEW / self.similarity + 1

        def deal(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    blobs, v = part.column("fp"), part.column("v").to_numpy().view(np.uint64)
                    fps = np.frombuffer(b"".join(blobs.to_pylist()), np.uint64).reshape(len(blobs), -1)
                    for k in range(masks):
                        if k == self.large:
                            few = np.flatnonzero(part.column("n").to_numpy() < most)
                            part, fps, v = part.take(pa.array(few)), fps[few], v[few]
                        h = self.key(fps, k) + (v >> np.uint64(8)) % np.uint64(salts)
                        bucket = ((h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(h.view(np.int64)), *part.columns], ["bucket", "node", *part.schema.names])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(deal, f"bucket int, node long, {kinds}").groupBy("bucket")

    @staticmethod
    def columns(rows: pa.Table):
        rows = rows.combine_chunks()
        return np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(rows.num_rows, -1), *(rows.column(c).to_numpy() for c in ("node", "v", "n", "part"))

    def hubs(self, rows: DataFrame, salts: int = 1, masks: int = 8) -> DataFrame:
        """(a, b) of members and their hub; of a few masks, since it only folds large groups."""

        def run(key, rows):
            fps, node, v, _, _ = self.columns(rows)
            order = np.argsort(node, kind="stable")
            out = [np.zeros((2, 0), np.int64)]
            start = np.flatnonzero(np.diff(node[order], prepend=node[order[0]] - 1))
            for a, b in zip(start, [*start[1:], len(order)], strict=True):
                at = order[a:b]
                hub, member = hub_links(fps[at], self.limit[0])
                out.append(np.stack([v[at[member]], v[at[hub]]]))
            a, b = np.unique(np.concatenate(out, axis=1), axis=1)
            return pa.table({"a": a, "b": b})

        return self.dealt(rows, min(masks, len(self.masks)), salts).applyInArrow(run, "a long, b long").distinct()

    def pairs(self, rows: DataFrame) -> DataFrame:
        """(a, b, sure) of every pair of different parts that some mask brings together and whose bits and sizes allow the similarity.

        A pair is reported once, under the first mask on which it agrees. Of two texts of one hub the distances to it say
        more: they are no pair if those are further apart than pairs may be, and where both came with their differences from
        the hub, their similarity is known: it is a sure pair or none.
        """

        def run(key, rows):
            fps, node, v, n, part = self.columns(rows)
            root = np.unique(part, return_inverse=True)[1]
            grouped = np.where(np.bincount(root)[root] > 1, root + 1, 0)  # members of one part side by side, so that their nodes have one root
            order = np.lexsort((gray_rank(fps[:, 0]), grouped, node))
            hub, near = (rows.column(c).fill_null(0).to_numpy()[order] for c in ("hub", "near"))
            hubs, rows = rows.column("hubs").fill_null(0).to_numpy()[order], rows.take(pa.array(order))
            known = rows.column("missing").is_valid().to_numpy()
            fps, v, n, root, node = fps[order], v[order], n[order], root[order], node[order]
            apart_most, sets = 1 - self.similarity + 1e-9, {}

            def lists(k):
                if k not in sets:
                    sets[k] = [frozenset(np.frombuffer(rows.column(c)[k].as_buffer(), kind).tolist()) for c, kind in (("missing", np.uint32), ("extra", np.uint64))]
                return sets[k]

            def sure(x, y):
                (mx, ex), (my, ey) = lists(x), lists(y)
                both = hubs[x] - len(mx | my) + len(ex & ey)
                return both >= self.similarity * (n[x] + n[y] - both) - 1e-9

            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))]
            lacking = np.array([len(x) for x in rows.column("missing").fill_null(b"").to_pylist()]) // 4
            signs = shared_signs(v, hub, rows.column("extra"))
            # texts of few shingles may differ in more bits; they have an index of their own, with those that are large enough to be like them
            for some, limit in ((np.flatnonzero(n >= FEW), self.limit[0]), (np.flatnonzero(n < FEW / self.similarity + 1), self.limit[1])):
                if not len(some):
                    continue
                index = GrayIndex(fps[some], np.cumsum(np.diff(node[some], prepend=node[some[0]]) != 0), root[some])
                for a, b in index.pairs(limit):
                    a, b = some[a], some[b]
                    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                    keep = (small >= self.similarity * large - 1e-9) & ((limit == self.limit[0]) | (small < FEW))
                    a, b = a[keep], b[keep]
                    same = (hub[a] == hub[b]) & (near[a] > 0) & (near[b] > 0)
                    # what both have at least to be alike, and at most if they share nothing that the hub lacks
                    least = np.ceil(self.similarity * (n[a] + n[b]) / (1 + self.similarity) - 1e-6)
                    most = hubs[a] - np.maximum(lacking[a], lacking[b])
                    strange = known[a] & known[b] & (most < least) & ~(signs[a] & signs[b]).any(axis=1)
                    keep = ~(same & ((np.abs(near[a] - near[b]) > apart_most) | strange))
                    a, b, same = a[keep], b[keep], same[keep]
                    own = self.first_met(fps[a], fps[b], node[a])
                    a, b, same = a[own], b[own], same[own] & known[a[own]] & known[b[own]]
                    good = ~same
                    good[same] = [sure(x, y) for x, y in zip(a[same].tolist(), b[same].tolist(), strict=True)]
                    out.append((v[a[good]], v[b[good]], same[good]))
            a, b, certain = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": certain})

        return self.dealt(rows, len(self.masks), 1).applyInArrow(run, "a long, b long, sure boolean")


def set_number(hashes: np.ndarray, check: int) -> int:
    """64 bits of a sorted set of hashes."""
    return (xxhash.xxh64_intdigest if check else xxhash.xxh3_64_intdigest)(hashes.tobytes(), check)


#: Sets that share a 64-bit number with another, which the driver holds: some 50 are expected among 40 billion.
MOST_CLASHES = 10_000
#: Bits of the table that picks texts for a comparison, at most: 8 MB, whatever the corpus. A full table picks too much, never too little.
TABLE_BITS = 26


#: Of texts this near to their hub the differences from it are kept.
NEAR_HUB = 0.6


def _compared(pairs: DataFrame, distinct: DataFrame, texts: DataFrame, shingle_words: int, clashes: set[int], number=set_number) -> DataFrame:
    """(a, b, near, hubs, missing, extra) of pairs (a, b): their similarity, the size of b's set, and from NEAR_HUB on which of it a lacks
    (places in the sorted set) and what a has besides. Only texts of a pair move, picked by a table of bits."""
    spark = pairs.sparkSession
    pairs = materialise(pairs)
    ids = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    ids = materialise(distinct.join(ids, "v", "left_semi").select("t"))
    wide = min(TABLE_BITS, max(20, (8 * ids.count()).bit_length()))
    place = lambda t: (t.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - wide)

    def vertex(s):
        v = np.uint64(number(s, 0))
        return number(s, 1) if int(v.view(np.int64)) in clashes else int(v)

    def bit_slice(key, rows):
        bits = np.zeros(1 << 20, np.uint8)
        bits[place(rows.column("t").to_numpy()) & np.uint64((1 << 20) - 1)] = 1
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def slices(batches):
        for batch in batches:
            t = batch.column("t").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((place(t) >> np.uint64(20)).astype(np.int64)), pa.array(t)], ["slice", "t"])

    found = dict(ids.mapInArrow(slices, "slice long, t long").groupBy("slice").applyInArrow(bit_slice, "slice long, bits binary").collect())  # at most 8 MB
    table = spark.sparkContext.broadcast(b"".join(bytes(found.get(k, bytes(1 << 17))) for k in range(1 << (wide - 20))))

    def pick(batches):
        bits, seen = np.frombuffer(table.value, np.uint8), set()
        for batch in batches:
            t = batch.column("t").to_numpy()
            at, out = place(t), []
            for k in np.flatnonzero(bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).tolist():
                if t[k] not in seen:  # copies in a task are read once
                    seen.add(t[k])
                    s = np.unique(shingle_hashes(batch.column("text")[k].as_py(), shingle_words))
                    out.append((vertex(s), s.tobytes()))
            v, sets = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)), pa.array(sets, pa.binary())], ["v", "set"])

    def compare(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part, out = batch.slice(lo, 1000), []
                for x, y in zip(part.column("left"), part.column("right"), strict=True):
                    x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                    common = np.intersect1d(x, y, assume_unique=True)
                    near = len(common) / max(1, len(x) + len(y) - len(common)) if len(x) + len(y) else 1.0
                    close = near >= NEAR_HUB
                    out.append((near, len(y), np.flatnonzero(~np.isin(y, common, assume_unique=True)).astype(np.uint32).tobytes() if close else None, np.setdiff1d(x, common, assume_unique=True).tobytes() if close else None))
                near, size, missing, extra = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(near, pa.float64()), pa.array(size, pa.int64()), pa.array(missing, pa.binary()), pa.array(extra, pa.binary())], ["a", "b", "near", "hubs", "missing", "extra"])

    few = materialise(texts.select("t", "text").mapInArrow(pick, "v long, set binary").dropDuplicates(["v"]))
    both = pairs.join(few.select(F.col("v").alias("a"), F.col("set").alias("left")), "a").join(few.select(F.col("v").alias("b"), F.col("set").alias("right")), "b")
    out = materialise(both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long, near double, hubs long, missing binary, extra binary"))
    for t in (pairs, ids, few):
        drop_table(t)
    return out


def _with_hubs(vertices: DataFrame, compared: DataFrame, similarity: float) -> DataFrame:
    """Adds to (v, ...) one hub each and what is known of it: that of most members, differences known, where not all of its members are alike to it."""
    hubs = compared.groupBy("b").agg(F.count("*").alias("_members"), F.min("near").alias("_least"), F.first("hubs").alias("hubs")).where(F.col("_least") < similarity)
    none = F.unhex(F.lit(""))
    itself = hubs.select(F.col("b").alias("v"), F.struct(F.lit(True).alias("_known"), "_members", F.col("b").alias("hub"), F.lit(1.0).alias("near"), "hubs", none.alias("missing"), none.alias("extra")).alias("h"))
    held = compared.drop("hubs").join(hubs, "b").select(F.col("a").alias("v"), F.struct(F.col("missing").isNotNull().alias("_known"), "_members", F.col("b").alias("hub"), "near", "hubs", "missing", "extra").alias("h"))
    best = held.unionByName(itself).groupBy("v").agg(F.max("h").alias("h"))
    return vertices.join(best, "v", "left").select(*vertices.columns, *(F.col(f"h.{c}").alias(c) for c in ("hub", "near", "hubs", "missing", "extra")))


def _main_hubs(held: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of texts and the main hub b of their family: families are hubs, not all of whose members are alike to them, and members that they share.

    Texts made from one template come under many hubs, and only those of one hub can be told apart by their differences from it.
    """
    hubs = held.groupBy("b").agg(F.count("*").alias("_members"), F.min("near").alias("_least")).where(F.col("_least") < similarity).select("b", "_members")
    near = materialise(held.where(F.col("near") >= NEAR_HUB).select("a", "b").join(hubs, "b").select("a", "b", "_members"))
    roots = components(near.select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = materialise(roots.union(roots.select(F.col("root").alias("v"), "root")).distinct())
    main = near.select(F.col("b").alias("v"), "_members").distinct().join(roots, "v").groupBy("root").agg(F.max(F.struct("_members", "v")).alias("m"))
    pairs = roots.join(main.select("root", F.col("m.v").alias("b")), "root").where("v <> b").select(F.col("v").alias("a"), "b")
    out = materialise(pairs)
    drop_table(near)
    drop_table(roots)
    return out


def _groups(docs: DataFrame, similarity: float, id_col: str, text_col: str, shingle_words: int, recall: float, salt_rows: int = 1 << 20, number=set_number) -> DataFrame:
    """doc_id long, digest string (of the text), root long and component_id long of each row of `docs`."""
    spark = docs.sparkSession
    last = F.lit((1 << 63) - 1)
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.md5("text").alias("digest"), F.xxhash64("text").alias("t"), F.col("text").cast("binary").alias("text"))

    def described(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, out = batch.slice(lo, 500), []
                for t in part.column("text").to_pylist():
                    s = np.unique(shingle_hashes(t, shingle_words))
                    out.append((number(s, 0), number(s, 1), len(s), wide_fingerprint(s).tobytes()))
                *numbers, fps = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), part.column("t"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in numbers), pa.array(fps, pa.binary())],
                    ["doc_id", "digest", "t", "v", "check", "n", "fp"],
                )

    rows = materialise(texts.mapInArrow(described, "doc_id long, digest string, t long, v long, check long, n long, fp binary"))
    first = rows.groupBy("v").agg(F.min(F.coalesce("doc_id", last)).alias("rep"), F.min("t").alias("t"), F.min("n").alias("n"), F.min("fp").alias("fp"), (F.min("check") != F.max("check")).alias("clash"))
    distinct = materialise(first)
    clashes = {r["v"] for r in distinct.where("clash").select("v").limit(MOST_CLASHES + 1).collect()}
    if len(clashes) > MOST_CLASHES:
        raise ValueError("too many sets of shingles share a 64-bit number")
    if clashes:  # those sets go by their other number
        rows = rows.withColumn("v", F.when(F.col("v").isin(clashes), F.col("check")).otherwise(F.col("v")))
        drop_table(distinct)
        distinct = materialise(rows.groupBy("v").agg(*(F.min(F.coalesce("doc_id", last) if c == "rep" else c).alias(c) for c in ("rep", "t", "n", "fp"))))
    count = distinct.count()
    index = _Candidates(spark, count, similarity, recall)
    compared = lambda pairs: _compared(pairs, distinct, texts, shingle_words, clashes, number)
    alike = lambda rows: rows.where(F.col("near") >= similarity - 1e-9).select(F.col("a").alias("u"), F.col("b").alias("v"))

    # first members of large groups with their hubs, so that these fold before pairs are made
    vertices = distinct.select("v", "n", F.col("v").alias("part"), "fp")
    salts = -(-count // salt_rows)
    held = compared(index.hubs(vertices, salts))
    if salts > 1:  # groups of one node that were folded apart, by their roots
        roots = components(alike(held)).select(F.col("root").alias("v")).distinct()
        held = held.union(compared(index.hubs(vertices.join(roots, "v", "left_semi"))))
    folded = components(alike(held))
    # all of a family measured from one hub
    main = compared(_main_hubs(held, similarity))
    # then every pair of different groups
    parts = vertices.drop("part").join(folded.withColumnRenamed("root", "part"), "v", "left").withColumn("part", F.coalesce("part", "v"))
    parts = materialise(_with_hubs(parts.select("v", "n", "part", "fp"), held.union(main), similarity))
    pairs = materialise(index.pairs(parts))
    other = compared(pairs.where("not sure").select("a", "b"))
    links = alike(held).union(alike(main)).union(alike(other)).union(pairs.where("sure").select("a", "b"))
    kept = materialise(rows.select("doc_id", "digest", "v"))
    out = _labelled(distinct.select("v", "rep"), components(links), kept)
    for t in (rows, distinct, parts, held, main, pairs, other):
        drop_table(t)
    return out


def _labelled(distinct: DataFrame, roots: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows`, which have v, with the root of their group and its smallest rep as component_id, in place of v."""
    grouped = materialise(distinct.join(roots, "v", "left").select("v", "rep", F.coalesce("root", "v").alias("root")))
    least = materialise(grouped.groupBy("root").agg(F.min("rep").alias("component_id")))
    return rows.join(grouped.select("v", "root"), "v").join(least, "root").drop("v")


def similar_documents(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, recall: float = 0.999) -> DataFrame:
    """doc_id long, component_id long of each row of `docs`: the smallest id reachable over texts that are `similarity` alike.

    That is the Jaccard similarity of their sets of word shingles, and every link is confirmed on the sets. Which texts to
    compare, fingerprints say: a pair of exactly that similarity is found with probability `recall` (and that of three
    standard deviations, 0.998), a more similar one more surely; the more texts, the more masks. Texts without words are all
    alike. Nulls, ties, repeated rows and empty tables as in `near_duplicates`.
    """
    return _groups(docs, similarity, id_col, text_col, shingle_words, recall).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.999) -> DataFrame:
    """One row of `docs`, all columns, of each group: one of the smallest id (null counts as the largest), and then of the least digest."""
    key, digest = f"_key_{id_col}", f"_digest_{id_col}"
    groups = _groups(docs, similarity, id_col, text_col, 5, recall)
    chosen = groups.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias(key), F.col("digest").alias(digest))).alias("x")).select("x.*")
    keyed = docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1))).withColumn(digest, F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    return keyed.join(chosen, [key, digest], "left_semi").dropDuplicates([key, digest]).drop(key, digest)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all texts; those without words have fingerprint zero and are linked like any other."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
