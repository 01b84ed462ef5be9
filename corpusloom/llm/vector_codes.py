"""Product codes of vectors, learned by Yinyang Lloyd rounds in whole numbers.

A vector is cut into parts; each part's codebook is moved by rounds of assignment and means. Codebook entries of a part are
clustered into groups once. Every part of every vector keeps an upper bound of the distance to its own entry and one lower
bound for each group; after entries have moved, the bounds drift with them, and only groups whose bound fails are scanned.
Bounds are rounded outwards and compared strictly, so whatever is equal or nearly so is decided on integers.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, table

#: Contract: components become floor(SCALE * x).
SCALE = 4096
#: Bytes of integers in a block of vectors, and vectors in it at most.
BLOCK, MOST_ROWS = 8 << 20, 8192
#: Sums travel in pieces of so many bits, so that any number of blocks adds up exactly.
LIMB = 40
GROUP_ROUNDS = 8
ERROR_TOP = (1 << 63) - 1


def whole(x: float) -> int:
    """floor(SCALE * x), also where the product leaves the range of floats."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.where(x > 0, x * (1 - 1e-6), x * (1 + 1e-6)).astype(np.float32), np.float32(-np.inf))


class Numbers:
    """Which arithmetic is exact for vectors of `parts` times `width` components of at most `most`: floats while squares stay
    below 2^53, 64-bit integers, or Python's own. Blocks store integers as narrow as they fit."""

    def __init__(self, most: float, parts: int, width: int):
        self.parts, self.width = parts, width
        top = abs(whole(most)) + 1
        squares = parts * width * (2 * top) ** 2
        self.floats, self.own = squares < 1 << 52, squares >= 1 << 62
        self.wide = np.dtype(object if self.own else np.int64)
        self.stored_as = np.dtype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")
        self.limbs = -(-(top.bit_length() + 64) // LIMB) if self.own else 2

    def quantised(self, x: np.ndarray) -> np.ndarray:
        return np.array([whole(v) for v in x.ravel().tolist()], object).reshape(x.shape) if self.own else np.floor(x * SCALE).astype(np.int64)

    def stored(self, q: np.ndarray) -> bytes:
        return ",".join(map(str, q.ravel().tolist())).encode() if self.own else q.astype(self.stored_as).tobytes()

    def restored(self, data: bytes) -> np.ndarray:
        flat = np.array([int(v) for v in data.split(b",")], object) if self.own else np.frombuffer(data, self.stored_as).astype(np.int64)
        return flat.reshape(-1, self.parts, self.width)

    def distances(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Exact squared distances (rows of x, rows of c)."""
        if self.floats:
            x, c = x.astype(np.float64), c.astype(np.float64)
            return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)
        return ((x[:, None] - c[None]) ** 2).sum(2)

    def pieces(self, sums: np.ndarray) -> np.ndarray:
        """The sums as longs, `limbs` for each, that add up piece by piece."""
        out = []
        for _ in range(self.limbs - 1):
            out.append(sums & ((1 << LIMB) - 1))
            sums = sums >> LIMB
        return np.stack([*out, sums], -1).astype(np.int64).ravel()

    def joined(self, pieces: dict[int, int], shape: tuple[int, ...]) -> np.ndarray:
        """The sums from sums of pieces by place; missing ones are 0."""
        n = math.prod(shape)
        return np.array([sum(pieces.get(i * self.limbs + k, 0) << (LIMB * k) for k in range(self.limbs)) for i in range(n)], object).reshape(shape)


def entry_groups(codebook: list[list[int]]) -> np.ndarray:
    """The group of each entry: about a quarter as many groups as entries, by Lloyd rounds from entries far apart."""
    scale = max(1, max((abs(v) for e in codebook for v in e), default=1))
    c = np.array([[v / scale for v in e] for e in codebook]).reshape(len(codebook), -1)
    seeds, far = [0], ((c - c[0]) ** 2).sum(1)
    while len(seeds) < len(c) // 4:
        seeds.append(int(far.argmax()))
        far = np.minimum(far, ((c - c[seeds[-1]]) ** 2).sum(1))
    centres = c[seeds]
    for _ in range(GROUP_ROUNDS):
        group = ((c[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([c[group == g].mean(0) if (group == g).any() else centres[g] for g in range(len(seeds))])
    return np.unique(group, return_inverse=True)[1]


class Coder:
    """Codebooks by part, the groups of their entries and how far each has just moved (rounded up)."""

    def __init__(self, numbers: Numbers, codebooks: list[list[list[int]]]):
        self.numbers, self.codebooks = numbers, codebooks
        self.groups = [entry_groups(c) for c in codebooks]
        self.drift = [[0.0] * len(c) for c in codebooks]

    @property
    def entries(self) -> int:
        return len(self.codebooks[0])

    @property
    def most_groups(self) -> int:
        return max(int(g.max()) + 1 for g in self.groups)

    def moved(self, sums: np.ndarray) -> Coder:
        """Entries replaced by the floor of their parts' means, from (part, entry, count and sums); unused ones stay."""
        out = Coder.__new__(Coder)
        out.numbers, out.groups = self.numbers, self.groups
        out.codebooks = [[[int(s) // int(sums[p, k, 0]) for s in sums[p, k, 1:]] if sums[p, k, 0] else e for k, e in enumerate(c)] for p, c in enumerate(self.codebooks)]
        gap = lambda a, b: float(min(math.isqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) + 1, 1 << 60)) if a != b else 0.0
        out.drift = [[gap(a, b) for a, b in zip(old, new, strict=True)] for old, new in zip(self.codebooks, out.codebooks, strict=True)]
        return out

    def reassign(self, p: int, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Gives each row of x, part `p` of vectors, its nearest entry; ties go to the lower index.

        In place: own (index of the entry), upper (rows) and lower (rows x groups) are the bounds before entries moved, and
        then those of now. Returns how many distances were computed.
        """
        numbers, group, drift = self.numbers, self.groups[p], np.array(self.drift[p])
        codebook, groups = np.array(self.codebooks[p], numbers.wide).reshape(self.entries, -1), int(group.max()) + 1
        if numbers.own:  # distances may leave the range of floats: no bounds
            upper[:], lower[:] = np.inf, 0
        else:
            upper[:] = up(upper.astype(np.float64) + drift[own])
            lower[:] = down(lower.astype(np.float64) - np.array([drift[group == g].max() for g in range(groups)]))
        at = np.flatnonzero(upper >= lower.min(1))
        best = ((x[at] - codebook[own[at]]) ** 2).sum(1)
        computed = len(at)
        if not numbers.own:
            upper[at] = up(np.sqrt(best.astype(np.float64)))
            fails = upper[at] >= lower[at].min(1)
            at, best = at[fails], best[fails]
        if not len(at):
            return computed
        before, first, now = own[at].copy(), best.copy(), own[at].copy()
        scanned = np.zeros((len(at), groups), bool)
        winner = np.full((len(at), groups), -1)  # the nearest entry of each scanned group, its distance, and that of the next
        near, next_ = np.zeros((len(at), groups)), np.full((len(at), groups), np.inf)
        for g in range(groups):
            members = np.flatnonzero(group == g)
            rows = np.flatnonzero(upper[at] >= lower[at, g])
            d = numbers.distances(x[at[rows]], codebook[members])
            computed += d.size
            k = d.argmin(1) if len(rows) else np.zeros(0, np.int64)
            low = d[np.arange(len(rows)), k]
            scanned[rows, g], winner[rows, g] = True, members[k]
            if not numbers.own:
                near[rows, g] = low
                next_[rows, g] = np.partition(d, 1, axis=1)[:, 1] if len(members) > 1 else np.inf
            hit = (low < best[rows]) | ((low == best[rows]) & (members[k] < now[rows]))
            best[rows[hit]], now[rows[hit]] = low[hit], members[k][hit]
            if not numbers.own:
                upper[at[rows[hit]]] = up(np.sqrt(low[hit].astype(np.float64)))
        own[at] = now
        if not numbers.own:
            fresh = down(np.sqrt(np.where(winner == now[:, None], next_, near)))
            kept = lower[at]
            left = np.flatnonzero((now != before) & ~scanned[np.arange(len(at)), group[before]])  # the old entry is now one of its group
            kept[left, group[before[left]]] = np.minimum(kept[left, group[before[left]]], down(np.sqrt(first[left].astype(np.float64))))
            lower[at] = np.where(scanned, fresh, kept)
        return computed


def _sums(q: np.ndarray, own: np.ndarray, entries: int) -> np.ndarray:
    """(part, entry, count and component sums) of a block."""
    out = np.zeros((q.shape[1], entries, 1 + q.shape[2]), q.dtype)
    for p in range(q.shape[1]):
        for k in np.unique(own[:, p]):
            rows = own[:, p] == k
            out[p, k, 0], out[p, k, 1:] = int(rows.sum()), q[rows, p].sum(0)
    return out


def _state(own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> bytes:
    return own.tobytes() + upper.tobytes() + lower.tobytes()


def _restored_state(data: bytes, parts: int, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // (parts * (5 + 4 * groups))
    own = np.frombuffer(data, np.uint8, n * parts).reshape(n, parts).copy()
    upper = np.frombuffer(data, np.float32, n * parts, n * parts).reshape(n, parts).copy()
    return own, upper, np.frombuffer(data, np.float32, n * parts * groups, 5 * n * parts).reshape(n, parts, groups).copy()


def _assigned(q: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, coder: Coder) -> None:
    for p in range(q.shape[1]):
        now, high, low = own[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p, : int(coder.groups[p].max()) + 1].copy()
        coder.reassign(p, q[:, p], now, high, low)
        own[:, p], upper[:, p], lower[:, p, : low.shape[1]] = now, high, low


def _block(ids: pa.Array, labels: pa.Array, q: bytes, state: bytes, change: np.ndarray, numbers: Numbers) -> pa.RecordBatch:
    listed = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
    return pa.RecordBatch.from_arrays([listed(ids), listed(labels), pa.array([q], pa.binary()), pa.array([state], pa.binary()), listed(pa.array(numbers.pieces(change)))], ["ids", "labels", "q", "state", "change"])


def _first_round(rows: DataFrame, coder: Coder, kind: str) -> DataFrame:
    """Blocks of integers, from (vec_id, label, v) rows, with their first assignment; `change` has the sums of the entries."""
    numbers = coder.numbers
    width = numbers.parts * numbers.width
    at_once = max(1, min(MOST_ROWS, BLOCK // (8 * width)))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                lists = part.column("v")
                x = np.zeros((part.num_rows, width))  # shorter vectors end in zeros
                x[np.arange(width)[None] < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
                q = numbers.quantised(x).reshape(-1, numbers.parts, numbers.width)
                n, parts, _ = q.shape
                own, upper, lower = np.zeros((n, parts), np.uint8), np.full((n, parts), np.inf, np.float32), np.zeros((n, parts, coder.most_groups), np.float32)
                _assigned(q, own, upper, lower, coder)
                yield _block(part.column("vec_id"), part.column("label"), numbers.stored(q), _state(own, upper, lower), _sums(q, own, coder.entries), numbers)

    return rows.mapInArrow(run, f"ids array<bigint>, labels array<{kind}>, q binary, state binary, change array<bigint>")


def _next_round(blocks: DataFrame, coder: Coder) -> DataFrame:
    """Blocks after entries have moved; `change` has what each entry won and lost, from the rows that changed only."""
    numbers = coder.numbers

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                q = numbers.restored(one.column("q")[0].as_py())
                own, upper, lower = _restored_state(one.column("state")[0].as_py(), numbers.parts, coder.most_groups)
                old = own.copy()
                _assigned(q, own, upper, lower, coder)
                rows = np.flatnonzero((own != old).any(1))
                change = _sums(q[rows], own[rows], coder.entries) - _sums(q[rows], old[rows], coder.entries)
                yield _block(one.column("ids").flatten(), one.column("labels").flatten(), one.column("q")[0].as_py(), _state(own, upper, lower), change, numbers)

    return blocks.mapInArrow(run, blocks.schema)


def _codes(blocks: DataFrame, coder: Coder, kind: str) -> DataFrame:
    """(vec_id, label, code, error) by the final codebooks."""
    numbers = coder.numbers

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                q = numbers.restored(one.column("q")[0].as_py())
                own, upper, lower = _restored_state(one.column("state")[0].as_py(), numbers.parts, coder.most_groups)
                _assigned(q, own, upper, lower, coder)
                error = sum(((q[:, p] - np.array(coder.codebooks[p], numbers.wide)[own[:, p]]) ** 2).sum(1) for p in range(numbers.parts)).tolist()
                digits = own.tobytes().hex()
                step = 2 * numbers.parts
                codes = [digits[i : i + step] for i in range(0, len(digits), step)]
                fits = pa.array([e if e <= ERROR_TOP else None for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), pa.array(codes, pa.string()), fits], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def _change(blocks: DataFrame, numbers: Numbers, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of all blocks' changes: a number for each component of each entry comes to the driver."""
    rows = blocks.select(F.posexplode("change").alias("place", "piece")).where("piece <> 0").groupBy("place").agg(F.sum("piece")).collect()
    return numbers.joined({r[0]: r[1] for r in rows}, shape)


def product_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[list[list[int]]]]:
    """Codes of all rows, (vec_id long, label, code string, error long), and the final codebooks by part and entry.

    Rows whose vector is null or holds null or non-finite components are left out. Entries start as the parts of the rows of
    the `entries` (256 at most) smallest ids, null ids last, rows of one id by their vectors; fewer rows make fewer entries. Vectors that are shorter than
    the longest, or whose length `parts` doesn't divide, end in zeros. Repeated rows count each. An error that a long can't
    hold is null. Other columns are not read; no rows give no codes and no codebooks.

    Blocks of vectors and their bounds are a written table a round; only sums of entries come to the driver.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    kind = rows.schema["label"].dataType.simpleString()
    longest, most = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if longest is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), []
    numbers = Numbers(most or 0.0, parts, max(1, -(-longest // parts)))
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = [[whole(x) for x in r["v"]] + [0] * (parts * numbers.width - len(r["v"])) for r in seeds]
    coder = Coder(numbers, [[e[p * numbers.width : (p + 1) * numbers.width] for e in start] for p in range(parts)])
    blocks = materialise(_first_round(rows, coder, kind))
    shape = (parts, coder.entries, 1 + numbers.width)
    sums = _change(blocks, numbers, shape)
    coder = coder.moved(sums)
    for _ in range(rounds - 1):
        after = materialise(_next_round(blocks, coder))
        drop_table(blocks)
        blocks = after
        sums = sums + _change(blocks, numbers, shape)
        coder = coder.moved(sums)
    codes = materialise(_codes(blocks, coder, kind))
    drop_table(blocks)
    return codes, coder.codebooks


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, with the errors of each label added up and a digest of the codebooks.

    Null labels are together; their sum, as that of any label, is null where a long can't hold it.
    """
    codes, codebooks = product_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(v) for c in codebooks for e in c for v in e).encode()).hexdigest()
    sums = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count_if(F.col("error").isNull()).alias("too_large"))
    sums = sums.select(F.col("label").alias("of"), F.when(F.col("too_large") == 0, F.col("total").try_cast("long")).alias("label_error"))
    joined = codes.join(sums, codes["label"].eqNullSafe(sums["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    floor_mean = "CASE WHEN sum(x) >= 0 THEN sum(x) // count(*) ELSE -((count(*) - 1 - sum(x)) // count(*)) END::BIGINT"
    gap = "list_sum(list_transform(list_zip(q.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS k, x FROM cut WHERE r <= {entries})",
    ]
    for n in range(rounds + 1):
        steps.append(f"near{n} AS MATERIALIZED (SELECT r, q.p, arg_min(k, ({gap}, k)) AS k, min({gap}) AS d FROM cut q JOIN book{n} c ON c.p = q.p GROUP BY r, q.p)")
        if n < rounds:
            steps.append(f"mean{n} AS MATERIALIZED (SELECT p, k, list(m ORDER BY i) AS x FROM (SELECT p, k, i, {floor_mean} AS m FROM (SELECT n.p, n.k, generate_subscripts(c.x, 1) AS i, unnest(c.x) AS x FROM near{n} n JOIN cut c USING (r, p)) GROUP BY p, k, i) GROUP BY p, k)")
            steps.append(f"book{n + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM book{n} b LEFT JOIN mean{n} m ON m.p = b.p AND m.k = b.k)")
    return (
        f"WITH {', '.join(steps)}, coded AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r), "
        f"book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM book{rounds}) "
        "SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), book"
    )


ORACLE = _oracle()
