"""Repair of the turn structure of conversations: the cheapest edits that make roles alternate, found for many at a time.

Roles must read: an optional system turn, then user and assistant in turns, ending with the assistant; or nothing. Keeping,
changing, deleting and inserting turns cost something each. Conversations are bucketed by length; per turn, the costs to
go of all conversations of a bucket are one NumPy step over a time-major tensor, from the last turn to the first. The
stored costs then lead the trace of edits forward, again one step a turn for all conversations.

A conversation of very many turns is cut into segments. The costs through a segment are a small matrix from the state
before it to the state after it; the matrices of a conversation give the costs to go at each cut, and from there all
segments are traced apart. Both ways give the same edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions, table

#: Fixed values of the contract.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
RETURNED, REROLED, DELETED, TRUNCATED = 3, 3, 4, 3
#: States of the repaired turns so far: none, system, last one user, last one assistant. NEXT: where a user or assistant turn leads.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs to go when no turn is left; those of the last two are one or two insertions.
FINAL = np.array([0, 2 * RETURNED, RETURNED, 0], np.int64)
NEVER = np.int64(1 << 60)
#: Rows and text bytes of a conversation above which it is cut, of one batch of others, and of a segment.
LONG_ROWS, LONG_BYTES = 20_000, 32 << 20
BATCH_ROWS, BATCH_BYTES = 20_000, 16 << 20
SEGMENT_ROWS, SEGMENT_BYTES = 8192, 8 << 20
#: A turn's initial as a class: s, u, a, other.
CLASSES = {"s": 0, "u": 1, "a": 2}
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damaged(conversations: DataFrame, every: int = 20) -> DataFrame:
    """Rows with planted faults, by crc32 of `conv_id:turn` modulo `every`: conv_id, turn, role, text, copies (0 of a dropped row, 2 of a repeated one).

    Nulls of role and text are one space, as are those of id and turn inside the checksum.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"))
    hit = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(every))
    return rows.withColumn("_hit", hit).select(
        "conv_id", "turn", F.when(F.col("_hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_hit") <= 1, F.lit("")).when(F.col("_hit") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_hit") == 0, 0).when(F.col("_hit") == 3, 2).otherwise(1).alias("copies"),
    )


def _own_faults() -> list[Column]:
    """What a turn shows by itself: blank, cut off, class of its role's initial."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return [(bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"), kind.cast("byte").alias("kind")]


# --- costs and traces ---------------------------------------------------------------------------------------------


class Turns:
    """Turns of a bucket, time-major: class, must go, cut off, and how many times each counts (0 pads)."""

    def __init__(self, kind: np.ndarray, gone: np.ndarray, cut: np.ndarray, times: np.ndarray):
        self.kind, self.gone, self.cut, self.times = kind, gone, cut, times

    @classmethod
    def of(cls, which: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kind, gone, cut, times) -> Turns:
        """The bucket of sequences `which` among rows that lie one after another."""
        t = np.arange(int(sizes[which].max(initial=0)))[:, None]
        at, real = starts[which][None] + t, t < sizes[which][None]
        at = np.where(real, at, 0)
        return cls(np.where(real, kind[at], 3), np.where(real, gone[at], True), np.where(real, cut[at], False), np.where(real, times[at], 0))

    def options(self, t: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Costs to go (4 states, sequences) if turn t is deleted, kept, or given the role that is due."""
        extra = np.where(self.gone[t], NEVER, TRUNCATED * self.cut[t].astype(np.int64))
        keep = np.full_like(after, NEVER)
        kind = self.kind[t]
        keep[NONE] = np.where(kind == 0, after[SYSTEM], np.where(kind == 1, after[USER], NEVER))
        keep[SYSTEM] = keep[ASSISTANT] = np.where(kind == 1, after[USER], NEVER)
        keep[USER] = np.where(kind == 2, after[ASSISTANT], NEVER)
        return np.minimum(after + DELETED * self.times[t], NEVER), np.minimum(keep + extra, NEVER), np.minimum(after[NEXT] + REROLED + extra, NEVER)

    def costs(self, last: np.ndarray) -> np.ndarray:
        """Costs to go (turns + 1, 4 states, sequences), `last` (4 states, sequences) after all turns."""
        out = np.empty((len(self.kind) + 1, *last.shape), np.int64)
        out[-1] = last
        for t in range(len(self.kind) - 1, -1, -1):
            base = np.minimum.reduce(self.options(t, out[t + 1]))
            once = np.minimum(base, np.minimum(base[NEXT] + RETURNED, NEVER))
            out[t] = np.minimum(base, np.minimum(once[NEXT] + RETURNED, NEVER))
        return out

    def trace(self, costs: np.ndarray, state: np.ndarray, ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edits (sequences, places) as letters, 0 for none, the state after each, and the last state.

        There are three places a turn, for two insertions and the turn itself, and two at the end, which are used if
        `ends`. Of equally cheap edits the least letter is taken, so each whole string is the least one.
        """
        turns, n = len(self.kind), len(state)
        letters, states = np.zeros((3 * turns + 2, n), np.uint8), np.zeros((3 * turns + 2, n), np.uint8)
        state, every = state.copy(), np.arange(n)
        for t in range(turns):
            delete, keep, change = self.options(t, costs[t + 1])
            open_ = np.ones(n, bool)
            for place in range(3):
                now = costs[t][state, every]
                d = open_ & (delete[state, every] == now)
                i = open_ & ~d & (costs[t][NEXT[state], every] + RETURNED == now) if place < 2 else np.zeros(n, bool)
                k = open_ & ~d & ~i & (keep[state, every] == now)
                r = open_ & ~d & ~i & ~k
                kept = np.where(self.kind[t] == 0, SYSTEM, np.where(self.kind[t] == 1, USER, ASSISTANT))
                state = np.where(i | r, NEXT[state], np.where(k, kept, state))
                at = 3 * t + np.where(i, place, 2)
                for mask, letter in ((d & (self.times[t] > 0), "D"), (i, "I"), (k, "K"), (r, "R")):
                    letters[at[mask], every[mask]], states[at[mask], every[mask]] = ord(letter), state[mask]
                open_ = i
        for place in (3 * turns, 3 * turns + 1) if ends else ():
            i = (state == USER) | (state == SYSTEM)
            state = np.where(i, NEXT[state], state)
            letters[place, i], states[place, i] = ord("I"), state[i]
        return letters.T, states.T, state


def buckets(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Indexes of sequences whose lengths have as many binary digits, so that padding at most doubles a tensor."""
    digits = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(digits):
        yield np.flatnonzero(digits == k)


def edited(letters: bytes, states: bytes, places: np.ndarray, roles: list[str], texts: list[str], first: int) -> list[str]:
    """`role:text` of the turns that are left; places: the turn (from `first`) of each edit's place."""
    out = []
    for letter, state, turn in zip(letters, states, places, strict=True):
        if letter == 75:  # K
            out.append(f"{roles[first + turn]}:{texts[first + turn]}")
        elif letter == 82:  # R
            out.append(f"{ROLE[state]}:{texts[first + turn]}")
        elif letter == 73:  # I
            out.append(f"{ROLE[state]}:")
    return out


# --- conversations that a task holds whole ---------------------------------------------------------------------------


def _repeats(bounds: np.ndarray, roles: list[str], texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts), bool)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        seen = set()
        for k in range(lo, hi):
            if (turn := (roles[k], texts[k])) in seen:
                out[k] = True
            seen.add(turn)
    return out


def _gaps(turns: list[int | None]) -> int | None:
    known = [t for t in turns if t is not None]
    gaps = known[-1] - known[0] + 1 - len(set(known)) if known else 0
    return gaps if gaps < 1 << 63 else None


def repaired_batch(batch: pa.Table) -> pa.RecordBatch:
    """A row for each conversation of rows in order, with all its rows, dropped ones included."""
    ids = batch.column("conv_id").combine_chunks()
    n = batch.num_rows
    key, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (null[1:] != null[:-1])
    conv, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    copies = batch.column("copies").to_numpy()
    rows = np.repeat(np.arange(n), copies)
    take = lambda name: batch.column(name).combine_chunks().take(pa.array(rows))
    kind, cut, blank = (take(c).to_numpy(zero_copy_only=False) for c in ("kind", "cut", "blank"))
    roles, texts, turns = (take(c).to_pylist() for c in ("role", "text", "turn"))
    sizes = np.bincount(conv[rows], minlength=len(heads))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    again = _repeats(bounds, roles, texts) & ~blank
    cut = cut & ~blank & ~again
    gone = blank | again
    total = lambda x: np.bincount(conv[rows], weights=x, minlength=len(heads)).astype(np.int64)
    apart = np.zeros(len(rows), bool)
    if len(rows):
        apart[1:] = (conv[rows][1:] == conv[rows][:-1]) & ~LEGAL[kind[:-1], kind[1:]]
    cost, audits, hashes = np.zeros(len(heads), np.int64), [""] * len(heads), [hashlib.sha256(b"").hexdigest()] * len(heads)
    for which in buckets(sizes):
        turns_of = Turns.of(which, bounds[:-1], sizes, kind, gone, cut, np.ones(len(rows), np.int64))
        costs = turns_of.costs(np.repeat(FINAL[:, None], len(which), 1))
        letters, states, _ = turns_of.trace(costs, np.zeros(len(which), np.int64), True)
        cost[which] = costs[0, NONE]
        for k, c in enumerate(which):
            used = np.flatnonzero(letters[k])
            audit = letters[k][used].tobytes()
            audits[c] = audit.decode()
            left = edited(audit, states[k][used].tobytes(), used // 3, roles, texts, bounds[c])
            hashes[c] = hashlib.sha256("\n".join(left).encode("utf-8", "replace")).hexdigest()
    gaps = [_gaps(turns[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
    columns = [ids.take(pa.array(heads)), pa.array(gaps, pa.int64()), *(pa.array(total(x)) for x in (blank, again, cut, apart)), pa.array(cost), pa.array(audits, pa.string()), pa.array(hashes, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", *COUNTS, "audit", "repaired_sha256"])


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that are small enough for a task, each from its rows in one partition."""
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.select("conv_id", "turn", "role", "text", "copies", *_own_faults())

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BATCH_BYTES or sum(b.num_rows for b in held) >= BATCH_ROWS:
                rows = pa.Table.from_batches(held)
                ids = rows.column("conv_id").combine_chunks()
                last = ids[len(ids) - 1].as_py()
                same = ids.is_null() if last is None else pc.equal(ids, last).fill_null(False)
                cut = len(ids) - int(pc.sum(same).as_py())
                if cut:
                    yield repaired_batch(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = sum(b.nbytes for b in held) if cut else 0
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield repaired_batch(rows)

    return rows.mapInArrow(run, RESULT)


# --- conversations in segments -----------------------------------------------------------------------------------------

SEGMENT = "conv_id long, part int, seg long, kind binary, gone binary, cut binary, times array<bigint>, roles array<string>, texts array<string>, matrix array<bigint>, tally array<bigint>, low long, high long"


def _segments(rows: DataFrame) -> DataFrame:
    """Rows of long conversations in order, cut into segments; equal rows of a turn are one that counts several times.

    A segment has the costs from each state before it to each after it, its counts (blank, duplicate, cut off, illegal
    pairs, distinct turns) and its first and last turn. Part and seg are in the order of rows.
    """
    spark = rows.sparkSession
    same = rows.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("times"))
    same = materialise(same)
    first = same.groupBy("conv_id", "role", "text").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "first")
    both = same.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")))
    both = both.select("conv_id", "turn", "role", "text", "times", F.col("turn").eqNullSafe(F.col("first.turn")).alias("fresh"), *_own_faults())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    both = both.repartitionByRange(4 * shuffle_partitions(spark), *order, F.left("text", F.lit(64)).asc()).sortWithinPartitions(*order, "text")

    def run(batches):
        part, number, held, size, now = TaskContext.get().partitionId(), 0, [], 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["conv_id"] != now or len(held) >= SEGMENT_ROWS or size >= SEGMENT_BYTES):
                    yield _segment(held, part, number)
                    held, size, number = [], 0, number + 1
                now = row["conv_id"]
                held.append(row)
                size += len(row["text"])
        if held:
            yield _segment(held, part, number)

    return materialise(both.mapInArrow(run, SEGMENT))


def _segment(rows: list[dict], part: int, number: int) -> pa.RecordBatch:
    """One segment; the copies of a row after its first are a turn of their own that must go."""
    kind, gone, cut, times, roles, texts, tally, before = [], [], [], [], [], [], [0, 0, 0, 0, 0], None
    turns = [r["turn"] for r in rows]
    for r in rows:
        for n, again in ((1, not r["fresh"]), (r["times"] - 1, True)):
            if not n:
                continue
            kind.append(r["kind"])
            gone.append(r["blank"] or again)
            cut.append(r["cut"] and not gone[-1])
            times.append(n)
            roles.append(r["role"])
            texts.append("" if gone[-1] else r["text"])  # no edit keeps it
            tally[0 if r["blank"] else 1 if again else 2] += n if gone[-1] or cut[-1] else 0
            tally[3] += n - 1 + (before is not None and not LEGAL[before, r["kind"]])
            before = r["kind"]
    known = [t for t in turns if t is not None]
    tally[4] = len(set(known))
    arrays = [np.array(kind, np.uint8), np.array(gone, bool), np.array(cut, bool)]
    one = Turns(*(np.repeat(a[:, None], 4, 1) for a in (*arrays, np.array(times, np.int64))))
    matrix = one.costs(np.where(np.eye(4, dtype=bool), 0, NEVER))[0]  # [before, after]
    values = [rows[0]["conv_id"], part, number, *(a.tobytes() for a in arrays), times, roles, texts, matrix.ravel().tolist(), tally, known[0] if known else None, known[-1] if known else None]
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64()), *[pa.list_(pa.string())] * 2, *[pa.list_(pa.int64())] * 2, pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [f.split()[0] for f in SEGMENT.split(", ")])


def _turns_of(row: dict, times: int = 1) -> Turns:
    kinds = (np.uint8, bool, bool)
    return Turns(*(np.repeat(np.frombuffer(row[c], k)[:, None], times, 1) for c, k in zip(("kind", "gone", "cut"), kinds, strict=True)), np.repeat(np.array(row["times"], np.int64)[:, None], times, 1))


def _rows_of(batches) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _in_order(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a conversation with its segments in order: small values of each, as many as an audit of 2 GB allows at most."""
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seg", *columns))).alias("segments"))


def _in_segments(rows: DataFrame) -> DataFrame:
    """Long conversations. Only matrices, last states and hashes of segments meet by conversation; its repaired text is hashed as a stream."""
    segments = _segments(rows)
    ends = [F.expr("cast(conv(hex(substring(kind, 1, 1)), 16, 10) as int)").alias("head"), F.expr("cast(conv(hex(substring(kind, -1, 1)), 16, 10) as int)").alias("tail")]
    small = segments.select("conv_id", "part", "seg", "matrix", "tally", "low", "high", *ends)

    def to_go(batches):
        for row in _rows_of(batches):
            last, gaps, tally, cuts, of = FINAL, [], np.zeros(5, np.int64), [], row["segments"]
            for s in reversed(of):
                cuts.append(last.tolist())
                last = (np.array(s["matrix"], np.int64).reshape(4, 4) + last[None]).min(1)
                tally += np.array(s["tally"])
            for a, b in zip(of[:-1], of[1:], strict=True):
                tally[3] += not LEGAL[a["tail"], b["head"]]
                tally[4] -= a["high"] is not None and a["high"] == b["low"]
            known = [t for s in of for t in (s["low"], s["high"]) if t is not None]
            gaps = max(known) - min(known) + 1 - int(tally[4]) if known else 0
            columns = [[row["conv_id"]], [gaps if gaps < 1 << 63 else None], *([int(x)] for x in tally[:4]), [int(last[NONE])]]
            found = pa.array([[{"part": s["part"], "seg": s["seg"], "last": c, "ends": k == len(of) - 1} for k, (s, c) in enumerate(zip(of, reversed(cuts), strict=True))]], pa.list_(pa.struct([("part", pa.int32()), ("seg", pa.int64()), ("last", pa.list_(pa.int64())), ("ends", pa.bool_())])))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), found], ["conv_id", *COUNTS, "cuts"])

    counted = materialise(_in_order(small, ["matrix", "tally", "low", "high", "head", "tail"]).mapInArrow(to_go, ", ".join(["conv_id long", *(f"{c} long" for c in COUNTS), "cuts array<struct<part: int, seg: bigint, last: array<bigint>, ends: boolean>>"])))
    cuts = counted.select(F.explode("cuts").alias("c")).select("c.*")
    known = segments.drop("matrix", "tally", "low", "high").join(cuts, ["part", "seg"])

    def leads(batches):
        for row in _rows_of(batches):
            turns = _turns_of(row, 4)
            _, _, state = turns.trace(turns.costs(np.repeat(np.array(row["last"], np.int64)[:, None], 4, 1)), np.arange(4), row["ends"])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((row["conv_id"], pa.int64()), (row["part"], pa.int32()), (row["seg"], pa.int64()), (state.tolist(), pa.list_(pa.int32())))], ["conv_id", "part", "seg", "leads"])

    led = known.drop("roles", "texts").mapInArrow(leads, "conv_id long, part int, seg long, leads array<int>")
    state = F.aggregate("segments", F.array(F.lit(NONE)), lambda a, s: F.concat(a, F.array(F.get(s["leads"], F.element_at(a, -1)))))
    began = _in_order(led, ["leads"]).select(F.explode(F.arrays_zip(F.col("segments.part").alias("part"), F.col("segments.seg").alias("seg"), F.slice(state, 1, F.size("segments")).alias("began"))).alias("s")).select("s.*")

    def pieces(batches):
        for row in _rows_of(batches):
            turns = _turns_of(row)
            letters, states, _ = turns.trace(turns.costs(np.array(row["last"], np.int64)[:, None]), np.array([row["began"]]), row["ends"])
            used = np.flatnonzero(letters[0])
            audit = letters[0][used].tobytes()
            left = edited(audit, states[0][used].tobytes(), used // 3, row["roles"], row["texts"], 0)
            shown = "".join("D" * row["times"][p] if x == 68 else chr(x) for x, p in zip(audit, (used // 3).tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((row["conv_id"], pa.int64()), (row["part"], pa.int32()), (row["seg"], pa.int64()), (shown, pa.string()), ("\n".join(left) if left else None, pa.string()))], ["conv_id", "part", "seg", "shown", "kept"])

    edits = known.join(began, ["part", "seg"]).mapInArrow(pieces, "conv_id long, part int, seg long, shown string, kept string")
    edits = edits.repartition(shuffle_partitions(rows.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seg")

    def joined(batches):
        now, audit, digest = (), [], None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["id", "audit", "repaired_sha256"])
        for row in _rows_of(batches):
            if (row["conv_id"],) != now:
                if now:
                    yield out()
                now, audit, digest, some = (row["conv_id"],), [], hashlib.sha256(), False
            audit.append(row["shown"])
            if row["kept"] is not None:
                digest.update(("\n" * some + row["kept"]).encode("utf-8", "replace"))
                some = True
        if now:
            yield out()

    texts = edits.mapInArrow(joined, "id long, audit string, repaired_sha256 string")
    return counted.join(texts, F.col("conv_id").eqNullSafe(F.col("id"))).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repaired(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """The cheapest repair of each conversation of (conv_id, turn, role, text, copies) rows, as of `damaged`: conv_id, the counts
    gaps, blank, duplicate, truncated, illegal, the cost, the edits as letters, and the SHA-256 of the turns that are left.

    Turns are in order of their number, null ones first, then of role and text; equal ids are one conversation, null ones
    too. A conversation without rows (copies 0) has zeros and no edits. Gaps are null where a long can't hold them. Other
    columns are not read; no rows give no rows. Conversations of over `long_rows` rows or `long_bytes` of text are cut into
    segments, with the same result.
    """
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.max("copies").alias("some"))
    long = materialise(sizes.where((F.col("some") > 0) & ((F.col("n") > long_rows) | (F.col("bytes") > long_bytes))).select(F.col("conv_id").alias("long_id")))
    if long.isEmpty():
        return _whole(rows)
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    return _whole(rows.join(long, is_long, "left_anti")).unionByName(_in_segments(rows.join(long, is_long, "left_semi")))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults are planted in all conversations by a checksum and repaired at least cost."""
    return repaired(damaged(table(spark, sf_dir, "conversations")))


def _crc_table() -> list[int]:
    """The remainders of the checksum's polynomial (reversed, 32 bits) for each byte."""
    out = list(range(256))
    for _ in range(8):
        out = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


def _oracle() -> str:
    before = lambda letter, cost, turn, tail: f"{{'c': {tail}.c + {cost}, 'a': '{letter}' || {tail}.a, 't': {turn} || CASE WHEN {tail}.t = '' THEN '' ELSE chr(10) || {tail}.t END}}"
    least = lambda *options: f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"
    unless_gone = lambda condition, option: f"CASE WHEN NOT gone AND {condition} THEN {option} END"
    extra = f"{TRUNCATED} * cut::INT"
    due = {"e": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    base, once, twice = [], [], []
    for state, role in due.items():
        deleted = f"{{'c': d.{state}.c + {DELETED}, 'a': 'D' || d.{state}.a, 't': d.{state}.t}}"
        keeps = [unless_gone(f"kind = '{k}'", before("K", extra, "role || ':' || text", f"d.{to}")) for k, to, where in (("s", "s", "e"), ("u", "u", "esa"), ("a", "a", "u")) if state in where]
        base.append(least(deleted, *keeps, unless_gone("true", before("R", f"{REROLED} + {extra}", f"'{name[role]}:' || text", f"d.{role}"))) + f" AS {state}")
        once.append(least(f"b.{state}", before("I", RETURNED, f"'{name[role]}:'", f"b.{role}")) + f" AS {state}")
        twice.append(least(f"b.{state}", before("I", RETURNED, f"'{name[role]}:'", f"o.{role}")) + f" AS {state}")
    end = {"e": (0, "", ""), "s": (2 * RETURNED, "II", "user:' || chr(10) || 'assistant:"), "u": (RETURNED, "I", "assistant:"), "a": (0, "", "")}
    ends = ", ".join(f"{{'c': {c}::BIGINT, 'a': '{a}', 't': '{t}'}} AS {s}" for s, (c, a, t) in end.items())
    bare = f"rtrim(text, {' || '.join(f'chr({ord(c)})' for c in SPACE)})"
    return f"""WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
 remainders AS (SELECT {_crc_table()}::BIGINT[] AS r), hit AS (SELECT g.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, r[1 + (xor(c, b) & 255)]))) % 20 AS h FROM given g, remainders),
 dealt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h <= 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
 ordered AS (SELECT *, left(role, 1) AS kind, {bare} AS bare, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM dealt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
 judged AS MATERIALIZED (SELECT *, bare = '' OR again AS gone, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, lag(kind) OVER (PARTITION BY conv_id ORDER BY i) || kind NOT IN ('su', 'ua', 'au') AS apart FROM ordered),
 counts AS MATERIALIZED (SELECT c.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE bare = '') AS blank, count(*) FILTER (WHERE bare <> '' AND again) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE apart) AS illegal, count(i) AS n
 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
 costs AS (SELECT conv_id, n + 1 AS i, {ends} FROM counts
 UNION ALL SELECT conv_id, i, {', '.join(twice)} FROM (SELECT conv_id, i, b, {{{', '.join(f"'{x.rsplit(' AS ', 1)[1]}': {x.rsplit(' AS ', 1)[0]}" for x in once)}}} AS o FROM (SELECT conv_id, i, {{{', '.join(f"'{x.rsplit(' AS ', 1)[1]}': {x.rsplit(' AS ', 1)[0]}" for x in base)}}} AS b
 FROM (SELECT j.*, {{'e': k.e, 's': k.s, 'u': k.u, 'a': k.a}} AS d FROM costs k JOIN judged j ON j.conv_id IS NOT DISTINCT FROM k.conv_id AND j.i = k.i - 1))))
 SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, k.e.c AS cost, k.e.a AS audit, sha256(k.e.t) AS repaired_sha256 FROM counts c JOIN costs k ON k.conv_id IS NOT DISTINCT FROM c.conv_id AND k.i = 1"""


ORACLE = _oracle()
