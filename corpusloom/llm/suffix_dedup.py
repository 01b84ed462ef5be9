"""Exact removal of passages that an earlier document holds, by suffix sorting with bucket-pointer refinement.

A byte goes if a string of `window` bytes that covers it also starts in a document with a smaller id. The suffixes are
sorted only as deep as `window`, and only where two documents can share one:

1. Each window falls into the initial q-gram bucket named by the smallest hash among its 20-grams. Neighbouring windows
   of one bucket form a run; equal windows always fall into equal buckets. Blocks of documents send the buckets they have.
2. A bucket task tells each block which of its buckets other blocks have too.
3. Of such a bucket each block sends one copy of every distinct run, as bytes. `bucket_pointers` refines them: 8-byte
   buckets are sorted on the bucket ids at offset 8, the results at offset 16, and those at offset 18, which gives the
   classes of equal 50-byte suffixes; the smallest id of a class decides. What only one block has is refined there.

Hashes choose what is compared; no byte goes without a comparison of bytes, by pointers or, of copies of a run inside a
block, one by one. A bucket with many runs in one block (a line that a third of all documents hold, with other text
around it) is hot: its windows travel one by one, dealt by a hash of their own, each distinct one once a block, so no task
gathers what grows with the number of copies. All that travels is linear in the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, id_and_text, pack, shuffle_partitions, text_blocks, unpack

GRAM = 20
LONGEST_RUN = 32
#: Distinct runs of a bucket in a block from which on its windows travel one by one. It changes the way, not the result.
HOT_RUNS = 64
#: Bytes that are refined at a time, which should fit a processor's cache.
PART_BYTES = 1 << 16
NO_ID = np.iinfo(np.int64).max
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_MESSAGES = "block int, dest int, blob binary"


def _words(buf: np.ndarray, offset: int, n: int) -> np.ndarray:
    """The eight bytes from each position on as one number; `buf` is padded."""
    return np.ndarray((n,), "<u8", buf, offset=offset, strides=(1,))


def _offsets(length: int) -> list[int]:
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def _gram_hashes(buf: np.ndarray, at: int, n: int) -> np.ndarray:
    h = np.zeros(n, np.uint64)
    for o in _offsets(GRAM):
        h ^= h >> np.uint64(29)
        h *= _K[1]
        h += _words(buf, at + o, n) * _K[2]
    h ^= h >> np.uint64(32)
    h *= _K[3]
    h ^= h >> np.uint64(29)
    return h


def _window_hashes(buf: np.ndarray, at: np.ndarray, window: int, seed: int = 0) -> np.ndarray:
    n = len(buf) - window
    h = np.full(len(at), seed, np.uint64)
    for o in _offsets(window):
        h = (h ^ (h >> np.uint64(31))) * _K[1 - seed] + _words(buf, o, n)[at] * _K[2 + seed]
    return h ^ (h >> np.uint64(32))


def _runs(buf: np.ndarray, row_start: np.ndarray, row_len: np.ndarray, window: int, chunk: int = 1 << 19):
    """First and last window start and bucket hash of each run, in order of place."""
    n, width = int(row_len.sum()), window - GRAM + 1
    last = row_start + row_len - window  # last window start of each row
    firsts, lasts, hashes = [], [], []
    for lo in range(0, n, chunk):
        hi = min(n, lo + chunk)
        m, step = _gram_hashes(buf, lo, hi - lo + width), 1
        while step * 2 <= width:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < width:
            m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
        m = m[: hi - lo]
        valid = np.zeros(hi - lo, bool)
        a, b = np.searchsorted(row_start + row_len, lo, "right"), np.searchsorted(row_start, hi, "left")
        for s, e in zip(row_start[a:b].tolist(), last[a:b].tolist(), strict=True):
            if e >= s:
                valid[max(s - lo, 0) : max(e + 1 - lo, 0)] = True
        edge = np.empty(hi - lo + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (m[1:] != m[:-1]) | (valid[1:] != valid[:-1])
        at = np.flatnonzero(edge)
        first, end = at[:-1], at[1:]
        keep = valid[first]
        first, end = first[keep], end[keep]
        firsts.append(first + lo)
        lasts.append(end - 1 + lo)
        hashes.append(m[first])
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, last, h = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(hashes)
    pieces = (last - first) // LONGEST_RUN + 1
    if len(pieces) and pieces.max() > 1:  # periodic text
        which = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, last, h = first[which] + nth * LONGEST_RUN, last[which], h[which]
        last = np.minimum(last, first + LONGEST_RUN - 1)
    return first, last, h


class _Block:
    """The documents of one block in a fixed order, as one buffer."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("doc_id").to_pylist()
        texts = rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.order, self.ids = order, [ids[k] for k in order]
        self.order_id = np.array([NO_ID if x is None else x for x in self.ids], np.int64)
        texts = [texts[k] for k in order]
        self.len = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.len) - self.len
        self.buf = np.frombuffer(b"".join([*texts, b"\0" * 128]), np.uint8)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` (8 or more) bytes from each place of `a` on are those from `b` on."""
        word = _words(self.buf, 0, len(self.buf) - 7)
        out = np.ones(len(a), bool)
        for o in range(0, int(size.max(initial=0)), 8):
            at = np.minimum(o, size - 8)
            out &= word[a + at] == word[b + at]
        return out

    def classes(self, keys: list[np.ndarray], at: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each string (its place and size) that only equal ones share, and the first of least `doc` of each number.

        Numbers are in order of the first of `keys`, which may be any functions of a string: strings of equal keys are
        compared byte by byte.
        """
        order = np.lexsort((doc, size, *keys[::-1]))
        new = np.ones(len(order), bool)
        new[1:] = size[order][1:] != size[order][:-1]
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        copy = np.flatnonzero(~new)
        other = copy[~self.same(at[order[copy]], at[lead[copy]], size[order[copy]])]
        if len(other):  # equal keys, other bytes: such groups are put in order of their bytes
            group = np.cumsum(new) - 1
            mixed = np.flatnonzero(np.isin(group, group[other]))
            text = [self.buf[a : a + n].tobytes() for a, n in zip(at[order[mixed]].tolist(), size[order[mixed]].tolist(), strict=True)]
            again = sorted(range(len(mixed)), key=lambda k: (group[mixed[k]], text[k], doc[order[mixed[k]]]))
            order[mixed] = order[mixed][again]
            new[mixed] = [k == 0 or group[mixed[k]] != group[mixed[k - 1]] or text[again[k]] != text[again[k - 1]] for k in range(len(mixed))]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return number, order[new]

    def runs(self, window: int):
        """First and last window start, document and bucket hash of each run."""
        first, last, h = _runs(self.buf, self.start, self.len, window)
        return first, last, self.order_id[np.searchsorted(self.start, first, "right") - 1], h

    def contents(self, first: np.ndarray, last: np.ndarray, doc: np.ndarray, h: np.ndarray, window: int):
        """Number of the content of each run, the first run of each content, and the number of that one's bucket among `buckets`."""
        r = _window_hashes(self.buf, first, window) * _K[0] ^ _window_hashes(self.buf, last, window, 1)
        number, lead = self.classes([h, r], first, last - first + window, doc)
        bucket = np.cumsum(np.diff(h[lead], prepend=h[lead][:1]) != 0)
        return number, lead, bucket


def _route(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h * _K[0]) >> np.uint64(33)).astype(np.int64) % buckets


def _part(h: np.ndarray) -> np.ndarray:
    return ((h * _K[2]) >> np.uint64(56)).astype(np.uint8)


def _batches(rows: list[tuple]) -> pa.Table:
    block, dest, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"block": pa.array(block, pa.int32()), "dest": pa.array(dest, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _by_dest(dest: np.ndarray):
    order = np.argsort(dest, kind="stable")
    cuts = np.flatnonzero(np.diff(dest[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
        yield int(dest[order[a]]), order[a:b]


def _gather(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all strings, one after another."""
    return buf[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]


def _announce(buckets: int, window: int, hot_runs: int):
    """Of one block: its buckets, and which of them are hot."""

    def run(key, rows):
        block = _Block(rows)
        first, last, doc, h = block.runs(window)
        _, lead, bucket = block.contents(first, last, doc, h, window)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        hot = (np.diff(at, append=len(bucket)) > hot_runs).astype(np.uint8)
        h, out = h[lead][at], []
        for dest, at in _by_dest(_route(h, buckets)):
            out.append((key[0].as_py(), dest, pack(np.diff(h[at], prepend=np.uint64(0)), np.diff(at.astype(np.uint32), prepend=np.uint32(0)), hot[at])))
        return _batches(out)

    return run


def _judge(key, rows):
    """Of one set of buckets: which of each block's other blocks have too (1), and which of those are hot somewhere (2)."""
    blocks, parts = rows.column("block").to_pylist(), [unpack(x) for x in rows.column("blob").to_pylist()]
    if not parts:
        return _batches([])
    h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    idx = np.concatenate([np.cumsum(p[1], dtype=np.uint32) for p in parts])
    hot = np.concatenate([p[2] for p in parts])
    part = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(h, kind="stable")
    at = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    size = np.diff(at, append=len(h))
    flag = np.zeros(len(h), np.uint8)
    flag[order] = np.repeat(np.where(size > 1, 1 + np.maximum.reduceat(hot[order], at), 0), size)
    said = np.flatnonzero(flag)
    out = []
    for p, at in _by_dest(part[said]):
        at = said[at]
        out.append((blocks[p], 0, pack(np.diff(idx[at], prepend=np.uint32(0)), flag[at])))
    return _batches(out)


def _request(buckets: int, window: int, hot_runs: int):
    """Of one block: windows already decided, windows still open, and the bytes that decide them."""

    def run(key, rows, said):
        if not rows.num_rows:
            return _batches([])
        block = _Block(rows)
        first, last, doc, h = block.runs(window)
        number, lead, bucket = block.contents(first, last, doc, h, window)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        flag = np.zeros(len(at), np.uint8)
        for blob in said.column("blob").to_pylist():
            idx, f = unpack(blob)
            flag[np.cumsum(idx, dtype=np.uint32)] = f
        hot = (np.diff(at, append=len(bucket)) > hot_runs) | (flag == 2)
        held = np.minimum.reduceat(doc[lead], at) != np.maximum.reduceat(doc[lead], at) if len(at) else hot  # by several documents
        hot, flag, here = hot[bucket], flag[bucket], (held & ~hot & (flag == 0))[bucket]
        # copies inside the block, which were compared, go by the smallest id
        gone = ~hot[number] & (doc > doc[lead][number])
        from_, to = [first[gone]], [last[gone]]
        wait = ~gone & (~hot & (flag == 1) | here)[number]
        open_item, open_at = [number[wait]], [first[wait]]
        size = last[lead] - first[lead] + window
        send = np.flatnonzero(~hot & (flag == 1))
        items = [(send, doc[lead[send]], first[lead[send]], size[send], h[lead[send]])]
        out = []
        at = np.flatnonzero(here)
        if len(at):
            out.append(_lost(key[0].as_py(), at, *_decide(block.buf, first[lead[at]], size[at], doc[lead[at]], _part(h[lead[at]]), window)))
        at = np.flatnonzero(hot[number])
        if len(at):  # windows one by one
            n = last[at] - first[at] + 1
            which = np.repeat(at, n)
            at = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            own = _window_hashes(block.buf, at, window)
            cls, one = block.classes([own], at, np.full(len(at), window), doc[which])
            gone = doc[which] > doc[which[one]][cls]
            from_.append(at[gone])
            to.append(at[gone])
            send = (flag[number[which]] == 2)[one]  # equal windows are of one bucket
            wait = ~gone & send[cls]
            open_item.append(cls[wait] + len(lead))
            open_at.append(at[wait])
            one, cls = one[send], np.flatnonzero(send)
            items.append((cls + len(lead), doc[which[one]], at[one], np.full(len(one), window), own[one]))
        out.append((key[0].as_py(), key[0].as_py() % buckets, pack(np.uint8([0]), *(np.concatenate(x) for x in (from_, to, open_item, open_at)))))
        item, doc, first, size, name = (np.concatenate(x) for x in zip(*items, strict=True))
        part = _part(name)
        for dest, at in _by_dest(_route(name, buckets)):
            at = at[np.argsort(part[at], kind="stable")]
            out.append((key[0].as_py(), dest, pack(np.uint8([1]), item[at].astype(np.uint32), doc[at], size[at].astype(np.uint16), part[at], _gather(block.buf, first[at], size[at]))))
        return _batches(out)

    return run


def _lost(block: int, item: np.ndarray, which: np.ndarray, offset: np.ndarray) -> tuple:
    return block, 0, pack(np.uint8([2]), item[which].astype(np.uint32), offset.astype(np.uint16))


def _decide(buf: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, part: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the string and offset of each window in it that a string of smaller `doc` has too, by refinement.

    Equal windows must be in strings of one `part`; parts are refined in groups that fit a processor's cache.
    """
    order = np.argsort(part, kind="stable")
    upto = np.cumsum(size[order])
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    which, offset, a = [], [], 0
    while a < len(cuts):
        lo = cuts[a]
        b = max(a + 1, int(np.searchsorted(upto[np.append(cuts[1:], len(order)) - 1], (upto[lo - 1] if lo else 0) + PART_BYTES, "right")))
        at = order[lo : cuts[b] if b < len(cuts) else len(order)]
        n = size[at]
        pointer = bucket_pointers(_gather(buf, first[at], n), window, np.repeat(np.cumsum(n), n) - np.arange(n.sum()))
        windows = n - window + 1
        string = np.repeat(np.arange(len(n)), windows)
        inner = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
        cls = pointer[(np.cumsum(n) - n)[string] + inner]
        least = np.full(int(pointer.max()) + 1, NO_ID, np.int64)
        np.minimum.at(least, cls, doc[at][string])
        gone = np.flatnonzero(least[cls] < doc[at][string])
        which.append(at[string[gone]])
        offset.append(inner[gone])
        a = b
    return (np.concatenate(which), np.concatenate(offset)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _ranks(key: np.ndarray) -> np.ndarray:
    """Bucket ids in sorted order of the keys."""
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    return out


def bucket_pointers(buf: np.ndarray, depth: int, room: np.ndarray | None = None) -> np.ndarray:
    """Bucket id of the suffix at each position of `buf` (uint8), sorted `depth` (at least 8) bytes deep; zeros follow the end.

    The first buckets are those of 8-grams. A round sorts the members of buckets that still have several on the
    bucket id of the suffix `known` bytes later, so each round reuses what the last has refined. With `room`, the bytes
    left to each position's text, a suffix is only sorted as deep as it has room for; ids of those of less than `depth`
    then mean nothing.
    """
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(depth + 8, np.uint8)])
    pointer, known = _ranks(_words(padded, 0, n + depth).byteswap()), 8
    while known < depth:
        step = min(known, depth - known)
        size = np.bincount(pointer)
        several = size[pointer] > 1
        if room is not None:
            several[n:] = False
            several[:n] &= room >= known + step
        live = np.flatnonzero(several)
        later = np.minimum(live + step, len(pointer) - 1)
        refined = _ranks(pointer[live] * len(size) + pointer[later])
        # ids stay in sorted order: each bucket makes room for those that it falls into
        top = np.zeros(int(refined.max()) + 1 if len(live) else 0, np.int64)
        top[refined] = pointer[live]
        parts = np.maximum(np.bincount(top, minlength=len(size)), 1)
        base = np.cumsum(parts) - parts
        inner = np.arange(len(top)) - np.searchsorted(top, top, "left")
        out = base[pointer]
        out[live] += inner[refined]
        pointer, known = out, known + step
    return pointer[:n]


def _refine(window: int):
    """Of one set of buckets: the windows of each block that a document of smaller id has. What is decided passes through."""

    def run(key, rows):
        out, parts, owners = [], [], []
        for block, blob in zip(rows.column("block").to_pylist(), rows.column("blob").to_pylist(), strict=True):
            kind, *arrays = unpack(blob)
            if kind[0] == 1:
                parts.append(arrays)
                owners.append(block)
            else:
                out.append((block, 0, blob))
        if parts:
            item, doc, size, part, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
            size = size.astype(np.int64)
            which, offset = _decide(text, np.cumsum(size) - size, size, doc, part, window)
            for p, at in _by_dest(owner[which]):
                out.append(_lost(owners[p], item, which[at], offset[at]))
        return _batches(out)

    return run


def _cut(window: int, carried: int = 0):
    def run(key, rows, said):
        block = _Block(rows)
        n = int(block.len.sum())
        change = np.zeros(n + 1, np.int32)
        spans, lost, item, at = [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for blob in said.column("blob").to_pylist():
            kind, *arrays = unpack(blob)
            if kind[0] == 2:
                lost.append(arrays)
            else:
                spans.append(arrays[:2])
                item, at = arrays[2:]
        if lost:
            lost_item, offset = (np.concatenate(x) for x in zip(*lost, strict=True))
            order = np.argsort(item, kind="stable")
            lo, hi = np.searchsorted(item[order], lost_item, "left"), np.searchsorted(item[order], lost_item, "right")
            count = hi - lo
            which = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            places = at[order[which]] + np.repeat(offset, count)
            spans.append([places, places])
        for first, last in spans:
            np.add.at(change, first, 1)
            np.add.at(change, last + window, -1)
        gone = np.cumsum(change)[:n] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[block.start + block.len] - total[block.start]
        edge = np.zeros(n + 1, np.int8)
        edge[:n] = gone
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = block.start[block.len > 0]
        opens[inner] = gone[inner]
        closes = gone.copy()
        closes[:-1] &= ~gone[1:]
        ends = (block.start + block.len - 1)[block.len > 0]
        closes[ends] = gone[ends]
        first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        owner = np.searchsorted(block.start + block.len, first, "right")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(block.ids)))]).astype(np.int32)
        base = block.start[owner]
        pairs = pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["start", "end"])
        kept = block.buf[:n][~gone]
        bounds = np.concatenate([[0], np.cumsum(block.len - removed)]).astype(np.int32)
        return pa.table({
            "doc_id": pa.array(block.ids, pa.int64()),
            "n_bytes": pa.array(block.len),
            "n_removed": pa.array(removed.astype(np.int64)),
            "spans": pa.ListArray.from_arrays(pa.array(offsets), pairs),
            "kept": pa.Array.from_buffers(pa.binary(), len(block.ids), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]),
            **{f"_c{k}": rows.column(f"_c{k}").take(pa.array(block.order, pa.int64())) for k in range(carried)},
        })

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, block_bytes: int = BLOCK_BYTES, carry: tuple[str, ...] = (), hot_runs: int = HOT_RUNS) -> DataFrame:
    """Texts without the bytes that a `window`-byte string also starting in a document with a smaller id covers.

    Returns one row for each row of `docs`: doc_id long, n_bytes long, n_removed long, spans array of (start, end) byte
    offsets that went, kept binary, then the columns `carry` of `docs` as _c0, _c1 and so on. Null texts count as empty. A
    null id counts as larger than any other; rows of equal id remove nothing from each other, so repeated rows come out
    alike. Texts below `window` bytes stay whole. An empty table gives an empty result. No other column is read. `window` is
    40 to 200. Rows are dealt to blocks by id and text, so different texts of a null or repeated id spread.
    """
    if not 40 <= window <= 200:
        raise ValueError("window must be 40 to 200")
    blocks = text_blocks(id_and_text(docs, id_col, text_col), block_bytes)
    buckets = max(blocks // 2, shuffle_partitions(docs.sparkSession))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text")
    more = [F.col(f"`{c}`").alias(f"_c{k}") for k, c in enumerate(carry)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text, *more)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name.startswith("_c"))
    rows = rows.select("*", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block")).groupBy("block")
    judged = rows.applyInArrow(_announce(buckets, window, hot_runs), _MESSAGES).groupBy("dest").applyInArrow(_judge, _MESSAGES)
    asked = rows.cogroup(judged.groupBy("block")).applyInArrow(_request(buckets, window, hot_runs), _MESSAGES)
    spans = asked.groupBy("dest").applyInArrow(_refine(window), _MESSAGES)
    return rows.cogroup(spans.groupBy("block")).applyInArrow(
        _cut(window, len(carry)), "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary" + kinds
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """The rows of `docs`, all columns, with repeated passages cut from their texts.

    A character of which a cut left only some bytes goes with it. A text of which only white space is left goes as a whole;
    n_chars, where there is such a column, counts what is left.
    """
    out = remove_repeats(docs, id_col, text_col, window, carry=tuple(docs.columns))
    kept = F.col("kept").cast("string")
    kept = F.when(F.is_valid_utf8(kept), kept).otherwise(F.translate(F.make_valid_utf8(kept), "\ufffd", ""))
    out = out.withColumn("kept", kept).where((F.col("n_removed") == 0) | (F.trim("kept") != ""))
    at = {c: F.col(f"_c{k}") for k, c in enumerate(docs.columns)}
    at[text_col] = F.when(F.col("n_removed") == 0, at[text_col]).otherwise(F.col("kept"))
    if "n_chars" in at:
        at["n_chars"] = F.when(F.col("n_removed") == 0, at["n_chars"]).otherwise(F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return out.select(*[v.alias(c) for c, v in at.items()])


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of all texts without 50-byte strings that a document of smaller id has; null texts are empty."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
