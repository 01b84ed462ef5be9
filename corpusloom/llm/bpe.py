"""Byte-level BPE encoding and decoding with a pair occurrence index.

A partition's distinct pieces are merged together: the index maps each adjacent pair to all its positions in the
partition, the ranks that occur are applied in ascending order, and each merge updates the lists of the pairs beside it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Fixed value: how byte-level tokenizers split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text handled at a time, and distinct pieces remembered, in each task.
SLICE_CHARS, MOST_PIECES = 2_000_000, 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class PairIndexBPE:
    """A byte-level BPE tokenizer read from the JSON of a `tokenizers` file."""

    def __init__(self, spec: str | bytes):
        spec = json.loads(spec)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"] or not pre["use_regex"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files can be read")
        vocab, letters = model["vocab"], byte_letters()
        self.start = np.array([vocab[x] for x in letters], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.left, self.right, self.span = left, right, max(vocab.values()) + 1
        keys = left * self.span + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        byte = {x: k for k, x in enumerate(letters)}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for text, k in vocab.items():
            self.bytes[k] = bytes(byte[x] for x in text)
        self.added = {}
        for t in spec["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]:
                raise ValueError("added tokens must be plain")
            self.added[t["content"]] = t["id"]
            self.bytes[t["id"]] = t["content"].encode()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.forget()

    def forget(self) -> None:
        """Empties what is remembered of pieces seen before; added tokens stay known."""
        self.index = {text: k for k, text in enumerate(self.added)}
        self.ids = np.array([*self.added.values()], np.int64)
        self.counts = np.ones(len(self.added), np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, one after another, and how many each piece has."""
        length = np.array([len(p) for p in pieces], np.int64)
        symbol = self.start[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbol)
        end = np.cumsum(length)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = length > 0
        after[end[full] - 1] = -1
        before[(end - length)[full]] = -1
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Adds positions to the lists of the pairs that start there."""
            at = at[(at >= 0)]
            at = at[after[at] >= 0]
            r = self.rank(symbol[at], symbol[after[at]])
            at, r = at[r >= 0], r[r >= 0]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(r)], strict=False):
                k = int(r[a])
                if k not in lists:
                    lists[k] = []
                    heapq.heappush(active, k)
                lists[k].append(at[a:b])

        note(np.arange(n))
        while active:
            k = heapq.heappop(active)
            at = np.unique(np.concatenate(lists.pop(k)))
            a, b = self.left[k], self.right[k]
            at = at[(symbol[at] == a) & (after[at] >= 0)]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # aaa: from the left, each symbol in one merge only
                chained = np.zeros(len(at), bool)
                chained[1:] = after[at[:-1]] == at[1:]
                first = np.flatnonzero(~chained)
                at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at] = self.merged[k]
            symbol[gone] = -1
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            note(np.concatenate([before[at], at]))
        alive = symbol >= 0
        total = np.concatenate([[0], np.cumsum(alive)])
        return symbol[alive], total[end] - total[end - length]

    def pieces(self, text: str) -> Iterator[str]:
        """What the merges never cross, in order; added tokens stay whole."""
        if self.cut is None or not self.cut.search(text):
            return (m.group() for m in self.split.finditer(text)) if len(text) > SLICE_CHARS else iter(self.split.findall(text))
        return (p for part in self.cut.split(text) if part for p in ((part,) if part in self.added else self.split.findall(part)))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        out, waiting, sizes, held = [], [], [], 0
        for text in texts:
            if len(text) > SLICE_CHARS:  # in slices, so that a very long text needs no list of all its pieces
                out += self._flush(waiting, sizes)
                waiting, sizes, held, parts, it = [], [], 0, [], self.pieces(text)
                while some := list(islice(it, SLICE_CHARS // 4)):
                    parts += self._flush(some, [len(some)])
                out.append(np.concatenate(parts))
                continue
            own = list(self.pieces(text))
            waiting += own
            sizes.append(len(own))
            held += len(text)
            if held > SLICE_CHARS:
                out += self._flush(waiting, sizes)
                waiting, sizes, held = [], [], 0
        return out + self._flush(waiting, sizes)

    def _flush(self, pieces: list[str], sizes: list[int]) -> list[np.ndarray]:
        """Ids of documents that have `sizes` of `pieces` each."""
        if not sizes:
            return []
        if len(self.index) > MOST_PIECES:
            self.forget()
        new = list(set(pieces) - self.index.keys())
        if new:
            ids, counts = self.merge([p.encode() for p in new])
            for k, p in enumerate(new, len(self.index)):
                self.index[p] = k
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        starts = np.cumsum(self.counts) - self.counts
        which = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        count = self.counts[which]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(starts[which] - ends + count, count) + np.arange(count.sum())]
        total = np.concatenate([[0], ends])[np.cumsum([0, *sizes])]
        return [ids[a:b].astype(np.int32) for a, b in zip(total[:-1], total[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _spec(docs: DataFrame, path: str):
    """The tokenizer file on every executor; its vocabulary bounds what is broadcast."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def _id_lists(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, lists)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Token ids of whole texts: doc_id long, ids array<int>, and with `decoded` the text that the ids decode to.

    One row for each row of `docs`, repeated rows and null ids included; null texts count as empty and have no ids. Added
    tokens in a text become their ids. Other columns are not read. An empty table gives an empty result.
    """
    spec = _spec(docs, tokenizer_path)

    def run(batches):
        bpe = PairIndexBPE(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lists = bpe.encode_batch(part.column("text").to_pylist())
                columns = [part.column("doc_id"), _id_lists(lists)]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token ids: doc_id long, text string. Null lists give empty texts; ids outside the vocabulary are an error."""
    spec = _spec(rows, tokenizer_path)

    def run(batches):
        bpe = PairIndexBPE(spec.value)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of all texts as the library encodes them, and what they decode to, as hashes; null texts are empty."""
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
