"""A small network for text labels, trained by mini-batches on all tasks at once.

Rows are dealt to a fixed number of shards by a hash. Tasks of one barrier stage hold shards. From common weights each shard
takes a few steps on batches of its own; then all tasks gather the weights of all shards and go on from their mean, taken in
the order of shards, so that the weights don't depend on how many tasks there are. Gathering takes about a second
whatever is sent, which is why it isn't done for every batch.
"""

from __future__ import annotations

import base64
import math
import pickle
import re
import tempfile
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import metrics, predictions

WORD = re.compile(r"\w+")


@dataclass
class Network:
    """The words of most training rows, one hidden layer, one output."""

    features: int = 1 << 12
    hidden: int = 16
    words: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)

    def start(self, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        self.weights = [rng.normal(0, 1 / math.sqrt(self.hidden), (self.features, self.hidden)), np.zeros(self.hidden), rng.normal(0, 1 / math.sqrt(self.hidden), self.hidden), np.zeros(1)]
        return self

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of a text's known words."""
        return np.unique(np.array([self.words[w] for w in WORD.findall((text or "").lower()) if w in self.words], np.int64), return_counts=True)

    def sparse(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a text's known words: 1 + ln of their counts, of length 1 in all."""
        return self.scaled(*self.counted(text))

    @staticmethod
    def scaled(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = 1 + np.log(n)
        return at, x / max(1e-9, math.sqrt((x**2).sum()))

    def dense(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x = np.zeros((len(rows), self.features))
        for k, (at, v) in enumerate(rows):
            x[k, at] = v
        return x

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b, v, c = self.weights
        h = np.maximum(np.einsum("ij,jk->ik", x, w, optimize=False) + b if len(x) < 2 else x @ w + b, 0)
        return h, 1 / (1 + np.exp(-np.clip(h @ v + c[0], -30, 30)))

    def gradient(self, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
        """Of the sum of weighted logistic losses."""
        h, p = self.forward(x)
        d = (p - y) * share
        back = np.outer(d, self.weights[2]) * (h > 0)
        return [x.T @ back, back.sum(0), h.T @ d, np.array([d.sum()])]


@dataclass
class Schedule:
    """AdamW whose rate grows over the first steps and falls to nothing by the last."""

    rate: float = 0.01
    decay: float = 0.01
    warmup: float = 0.1
    steps: int = 1

    def at(self, step: int) -> float:
        rise = max(1, int(self.warmup * self.steps))
        return self.rate * min((step + 1) / rise, max(0.0, (self.steps - step) / max(1, self.steps - rise)))

    def step(self, network: Network, grads: list[np.ndarray], moments: list[list[np.ndarray]], step: int) -> None:
        for k, (w, g) in enumerate(zip(network.weights, grads, strict=True)):
            m, s = moments[0][k], moments[1][k]
            m[...] = 0.9 * m + 0.1 * g
            s[...] = 0.999 * s + 0.001 * g**2
            w -= self.at(step) * ((m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.999 ** (step + 1))) + 1e-8) + self.decay * w * (w.ndim > 1))


class Stored:
    """Sparse rows and labels in a file of the task, read back by their places; memory has a row's start and label, twelve bytes a row.

    Slots and counts take six bytes a word; values are made of counts when rows are read.
    """

    KIND = np.dtype([("slot", np.int32), ("n", np.uint16)])

    def __init__(self):
        self.file, self.starts, self.labels = tempfile.TemporaryFile(), array("q", [0]), array("i")

    def __len__(self) -> int:
        return len(self.labels)

    def add(self, at: np.ndarray, n: np.ndarray, label: int) -> None:
        # a count beyond two bytes is several entries of one slot
        parts = -(-n // 65535)
        row = np.zeros(int(parts.sum()), self.KIND)
        row["slot"], left = np.repeat(at, parts), np.repeat(n, parts) - 65535 * (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts))
        row["n"] = np.minimum(left, 65535)
        self.file.write(row.tobytes())
        self.starts.append(self.starts[-1] + len(row))
        self.labels.append(label)

    def __getitem__(self, some: slice) -> list[tuple[tuple[np.ndarray, np.ndarray], int]]:
        lo, hi, _ = some.indices(len(self))
        if lo >= hi:
            return []
        first = self.starts[lo]
        self.file.seek(first * self.KIND.itemsize)
        rows = np.frombuffer(self.file.read((self.starts[hi] - first) * self.KIND.itemsize), self.KIND)
        out = []
        for k in range(lo, hi):
            row = rows[self.starts[k] - first : self.starts[k + 1] - first]
            at, one = np.unique(row["slot"], return_inverse=True)
            out.append((Network.scaled(at.astype(np.int64), np.bincount(one, row["n"], len(at)).astype(np.int64)), self.labels[k]))
        return out


def _sent(x: object) -> str:
    return base64.b64encode(zlib.compress(pickle.dumps(x), 1)).decode()


def _gathered(context: BarrierTaskContext, own: dict) -> list:
    """What all tasks have of each shard, in the order of shards."""
    every: dict = {}
    for message in context.allGather(_sent(own)):
        every |= pickle.loads(zlib.decompress(base64.b64decode(message)))  # noqa: S301  from our own tasks
    return [every[k] for k in sorted(every)]


def _most_common(rows: DataFrame, most: int, least: int) -> dict[str, int]:
    """Places of the words of most rows."""

    def distinct(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for t in b.column("text").to_pylist() for w in set(WORD.findall(t.lower()))], pa.string())], ["word"])

    counts = rows.select("text").mapInArrow(distinct, "word string").groupBy("word").count().where(F.col("count") >= least)
    return {r["word"]: k for k, r in enumerate(counts.orderBy(F.col("count").desc(), "word").limit(most).collect())}


def train_network(df: DataFrame, text: str = "text", label: str = "label", split: str = "split", network: Network | None = None, epochs: int = 8, batch: int = 16, local: int = 64, shards: int = 8, tasks: int = 4, rate: float = 0.03, least: int = 5, seed: int = 42) -> tuple[Network, DataFrame]:
    """The network of the epoch with the best F1 on rows of split `val`, the earlier of equals, and (epoch, loss, f1) of all epochs.

    Its words are those of most rows of split `train`, of `least` at least, ties by the word. Learns from those rows; null labels are left out, null texts are empty, classes weigh the same in all. A shard
    takes up to `local` steps of `batch` rows, in the order of a hash, before weights are gathered. Tasks hold their shards' words
    in files of their own and must all run at once; what they exchange has the size of the weights.
    """
    start = (network or Network()).start(seed)
    rows = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(label).cast("int").alias("label"), F.col(split).alias("split")).where(F.col(label).isNotNull() & F.col(split).isin("train", "val"))
    order = F.xxhash64("text", "label", "split")
    rows = rows.select("*", F.pmod(order, F.lit(shards)).cast("int").alias("shard"), F.xxhash64(order, F.lit(seed)).alias("rank"))
    counts = {(r["split"], r["label"]): r["n"] for r in rows.groupBy("split", "label").agg(F.count("*").alias("n")).collect()}
    learn = {k: n for (s, k), n in counts.items() if s == "train"}
    if not learn:
        raise ValueError("no labelled rows to train on")
    start.words = _most_common(rows.where("split = 'train'"), start.features, least)
    largest = rows.where("split = 'train'").groupBy("shard").count().agg(F.max("count")).first()[0]
    per_epoch = -(-largest // batch)
    schedule = Schedule(rate, steps=per_epoch * epochs)
    weight = {k: sum(learn.values()) / (len(learn) * n) for k, n in learn.items()}

    def run(batches: Iterator[pa.RecordBatch]):
        context, model = BarrierTaskContext.get(), pickle.loads(pickle.dumps(start))  # noqa: S301
        held: dict[int, dict[str, Stored]] = {}
        for b in batches:
            for t, y, s, k in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), b.column("split").to_pylist(), b.column("shard").to_pylist(), strict=True):
                held.setdefault(k, {"train": Stored(), "val": Stored()})[s].add(*model.counted(t), y)
        moments = {k: [[np.zeros_like(w) for w in model.weights] for _ in range(2)] for k in held}
        best, log = (-1.0, 0, None), []
        for epoch in range(epochs):
            losses = 0.0
            for first in range(0, per_epoch, local):
                own = {}
                for k, both in held.items():
                    mine, loss, seen = Network(model.features, model.hidden, model.words, [w.copy() for w in model.weights]), 0.0, 0
                    for step in range(first, min(first + local, per_epoch)):
                        some = both["train"][step * batch : (step + 1) * batch]
                        if some:
                            x, y = mine.dense([r for r, _ in some]), np.array([y for _, y in some], float)
                            share = np.array([weight[int(v)] for v in y])
                            p = np.clip(mine.forward(x)[1], 1e-9, 1 - 1e-9)
                            loss, seen = loss - float((share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()), seen + len(some)
                            schedule.step(mine, [g / len(some) for g in mine.gradient(x, y, share)], moments[k], epoch * per_epoch + step)
                    if seen:
                        own[k] = ([w - v for w, v in zip(mine.weights, model.weights, strict=True)], loss, seen)
                parts = _gathered(context, own)
                whole = max(1, sum(n for *_, n in parts))
                for moved, loss, n in parts:
                    losses += loss
                    for w, d in zip(model.weights, moved, strict=True):
                        w += d * (n / whole)
            own = {}
            for k, both in held.items():
                hits = np.zeros(3, np.int64)
                for lo in range(0, len(both["val"]), 256):
                    some = both["val"][lo : lo + 256]
                    said, y = model.forward(model.dense([r for r, _ in some]))[1] >= 0.5, np.array([y for _, y in some]) == 1
                    hits += [int((said & y).sum()), int((said & ~y).sum()), int((~said & y).sum())]
                own[k] = hits
            tp, fp, fn = sum(_gathered(context, own), np.zeros(3, np.int64)).tolist()
            f1 = 2 * tp / max(1, 2 * tp + fp + fn)
            log.append((epoch, losses / max(1, sum(learn.values())), f1))
            if f1 > best[0]:
                best = (f1, epoch, pickle.dumps(model))
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([best[2]], pa.binary()), pa.array([pickle.dumps(log)], pa.binary())], ["model", "log"])

    dealt = rows.repartition(tasks, "shard").sortWithinPartitions("shard", "rank", "text", "label")
    (found,) = dealt.mapInArrow(run, "model binary, log binary", barrier=True).collect()
    log = df.sparkSession.createDataFrame(pickle.loads(found["log"]), "epoch int, loss double, f1 double")  # noqa: S301  from our own task
    return pickle.loads(found["model"]), log  # noqa: S301


def network_predictions(df: DataFrame, network: Network, text: str = "text", threshold: float = 0.5, name: str = "") -> DataFrame:
    """`df` with pred_label, pred_label_text, pred_prob_1, pred_prob_0, pred_confidence and model_dir."""
    sent, columns = df.sparkSession.sparkContext.broadcast(network), list(df.columns)
    rows = df.withColumn("_network_text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    from pyspark.sql.types import DoubleType, StructType

    def run(batches: Iterator[pa.RecordBatch]):
        model = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                p = model.forward(model.dense([model.sparse(t) for t in part.column("_network_text").to_pylist()]))[1]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(p)], [*columns, "_p"])

    return predictions(rows.mapInArrow(run, StructType([*df.schema]).add("_p", DoubleType())), "_p", threshold, name).drop("_p")


def train_dual(df: DataFrame, labels: Sequence[str], text: str = "text", split: str = "split", **how) -> tuple[dict[str, Network], DataFrame]:
    """A network for each of several labels of the same rows, each on the rows that have it, and the metrics of all splits by label."""
    found, tables = {}, []
    for label in labels:
        found[label], _ = train_network(df, text, label, split, **how)
        rows = df.where(F.col(label).isNotNull()).withColumn("gold_label", F.col(label).cast("int"))
        tables.append(metrics(network_predictions(rows, found[label], text), [split]).withColumn("label_name", F.lit(label)))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return found, out
