"""Quality scores of whole texts by a small byte-level convolutional network in numpy.

A text is read as chunks of CHUNK bytes that overlap by OVERLAP. Each learned filter looks at WIDTH bytes at every
second byte; its largest response in a chunk is kept, and a document has the largest and the mean of those over all its
chunks. No filter that is linear in the bytes sees that a word repeats, so one more is bilinear: each byte has a learned
vector, and the filter's response to a piece is the mean product of its vectors with those some lag before, at the lag and
in the piece where it is largest. It is pooled the same way. One logistic unit combines all into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, id_and_text, labelled_sample, table, unused, with_text_results

CHUNK, OVERLAP, WIDTH, FILTERS = 512, 32, 8, 16
#: Of the bilinear filter: places to look back, bytes of a piece, and entries of a byte's vector.
LAGS, PIECE, DEPTH = range(2, 33), 32, 8
STEP = CHUNK - OVERLAP
#: Chunks whose responses are in memory at a time.
BATCH = 256


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded chunks of all texts and the number of the text each belongs to; an empty text has one empty chunk."""
    sizes = np.array([max(1, -(-(len(t) - OVERLAP) // STEP)) for t in texts], np.int64)
    out = np.zeros((int(sizes.sum()), CHUNK), np.uint8)
    k = 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
        padded[: len(t)] = np.frombuffer(t, np.uint8)
        out[k : k + n] = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]
        k += n
    return out, np.repeat(np.arange(len(texts)), sizes)


class ByteConvNet:
    """Filters (WIDTH, 256, FILTERS) and their bias, byte vectors (256, DEPTH) with a gain and a bias, weights of the pooled values and a bias.

    The vector of byte 0, which pads chunks, is zero.
    """

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.vectors = rng.normal(0, DEPTH**-0.5, (256, DEPTH)).astype(np.float32)
        self.vectors[0] = 0
        self.gain = np.array([4, -1.2], np.float32)
        self.weights = np.zeros(2 * (FILTERS + 1), np.float32)
        self.offset = np.float32(0)
        self.tables = None

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and where."""
        if self.tables is None:  # two bytes at a time
            self.tables = [(self.filters[k][None, :, :] + self.filters[k + 1][:, None, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]
        codes = chunks.view("<u2")
        n = codes.shape[1] - len(self.tables) + 1
        total = self.tables[0][codes[:, :n]]
        for k, t in enumerate(self.tables[1:], 1):
            total += t[codes[:, k : k + n]]
        at = total.argmax(axis=1)
        top = np.take_along_axis(total, at[:, None, :], 1)[:, 0]
        return np.maximum(top + self.bias, 0), at

    def echoes(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of the bilinear filter in each chunk, at every second byte, before gain and bias, and its lag and piece."""
        product, most = (self.vectors @ self.vectors.T).reshape(-1), max(LAGS)
        high = chunks[:, ::2].astype(np.uint16) << np.uint16(8)
        before = np.concatenate([np.zeros((len(chunks), most), np.uint8), chunks], axis=1)
        best, lags, pieces = np.full(len(chunks), -np.inf, np.float32), np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        for lag in LAGS:
            total = product[high | before[:, most - lag : most - lag + CHUNK : 2]].reshape(len(chunks), -1, PIECE // 2).sum(axis=2)
            at = total.argmax(axis=1)
            top = total[np.arange(len(total)), at]
            better = top > best
            best[better], lags[better], pieces[better] = top[better], lag, at[better]
        return best / (PIECE // 2), lags, pieces

    def pooled(self, chunks: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """Values of each document that the logistic unit sees; and for learning, of each chunk the responses, places, and what `echoes` gives."""
        parts = [(*self.responses(chunks[k : k + BATCH]), *self.echoes(chunks[k : k + BATCH])) for k in range(0, len(chunks), BATCH)]
        value, at, *echo = (np.concatenate(x) for x in zip(*parts, strict=True))
        value = np.concatenate([value, np.maximum(echo[0] * self.gain[0] + self.gain[1], 0)[:, None]], axis=1)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        count = np.diff(first, append=len(owner)).astype(np.float32)[:, None]
        return np.concatenate([np.maximum.reduceat(value, first), np.add.reduceat(value, first) / count], axis=1), value, at, *echo

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = self.pooled(*chunks_of(texts))[0]
        # row by row, so that a text's score doesn't depend on the texts beside it, as it may in a matrix product
        raw = (x.astype(np.float64) * self.weights).sum(axis=1) + self.offset
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[int], epochs: int = 9, batch: int = 32, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
        """Adam on the log loss. With one class only, every score is its share: 0.5 with no rows at all."""
        net, y = cls(seed), np.array(labels, np.float32)
        if len(set(labels)) < 2:
            net.offset = np.float32(30 * (2 * y.mean() - 1) if len(y) else 0)
            return net
        rng = np.random.default_rng(seed)
        net.weights[:] = rng.normal(0, 0.1, len(net.weights))
        params = {"filters": net.filters, "bias": net.bias, "vectors": net.vectors, "gain": net.gain, "weights": net.weights}
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
        off1 = off2 = t = 0
        # few rows are shown more often
        for _ in range(max(epochs, -(-400 * batch // len(texts)) if len(texts) < 400 * batch // epochs else 0)):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                chunks, owner = chunks_of([texts[k] for k in pick])
                net.tables = None
                x, value, at, echo, lag, piece = net.pooled(chunks, owner)
                p = 1 / (1 + np.exp(-np.clip(x @ net.weights + net.offset, -30, 30)))
                d = (p - y[pick]) / len(pick)
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                count = np.diff(first, append=len(owner))
                peak = np.maximum.reduceat(value, first)[owner] == value
                g = d[owner, None] * (peak * net.weights[None, : FILTERS + 1] + net.weights[None, FILTERS + 1 :] / count[owner, None])
                g = np.where(value > 0, g, 0).astype(np.float32)
                g, e = g[:, :FILTERS], g[:, FILTERS]
                grads = {"filters": 1e-5 * net.filters, "bias": g.sum(axis=0), "vectors": 1e-5 * net.vectors, "gain": np.array([(e * echo).sum(), e.sum()]), "weights": x.T @ d + 1e-4 * net.weights}
                row, f = np.nonzero(g)
                for k in range(WIDTH):
                    byte = chunks[row, 2 * at[row, f] + k]
                    np.add.at(grads["filters"][k], (byte, f), g[row, f])
                row = np.flatnonzero(e)
                here = piece[row, None] * PIECE + np.arange(0, PIECE, 2)
                before = here - lag[row, None]
                share = (e[row, None] * net.gain[0] / (PIECE // 2) * (before >= 0))[..., None]
                one, other = chunks[row[:, None], here], chunks[row[:, None], np.maximum(before, 0)]
                np.add.at(grads["vectors"], one, share * net.vectors[other])
                np.add.at(grads["vectors"], other, share * net.vectors[one])
                grads["vectors"][0] = 0
                t += 1
                for k, v in params.items():
                    a, b = moment[k]
                    a += 0.1 * (grads[k] - a)
                    b += 0.001 * (grads[k] ** 2 - b)
                    v -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
                off1 += 0.1 * (d.sum() - off1)
                off2 += 0.001 * (d.sum() ** 2 - off2)
                net.offset = np.float32(net.offset - rate * (off1 / (1 - 0.9**t)) / (np.sqrt(off2 / (1 - 0.999**t)) + 1e-8))
        net.tables = None
        return net


def fit_quality(docs: DataFrame, labels: DataFrame, per_label: int = 1200, max_bytes: int = 16 << 20) -> ByteConvNet:
    """The network learned from labelled rows whose crc32(doc_id) mod 5 is not 0.

    The sample has at most 1.25 * `per_label` rows of each label, those with the lowest id hashes, and whole texts of
    `max_bytes` in all. Rows without a label, an id or a text teach nothing; a label other than 1 counts as 0.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("label")).dropna()
    marks = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = [(r["doc_id"], r["label"]) for r in labelled_sample(marks, "doc_id", "label", per_label)]
    small = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")  # bounded by per_label
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    rows = bounded_texts(texts.join(F.broadcast(small), "doc_id").select("doc_id", "text", "label"), max_bytes)
    return ByteConvNet.fit([bytes(r["text"]) for r in rows], [r["label"] for r in rows])


def quality_scores(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, score double (0 to 1, higher: better), one row for each row of `docs`.

    The score depends on the text alone, so repeated rows get the same. Null and empty texts are scored as an empty chunk.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of parameters

    def run(batches):
        net = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                score = net.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return id_and_text(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, score double")


def good_documents(docs: DataFrame, net: ByteConvNet, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores `threshold` or more."""
    model, score = docs.sparkSession.sparkContext.broadcast(net), unused(docs, "score")
    out = with_text_results(docs, text_col, {score: "double"}, lambda: lambda texts: [pa.array(model.value.scores(texts), pa.float64())])
    return out.where(F.col(score) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all texts, learned from labelled rows that aren't held out; null and empty texts have a score too."""
    docs = table(spark, sf_dir, "documents")
    out = quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
