"""Language of whole texts by error-correcting output codes over character n-grams.

Each language has a codeword of bits; one linear classifier on hashed n-gram shares predicts each bit. Decoding adds up
the logistic losses of the bits against each codeword, weighted by how well each bit did on rows kept back while
learning, and takes the nearest; two codewords nearly as near flag the text as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_texts, id_and_text, labelled_sample, table, unused, with_text_results

SLOTS = 1 << 12
#: Characters counted at a time. The last two bytes of a part go before the next one, so counts of parts add up to those of the whole text.
PART = 1 << 20
LETTER = regex.compile(r"\p{L}")
# letters below 128 and all bytes above stay, others become spaces
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
UNKNOWN = "und"


def shares(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte 2- and 3-grams, letters only and in lower case."""
    total, low, rest = np.zeros(SLOTS), text.lower(), b" "
    for k in range(0, max(1, len(low)), PART):
        end = b"" if k + PART < len(low) else b"  "
        piece = rest + low[k : k + PART].encode("utf-8", "replace").translate(LETTERS) + end
        b, rest = np.frombuffer(piece, np.uint8).astype(np.uint32), piece[-2:]
        two = b[:-1] | (b[1:] << np.uint32(8))
        three = two[:-1] | (b[2:] << np.uint32(16))
        keep = ((b[:-1] != 32) | (b[1:] != 32))[:-1]
        for codes, salt in ((two[:-1][keep], 0), (three[keep], 1)):
            slot = ((codes + np.uint32(salt << 24)) * np.uint32(2654435761)) >> np.uint32(32 - 12)
            total += np.bincount(slot, minlength=SLOTS)
    n = total.sum()
    return np.sqrt(total / n).astype(np.float32) if n else total.astype(np.float32)


def codewords(classes: int, seed: int = 3) -> np.ndarray:
    """+1/-1 codewords (classes, bits): all distinct splits where at most 63, else random ones, far apart in every row and column."""
    if classes <= 1:
        return np.ones((classes, 1), np.float32)
    if classes <= 6:
        rows = [[1 if (split >> k) & 1 else -1 for split in range(1, 2 ** (classes - 1))] for k in range(classes - 1)]
        return np.array([*rows, [-1] * (2 ** (classes - 1) - 1)], np.float32)
    bits, best, found = int(np.ceil(10 * np.log2(classes))), -1, None
    rng = np.random.default_rng(seed)
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        gap = (code[:, None] != code[None]).sum(axis=2) + bits * np.eye(classes)
        if gap.min() > best and (np.abs(code.sum(axis=0)) < classes).all():
            best, found = gap.min(), code
    return found.astype(np.float32)


class CodedLanguages:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    @classmethod
    def fit(cls, texts: list[str], languages: list[str], rounds: int = 150, rate: float = 0.3, seed: int = 5) -> CodedLanguages:
        names = sorted(set(languages))
        code = codewords(len(names))
        bits = code.shape[1] if names else 1
        weights, bias, trust = np.zeros((SLOTS, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32)
        if len(names) < 2:
            return cls(names, code, weights, bias + 1, trust)
        x = np.stack([shares(t) for t in texts])
        label = np.array([names.index(n) for n in languages])
        y = code[label]
        back = np.random.default_rng(seed).random(len(x)) < 0.15
        balance = (1 / np.bincount(label, minlength=len(names)))[label].astype(np.float32)

        def learn(use: np.ndarray):
            w, c = np.zeros_like(weights), np.zeros_like(bias)
            mw, vw, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros_like(c), np.zeros_like(c)
            xs, ys = x[use], y[use]
            share = (balance[use] / balance[use].sum())[:, None]
            for t in range(1, rounds + 1):
                g = -ys * share / (1 + np.exp(np.clip(ys * (xs @ w + c), -30, 30)))
                gw, gc = xs.T @ g + 1e-5 * w, g.sum(axis=0)
                mw, vw, mc, vc = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mc + 0.1 * gc, 0.99 * vc + 0.01 * gc**2
                a, b = 1 - 0.9**t, 1 - 0.99**t
                w -= rate * (mw / a) / (np.sqrt(vw / b) + 1e-7)
                c -= rate * (mc / a) / (np.sqrt(vc / b) + 1e-7)
            return w, c

        if 0 < back.sum() < len(x):
            w, c = learn(~back)
            wrong = ((x[back] @ w + c) * y[back] <= 0).mean(axis=0)
            odds = np.clip(wrong, 0.01, 0.49)
            trust = (np.log((1 - odds) / odds) / np.log(99)).astype(np.float32)
        weights, bias = learn(np.ones(len(x), bool))
        return cls(names, code, weights, bias, trust)

    def distances(self, x: np.ndarray) -> np.ndarray:
        # einsum, not a matrix product, whose rounding may depend on the texts beside a text
        f = np.clip(np.einsum("ij,jk->ik", x, self.weights) + self.bias, -30, 30)
        loss = np.logaddexp(0, -f[:, None, :] * self.code[None])
        return (loss * self.trust).sum(axis=2) / self.trust.sum()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, score (0 to 1) and whether it is ambiguous, of each text."""
        out = [(UNKNOWN, 0.0, False)] * len(texts)
        known = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        if known:
            d = self.distances(np.stack([shares(texts[k]) for k in known])).astype(np.float64)
            bits = self.code.shape[1]
            p = np.exp(-bits * (d - d.min(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            for k, row in zip(known, p, strict=True):
                best = int(row.argmax())
                second = float(np.partition(row, -2)[-2]) if len(row) > 1 else 0.0
                out[k] = (self.languages[best], float(row[best]), second > 0.5 * float(row[best]))
        return out


def fit_languages(docs: DataFrame, per_language: int = 400, max_bytes: int = 8 << 20, max_rows: int = 6000) -> CodedLanguages:
    """Learned from text and lang of rows whose crc32(doc_id) mod 4 is not 2.

    The sample has at most 1.25 * `per_language` rows of each language, those of the lowest id hashes, 1.25 * `max_rows` rows
    (16 kB each while learning) and whole texts of `max_bytes` in all. Null and empty texts and null languages teach nothing. With no rows left, all texts are `und`.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where("lang is not null and doc_id is not null and text is not null and text <> ''")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    ids = rows.select("doc_id", "lang").distinct()
    chosen = [(r["doc_id"], r["lang"]) for r in labelled_sample(ids, "doc_id", "lang", per_language, max_rows)]
    small = docs.sparkSession.createDataFrame(chosen, "doc_id long, lang string")  # bounded by per_language
    found = bounded_texts(rows.join(F.broadcast(small), ["doc_id", "lang"]), max_bytes)
    return CodedLanguages.fit([r["text"] for r in found], [r["lang"] for r in found])


def languages(docs: DataFrame, model: CodedLanguages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, lang_pred string, score double (0 to 1), ambiguous boolean; one row for each row of `docs`.

    Null texts and those without a letter are `und` with score 0. The result depends on the text alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x bits weights

    def run(batches):
        model = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                lang, score, ambiguous = zip(*model.predict(part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array(score, pa.float64()), pa.array(ambiguous)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def recognised(docs: DataFrame, model: CodedLanguages, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose language is known and not ambiguous."""
    sent, keep = docs.sparkSession.sparkContext.broadcast(model), unused(docs, "known")

    def make():
        model = sent.value
        return lambda texts: [pa.array([lang != UNKNOWN and not unsure for lang, _, unsure in model.predict([t.decode("utf-8", "replace") for t in texts])], pa.bool_())]

    return with_text_results(docs, text_col, {keep: "boolean"}, make).where(F.col(keep)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """Language of all texts, learned from rows that aren't held out; null texts and those without a letter are `und`, rows of null id are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = languages(docs, fit_languages(docs))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")
