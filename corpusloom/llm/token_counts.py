"""Token counts of fields and sections of whole documents, by the places of tokens.

A document is encoded once, as the text of its fields joined by a separator, since tokens of parts encoded alone differ.
Each token's character span is then joined to the intervals of fields and sections; a rule says where a token that
crosses a boundary counts.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

RULES = ("start", "end", "majority", "split")
#: Fixed value: how the rank file's texts are split before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer runs of white space are pieces that are encoded by themselves: the library's pattern overflows its stack on them.
LONG_SPACE = 1000
SPACES = regex.compile(r"\p{White_Space}{%d,}" % LONG_SPACE)


@lru_cache(1)
def encoding(ranks: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Encoder and the bytes in each token."""
    pairs = dict((base64.b64decode(a), int(b)) for a, b in map(bytes.split, ranks.splitlines()))
    sizes = np.zeros(max(pairs.values()) + 1, np.int64)
    for text, k in pairs.items():
        sizes[k] = len(text)
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=pairs, special_tokens={}), sizes


def sections(parts: list[str], separator: str, delimiter: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(field, section) of each interval and the character where each starts and the last ends.

    A section keeps the delimiter that ends it, a field's last section the separator that follows the field.
    """
    names, starts, at = [], [0], 0
    for k, part in enumerate(parts):
        pieces = part.split(delimiter)
        for n, piece in enumerate(pieces):
            at += len(piece) + (len(delimiter) if n < len(pieces) - 1 else len(separator) if k < len(parts) - 1 else 0)
            names.append((k, n))
            starts.append(at)
    return names, np.array(starts, np.int64)


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """As `enc.encode_ordinary`, with white space of any length.

    By SPLIT a run of white space starts a piece. All of it is one at the end of the text, all but its last character
    elsewhere, so the text can be cut there.
    """
    out, done = [], 0
    for run in SPACES.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += enc.encode_ordinary(text[done : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        done = end
    return out + enc.encode_ordinary(text[done:])


def spans(enc: tiktoken.Encoding, sizes: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of each token and the one after its last; a character that two tokens share counts in both."""
    data = text.encode("utf-8", "replace")
    ids = np.array(encode(enc, text), np.int64)
    end = np.cumsum(sizes[ids])
    if len(data) == len(text):
        return end - sizes[ids], end
    char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1  # of each byte
    return char[end - sizes[ids]], char[end - 1] + 1


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each interval by the rule, and how many of those that touch it cross one of its ends.

    start, end: all of a token counts where its first or last character lies. majority: where most of its characters
    lie, the earlier place of equals. split: each place has the share of its characters. Empty intervals get nothing.
    """
    n = len(starts) - 1
    low = np.searchsorted(starts, first, "right") - 1
    high = np.searchsorted(starts, last - 1, "right") - 1
    counts = np.bincount((high if rule == "end" else low), minlength=n).astype(np.float64)
    crossing = np.zeros(n)
    t = np.flatnonzero(low != high)
    width = high[t] - low[t] + 1
    token = np.repeat(np.arange(len(t)), width)  # one row for each interval that a crossing token touches
    place = low[t][token] + np.arange(len(token)) - np.repeat(np.cumsum(width) - width, width)
    share = np.minimum(starts[place + 1], last[t][token]) - np.maximum(starts[place], first[t][token])
    np.add.at(crossing, place[share > 0], 1)
    if rule in ("majority", "split"):
        np.add.at(counts, low[t], -1)
    if rule == "split":
        np.add.at(counts, place, share / (last - first)[t][token])
    elif rule == "majority":
        order = np.lexsort((place, -share, token))
        np.add.at(counts, place[order][np.cumsum(width) - width], 1)
    return counts, crossing


def token_counts(docs: DataFrame, ranks_path: str, fields: tuple[str, ...] = ("text",), id_col: str = "doc_id", separator: str = "\n", delimiter: str = "\n", rule: str = "majority") -> DataFrame:
    """One row for each section of each field of each row of `docs`: doc_id long, field string, section, start_char, end_char
    long, n_tokens double, n_crossing long, doc_tokens long.

    Sections lie between `delimiter`s. Null fields count as empty; an empty document has one empty section a field,
    with no tokens. Over a document n_tokens adds up to doc_tokens by any rule. Repeated rows and ids give repeated rows.
    Other columns are not read; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())  # bounded by its vocabulary

    def run(batches):
        enc, sizes = encoding(ranks.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                ids = part.column("_id").to_pylist()
                texts = list(zip(*(part.column(f"_f{k}").to_pylist() for k in range(len(fields))), strict=True))
                out = [[] for _ in range(8)]
                for doc, parts in zip(ids, texts, strict=True):
                    names, starts = sections(list(parts), separator, delimiter)
                    first, last = spans(enc, sizes, separator.join(parts))
                    counts, crossing = allocate(first, last, starts, rule)
                    n = len(names)
                    for column, values in zip(out, ([doc] * n, [fields[f] for f, _ in names], [s for _, s in names], starts[:-1].tolist(), starts[1:].tolist(), counts.tolist(), crossing.astype(np.int64).tolist(), [len(first)] * n), strict=True):
                        column += values
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 3, pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["doc_id", "field", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"_f{k}") for k, c in enumerate(fields)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), *texts)
    return rows.mapInArrow(run, "doc_id long, field string, section long, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Lines of documents; a token counts where most of it lies."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
