"""Words of texts that put none between spaces, from a list of words with counts.

Of all ways to cut a run of characters into words of the list and single characters, the likeliest is taken; what is left as
single characters goes to a model of first, middle, last and single characters, learned from the list. Costs are whole
numbers, so ties are ties on every machine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Words of a list, at most: each task holds it, with all beginnings of words.
MOST_WORDS = 500_000
#: Costs are so many parts of a natural logarithm.
UNIT = 1_000_000
RUNS = r"[A-Za-z0-9_]+|[一-鿿]+"
#: Runs that are words already.
WHOLE = r"[A-Za-z0-9_]+"
#: States of characters: first, middle and last of a word, and a word alone; what may follow what.
STATES = "BMES"
FOLLOWS = {"B": "ME", "M": "ME", "E": "BS", "S": "BS"}


def cost(part: float, whole: float) -> int:
    return round(UNIT * (math.log(whole) - math.log(part)))


class Segmenter:
    """The words of a list by their beginnings: each beginning has its cost if it is a word, and None if words only go on from it."""

    def __init__(self, words: dict[str, int], unknown_words: bool = True):
        words = {w: n for w, n in words.items() if w and n > 0}
        self.total = max(1, sum(words.values()))
        self.trie: dict[str, int | None] = {w: cost(n, self.total) for w, n in words.items()}
        for w in words:
            for k in range(1, len(w)):
                self.trie.setdefault(w[:k])
        self.stranger = cost(1, self.total)
        self.model = _model(words) if unknown_words and words else None

    def best_path(self, run: str) -> list[str]:
        """The words of least cost; of equal ones those whose first word is longer, then the second."""
        n = len(run)
        least, step = [0] * (n + 1), [1] * (n + 1)
        for i in range(n - 1, -1, -1):
            single = self.trie.get(run[i])
            least[i], step[i] = (self.stranger if single is None else single) + least[i + 1], 1
            for k in range(i + 1, n + 1):
                piece = run[i:k]
                if piece not in self.trie:
                    break
                if (c := self.trie[piece]) is not None and k > i + 1 and c + least[k] <= least[i]:
                    least[i], step[i] = c + least[k], k - i
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out

    def cut(self, run: str) -> list[str]:
        """The best path, with two or more single characters in a row cut by the model of characters."""
        out, held = [], ""
        for word in [*self.best_path(run), ""]:
            if len(word) == 1 and self.model:
                held += word
                continue
            out += viterbi(held, self.model) if len(held) > 1 else [held] * bool(held)
            held = ""
            if word:
                out.append(word)
        return out


def _model(words: dict[str, int]) -> tuple[dict, dict, dict]:
    """Costs of a first state, of one state after another, and of a character in a state; one is added to the counts of characters."""
    start, after, shown = dict.fromkeys("BS", 1), {(a, b): 1 for a in STATES for b in FOLLOWS[a]}, {}
    for w, n in words.items():
        states = "S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E"
        start[states[0]] += n
        for a, b in zip(states, states[1:], strict=False):
            after[a, b] += n
        for s, c in zip(states, w, strict=True):
            shown[s, c] = shown.get((s, c), 0) + n
    for a in "ES":  # words follow each other as if independent
        for b in "BS":
            after[a, b] = start[b]
    kinds = len({c for _, c in shown}) + 1
    whole = {s: sum(n for (t, _), n in shown.items() if t == s) + kinds for s in STATES}
    begin = {s: cost(n, sum(start.values())) for s, n in start.items()}
    follow = {(a, b): cost(n, sum(m for (x, _), m in after.items() if x == a)) for (a, b), n in after.items()}
    char = {k: cost(n + 1, whole[k[0]]) for k, n in shown.items()} | {(s, ""): cost(1, whole[s]) for s in STATES}
    return begin, follow, char


def viterbi(run: str, model: tuple[dict, dict, dict]) -> list[str]:
    """Words by the likeliest states of characters; of equal ones the last state, from the end on, is the earlier of BMES."""
    begin, follow, char = model
    seen = lambda s, c: char.get((s, c), char[s, ""])
    least, back = {s: begin[s] + seen(s, run[0]) for s in "BS"}, []
    for c in run[1:]:
        step = {b: min((least[a] + follow[a, b], STATES.index(a)) for a in STATES if a in least and b in FOLLOWS[a]) for b in STATES if any(a in least and b in FOLLOWS[a] for a in STATES)}
        least, back = {b: v + seen(b, c) for b, (v, _) in step.items()}, [*back, {b: STATES[a] for b, (_, a) in step.items()}]
    states = [min((s for s in "ES" if s in least), key=lambda s: (least[s], s))]
    for step in reversed(back):
        states.append(step[states[-1]])
    out = []
    for s, c in zip(reversed(states), run, strict=True):
        if s in "BS":
            out.append(c)
        else:
            out[-1] += c
    return out


@lru_cache(4)
def _segmenter(words: tuple[tuple[str, int], ...], unknown_words: bool) -> Segmenter:
    return Segmenter(dict(words), unknown_words)


def word_list(words: DataFrame, most: int = MOST_WORDS) -> dict[str, int]:
    """Words and counts of (word, count), equal words added up; more than `most` are an error."""
    rows = words.where("word is not null and word <> '' and count > 0").groupBy("word").agg(F.sum("count").alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} words")
    return {r[0]: int(r[1]) for r in rows}


def with_segments(df: DataFrame, text: str, words: DataFrame, name: str = "tokens", runs: str = RUNS, whole: str = WHOLE, unknown_words: bool = True) -> DataFrame:
    """`df` with array<string> `name`: the words of each text's `runs`. Runs that match `whole` stay as they are. Null texts have none.

    words: (word string, count long).
    """
    held = df.sparkSession.sparkContext.broadcast(tuple(sorted(word_list(words).items())))  # bounded by MOST_WORDS
    columns = list(df.columns)
    rows = df.withColumn("_segment_text", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]):
        cutter, find, keep = _segmenter(held.value, unknown_words), regex.compile(runs), regex.compile(whole)
        for batch in batches:
            found = [[w for r in find.findall(t) for w in ([r] if keep.fullmatch(r) else cutter.cut(r))] for t in batch.column("_segment_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.list_(pa.string()))], [*columns, name])

    return rows.mapInArrow(run, StructType([*df.schema.fields]).add(name, ArrayType(StringType())))
