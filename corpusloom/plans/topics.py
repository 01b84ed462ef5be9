"""Topics of vectors: density clusters on a layout of their neighbours, merging of topics, and ways to give outliers a topic.

Topics are tables (key, topic_id, topic_probability) with -1 for outliers, numbered by size, ties by the smallest key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..operators.density import density_clusters
from ..operators.neighbours import distinct_points, fuzzy_weights, layout, neighbour_graph
from .ml import adopt_outliers, adopt_outliers_by_terms

#: Topics whose vectors one task merges, at most.
MOST_TOPICS = 5000


def density_topics(vectors: DataFrame, min_size: int = 10, min_samples: int | None = None, neighbours: int = 15, dims: int | None = 5, cosine: bool = True, topics: int | str | None = None, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Density clusters of a layout in `dims` dimensions, or of the vectors themselves without `dims`; outliers are -1, with null probability.

    With `topics`, a number or "auto", clusters are merged to so many. Rows of equal vectors share a topic; rows without a
    usable vector or key have none and are left out.
    """
    points, rows = distinct_points(vectors, key, vector, cosine)
    graph = neighbour_graph(points, max(neighbours, min_samples or min_size))
    if dims:
        placed = layout(points, graph, dims).withColumnRenamed("place", "vector").join(points.select("id", "copies"), "id")
        graph = neighbour_graph(placed, max(neighbours, min_samples or min_size))
    found = density_clusters(graph, points, min_size, min_samples)
    out = rows.join(found, "id").select(F.col("key").alias(key), F.col("cluster").alias("topic_id"), F.col("probability").alias("topic_probability"))
    return out if topics is None else merge_topics(out, vectors, topics, vector, key)


def renumbered(assigned: DataFrame, key: str = "vec_id") -> DataFrame:
    """Topics numbered by size, ties by the smallest key; outliers stay -1."""
    sizes = assigned.where("topic_id >= 0").groupBy("topic_id").agg(F.count("*").alias("_n"), F.min(key).alias("_k"))
    numbers = sizes.select("topic_id", (F.row_number().over(Window.orderBy(F.col("_n").desc(), "_k")) - 1).cast("int").alias("_t"))  # one row a topic
    return assigned.join(numbers, "topic_id", "left").withColumn("topic_id", F.coalesce("_t", F.lit(-1))).select(*assigned.columns)


def topic_vectors(assigned: DataFrame, vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(topic_id, mean array<double>) of each topic but outliers, by component."""
    rows = assigned.where("topic_id >= 0").select(key, "topic_id").join(vectors.select(key, vector), key)
    means = rows.select("topic_id", F.posexplode(vector).alias("_i", "_x")).groupBy("topic_id", "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("mean"))  # one row a topic


def merge_tree(means: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """(a, b, distance) of each merge, b into a < b, nearest pair first, ties to the smaller numbers.

    The distance of two sets of topics is the mean cosine distance of their members.
    """
    n = len(means)
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    d, held = 1 - unit @ unit.T, np.ones(n)
    np.fill_diagonal(d, np.inf)
    d[np.tril_indices(n)] = np.inf
    out = []
    for _ in range(n - 1):
        a, b = divmod(int(d.argmin()), n)
        out.append((a, b, float(d[a, b])))
        row = lambda k: np.concatenate([d[:k, k], [np.inf], d[k, k + 1 :]])
        mean = (row(a) * held[a] + row(b) * held[b]) / (held[a] + held[b])
        mean[[a, b]] = np.inf
        d[b, :] = d[:, b] = np.inf
        d[:a, a], d[a, a + 1 :] = mean[:a], mean[a + 1 :]
        held[a] += held[b]
    return out


def merge_topics(assigned: DataFrame, vectors: DataFrame, topics: int | str = "auto", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Topics merged to `topics` of them by the mean cosine distance of their vectors, then numbered anew.

    "auto" stops before the merge whose distance is furthest above the one before it, the earlier one of equals; two topics or fewer
    stay as they are. Probabilities stay; outliers too.
    """
    if topics != "auto" and int(topics) < 1:
        raise ValueError("at least one topic must be left")
    means = topic_vectors(assigned, vectors, vector, key)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MOST_TOPICS:
            raise ValueError(f"over {MOST_TOPICS} topics to merge")
        frame = frame.sort_values("topic_id")
        ids, up = frame["topic_id"].tolist(), list(range(len(frame)))
        tree = merge_tree(np.stack(frame["mean"].to_numpy()), np.ones(len(frame)))
        heights = [h for *_, h in tree]
        gaps = [b - a for a, b in zip(heights, heights[1:], strict=False)]
        steps = max(0, len(ids) - int(topics)) if topics != "auto" else int(np.argmax(gaps)) + 1 if gaps and max(gaps) > 0 else 0
        for a, b, _ in tree[:steps]:
            up[b] = a
        root = []
        for k in range(len(ids)):
            while up[k] != k:
                k = up[k]
            root.append(ids[k])
        return pd.DataFrame({"topic_id": ids, "_into": root})

    into = means.groupBy().applyInPandas(merge, "topic_id int, _into int")  # one row a topic
    out = assigned.join(into, "topic_id", "left").withColumn("topic_id", F.coalesce("_into", "topic_id")).select(*assigned.columns)
    return renumbered(out, key)


def memberships(graph: DataFrame, assigned: DataFrame, key: str = "id") -> DataFrame:
    """(key, topic_id, membership): each point's fuzzy neighbours by topic, as parts of all of its neighbours. Topics without any have no row."""
    edges = fuzzy_weights(graph)
    both = edges.select("u", "v", "weight").union(edges.select("v", "u", "weight"))
    topics = assigned.select(F.col(key).alias("v"), "topic_id")
    sums = both.join(topics, "v").groupBy("u", "topic_id").agg(F.sum("weight").alias("w"))
    whole = both.groupBy("u").agg(F.sum("weight").alias("all"))
    return sums.where("topic_id >= 0").join(whole, "u").select(F.col("u").alias(key), "topic_id", (F.col("w") / F.col("all")).alias("membership"))


def adopt_by_membership(assigned: DataFrame, members: DataFrame, least: float = 0.0, key: str = "id") -> DataFrame:
    """Outliers given to the topic of greatest membership, if over 0 and at least `least`; ties to the smaller id."""
    best = members.where((F.col("membership") > 0) & (F.col("membership") >= least)).groupBy(key).agg(F.min(F.struct((-F.col("membership")).alias("m"), "topic_id")).alias("_b"))
    return _adopted(assigned, best.select(key, F.col("_b.topic_id").alias("_new")), key)


def _adopted(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    out = docs.join(found, key, "left").withColumn("topic_id", F.when(F.col("topic_id") < 0, F.coalesce("_new", "topic_id")).otherwise(F.col("topic_id")))
    if "topic_probability" in docs.columns:  # given ones have none
        out = out.withColumn("topic_probability", F.when(F.col("_new").isNull(), F.col("topic_probability")))
    return out.select(*docs.columns)


def topic_distributions(docs: DataFrame, terms: DataFrame, window: int = 4, least: float = 0.1, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """(key, topic_id, share): how much of each document is of each topic, from windows of tokens.

    A window is `window` tokens one after another, or all of a shorter text. Its similarity to a topic is the cosine of its
    counts to the topic's class TF-IDF terms, 0 below `least`. A token has the mean similarity of the windows that it is in, a
    document the sum of its tokens, in parts of the sum over topics. Topics without a share have no row.
    """
    norm = F.sqrt(F.sum(F.col("term_weight") ** 2).over(Window.partitionBy("topic_id")))
    weights = terms.where("topic_id >= 0").select("topic_id", "term", (F.col("term_weight") / norm).alias("_w"))
    held: dict[str, list[tuple[int, float]]] = {}
    for topic, term, w in weights.orderBy("topic_id", "term").collect():  # some best terms of each topic
        held.setdefault(term, []).append((topic, w))
    sums = _window_sums(window, least, held)
    fields = StructType([docs.schema[key], StructField("topic_id", LongType()), StructField("_sum", DoubleType())])
    rows = docs.select(key, tokens).mapInArrow(sums, fields).repartition(key)
    rows = rows.groupBy(key, F.col("topic_id").cast(terms.schema["topic_id"].dataType).alias("topic_id")).agg(F.sum("_sum").alias("_sum")).where("_sum > 0")
    return rows.withColumn("share", F.col("_sum") / F.sum("_sum").over(Window.partitionBy(key))).select(key, "topic_id", "share")  # one row a topic and document


def _window_sums(window: int, least: float, held: dict[str, list[tuple[int, float]]]):
    """For batches of (key, tokens): (key, topic, sum) over the windows of each row. `held` has the topics and weights of a term."""
    topics = np.array(sorted({t for pairs in held.values() for t, _ in pairs}), np.int64)

    def of(keys: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        code = pc.fill_null(flat.indices, -1).to_numpy().astype(np.int64)
        words = [held.get(w, []) for w in flat.dictionary.to_pylist()] + [[]]  # a null has code -1 and no topic
        many = np.array([len(w) for w in words])
        first = np.cumsum(many) - many
        topic = np.searchsorted(topics, np.array([t for w in words for t, _ in w], np.int64))
        weight = np.array([x for w in words for _, x in w], float)
        start = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(code)) - start[row]
        last = np.maximum(sizes - window, 0)[row]
        # each use of a topic's term, in every window that it is in; a window goes by the place of its first token
        use = np.repeat(np.arange(len(code)), many[code])
        pair = np.arange(len(use)) - np.repeat(np.cumsum(many[code]) - many[code], many[code]) + first[code][use]
        places, which = [], []
        for back in range(window):
            inside = (at[use] >= back) & (at[use] - back <= last[use])
            places.append(use[inside] - back)
            which.append(pair[inside])
        place, pair = np.concatenate(places), np.concatenate(which)
        met, one = np.unique(place * len(topics) + topic[pair], return_inverse=True)
        dot = np.bincount(one, weight[pair], len(met))
        place, topic = np.divmod(met, max(1, len(topics)))
        # squared counts of a window add up to its tokens and twice the pairs of equal ones
        end = place + np.minimum(sizes, window)[row[place]]
        same = np.zeros(len(place))
        for k in range(1, window):
            equal = np.zeros(len(code) + 1)
            if len(code) > k:
                equal[k + 1 :] = np.cumsum((code[k:] == code[:-k]) & (code[k:] >= 0) & (at[k:] >= k))
            same += equal[end] - equal[np.minimum(place + k, end)]
        near = dot / np.sqrt(end - place + 2 * same)
        # how many windows each token of the window is in: they start from it - window + 1 to it, as far as there are any
        share = np.zeros(len(place))
        for p in range(window):
            here = at[place] + p
            share += np.where(place + p < end, 1 / np.maximum(1, np.minimum(here, last[place]) - np.maximum(here - window + 1, 0) + 1), 0)
        good = near >= least
        found, one = np.unique(row[place[good]] * len(topics) + topic[good], return_inverse=True)
        total = np.bincount(one, near[good] * share[good], len(found))
        row, topic = np.divmod(found, max(1, len(topics)))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(topics[topic]), pa.array(total)], ["key", "topic_id", "_sum"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64))
            lo = 0
            while lo < len(keys) and len(topics):  # rows of some 100,000 tokens at a time
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 100_000)))
                out = of(keys.slice(lo, hi - lo), lists.slice(lo, hi - lo))
                yield out.rename_columns([batch.schema.names[0], "topic_id", "_sum"])
                lo = hi

    return run


def adopt_by_distribution(docs: DataFrame, terms: DataFrame, least: float = 0.0, window: int = 4, similar: float = 0.1, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """Outliers given to the topic with most of their tokens' windows, if its share is at least `least`; ties to the smaller id."""
    shares = topic_distributions(docs.where("topic_id < 0"), terms, window, similar, tokens, key)
    best = shares.where(F.col("share") >= least).groupBy(key).agg(F.min(F.struct((-F.col("share")).alias("s"), "topic_id")).alias("_b"))
    return _adopted(docs, best.select(key, F.col("_b.topic_id").alias("_new")), key)


STRATEGIES = ("none", "embeddings", "c-tf-idf", "distributions", "probabilities", "c-tf-idf+distributions")


def reduce_outliers(docs: DataFrame, strategy: str, terms: DataFrame | None = None, vectors: DataFrame | None = None, members: DataFrame | None = None, least: float = 0.0, key: str = "doc_id") -> DataFrame:
    """`docs` (key, topic_id, tokens, ...) with outliers given to topics by one of STRATEGIES.

    The chained strategy gives to distributions only those whom class TF-IDF left over. embeddings needs (key, embedding) as
    `vectors`, probabilities the table of `memberships`, the others `terms` of `class_tfidf`.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    need = {"embeddings": vectors, "probabilities": members}.get(strategy, terms)
    if strategy != "none" and need is None:
        raise ValueError(f"{strategy} needs a table that wasn't given")
    by_terms: Callable[[DataFrame], DataFrame] = lambda d: adopt_outliers_by_terms(d, terms, least, key=key)
    if strategy == "c-tf-idf":
        return by_terms(docs)
    if strategy == "distributions":
        return adopt_by_distribution(docs, terms, least, key=key)
    if strategy == "c-tf-idf+distributions":
        return adopt_by_distribution(by_terms(docs), terms, least, key=key)
    if strategy == "probabilities":
        return adopt_by_membership(docs, members, least, key)
    if strategy == "embeddings":
        given = adopt_outliers(docs.select(key, "topic_id", F.lit(None).cast("double").alias("topic_probability")), vectors, least, key=key)
        return _adopted(docs, given.select(key, F.col("topic_id").alias("_new")).where("_new >= 0"), key)
    return docs
