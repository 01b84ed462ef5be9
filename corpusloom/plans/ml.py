"""Models: a text classifier, topics with outliers, and labelling by a pluggable model client."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import cosine
from ..functions.text import checked_answer, shorten
from ..operators.evaluation import metrics, predictions
from ..operators.ranking import first_of

# Stand-ins for a fine-tuned transformer, UMAP and HDBSCAN, behind the same interface: not the same algorithms.


def train(df: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16, regularisation: Sequence[float] = (0.001, 0.01), split: str = "split") -> tuple[PipelineModel, DataFrame]:
    """Logistic regression on TF-IDF; the strength with the best F1 on the validation rows. Returns the model and metrics of all splits."""
    base = Pipeline(stages=[RegexTokenizer(inputCol=text, outputCol="_words", pattern="\\W+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="features")])
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias(text), F.col(label).cast("double").alias(label), split).where(F.col(label).isNotNull())
    best = None
    for strength in regularisation:
        model = Pipeline(stages=[*base.getStages(), LogisticRegression(labelCol=label, regParam=strength, maxIter=30)]).fit(rows.where(F.col(split) == "train"))
        scored = metrics(predict(rows, model, text).withColumn("gold_label", F.col(label).cast("int")), [split])
        f1 = scored.where(F.col(split) == "val").select("f1").first()
        if best is None or (f1[0] if f1 else 0.0) > best[0]:
            best = (f1[0] if f1 else 0.0, model, scored)
    return best[1], best[2]


def predict(df: DataFrame, model: PipelineModel, text: str = "text", threshold: float = 0.5, name: str = "") -> DataFrame:
    """`df` with pred_label, pred_label_text, pred_prob_1, pred_prob_0, pred_confidence and model_dir."""
    out = model.transform(df.withColumn(text, F.coalesce(F.col(text), F.lit("")))).withColumn("_p", vector_to_array("probability")[1])
    return predictions(out, "_p", threshold, name).select(*df.columns, "pred_label", "pred_label_text", "pred_prob_1", "pred_prob_0", "pred_confidence", "model_dir")


def topics(vectors: DataFrame, k: int = 10, reduced: int = 5, min_size: int = 10, farthest: float = 3.0, seed: int = 42, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, topic_id, topic_probability): K-means on principal components. Clusters under `min_size` and rows over `farthest` mean distances
    from their centre are outliers, -1, of null probability; topics are numbered by size, ties by first key."""
    rows = vectors.select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("_v"))
    model = Pipeline(stages=[Normalizer(inputCol="_v", outputCol="_n"), PCA(k=reduced, inputCol="_n", outputCol="_r"), KMeans(k=k, seed=seed, featuresCol="_r", predictionCol="_c")]).fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.stages[-1].clusterCenters()])
    out = model.transform(rows).select(key, "_c", vector_to_array("_r").alias("_r"))
    gap = F.aggregate(F.zip_with("_r", F.get(centres, F.col("_c")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("_d", F.sqrt(gap))
    sizes = out.groupBy("_c").agg(F.count("*").alias("_n"), F.avg("_d").alias("_mean"), F.min(key).alias("_first"))  # one row a cluster
    rank = F.row_number().over(Window.partitionBy(F.col("_n") >= min_size).orderBy(F.col("_n").desc(), F.col("_first").asc())) - 1
    out = out.join(F.broadcast(sizes.withColumn("_t", F.when(F.col("_n") >= min_size, rank).otherwise(-1))), "_c")
    inside = (F.col("_t") >= 0) & (F.col("_d") <= farthest * F.col("_mean"))
    return out.select(key, F.when(inside, F.col("_t")).otherwise(-1).cast("int").alias("topic_id"), F.when(inside, 1 / (1 + F.col("_d"))).alias("topic_probability"))


def adopt_outliers(assigned: DataFrame, vectors: DataFrame, least: float = 0.0, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Outliers given to the topic whose mean vector is most similar, if at least `least`; then without a probability."""
    rows = assigned.join(vectors.select(key, vector), key)
    size = F.posexplode(vector).alias("_i", "_x")
    means = rows.where("topic_id >= 0").select("topic_id", size).groupBy("topic_id", "_i").agg(F.avg("_x").alias("_m"))
    means = means.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_mean"))  # one row a topic
    near = rows.where("topic_id = -1").select(key, vector).join(F.broadcast(means), F.lit(True)).withColumn("_s", cosine(F.col(vector), F.col("_mean")))
    near = first_of(near.where(F.col("_s") >= least), [key], [F.col("_s").desc(), F.col("topic_id").asc()]).select(key, F.col("topic_id").alias("_new"))
    out = assigned.join(near, key, "left")
    return out.select(key, F.coalesce("_new", "topic_id").alias("topic_id"), F.when(F.col("_new").isNull(), F.col("topic_probability")).alias("topic_probability"))


def adopt_outliers_by_terms(docs: DataFrame, terms: DataFrame, least: float = 0.0, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """Outliers (topic_id -1) given to the topic whose class TF-IDF terms are most similar to their tokens, if over `least`; ties to the smaller id."""
    norm = F.sqrt(F.sum(F.col("term_weight") ** 2).over(Window.partitionBy("topic_id")))
    weights = terms.select("topic_id", "term", (F.col("term_weight") / norm).alias("_w"))
    counts = docs.where("topic_id = -1").select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("_n"))
    size = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("_n") ** 2)).alias("_s"))
    near = counts.join(weights, "term").groupBy(key, "topic_id").agg(F.sum(F.col("_n") * F.col("_w")).alias("_dot")).join(size, key).withColumn("_sim", F.col("_dot") / F.col("_s"))
    best = near.where((F.col("_sim") > least) & (F.col("topic_id") >= 0)).groupBy(key).agg(F.min(F.struct((-F.col("_sim")).alias("s"), "topic_id")).alias("_b"))
    return docs.join(best, key, "left").withColumn("topic_id", F.coalesce("_b.topic_id", "topic_id")).drop("_b")


Client = Callable[[str], str]


def label_posts(df: DataFrame, make_client: Callable[[], Client], prompt: Callable[[str], str], text: str = "text", attempts: int = 2, longest: int = 1200, make_fixer: Callable[[], Client] | None = None) -> DataFrame:
    """Adds label, exclusion, confidence, reason, problem, raw and fixed_raw of a model's answers.

    Each executor makes its own client. A call that raises is tried again; what then has no valid answer goes to the fixer,
    if there is one, and else keeps its problem with default values.
    """
    kinds = "raw string, fixed_raw string"

    def run(make: Callable[[], Client], ask: Callable[[str], str], column: str, name: str):
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = make()
            for frame in frames:
                answers = []
                for value, wanted in zip(frame[column], frame["_todo"], strict=True):
                    answer = ""
                    for _ in range(attempts if wanted else 0):
                        try:
                            answer = client(ask(value or ""))
                            break
                        except Exception:  # noqa: BLE001  any failure of the service counts as one
                            continue
                    answers.append(answer)
                yield frame.assign(**{name: answers})

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = df.withColumn("_short", shorten(F.coalesce(F.col(text), F.lit("")), longest)).withColumn("_todo", F.lit(True))
    inner = schema + ", _short string, _todo boolean"
    out = rows.mapInPandas(run(make_client, prompt, "_short", "raw"), inner + ", raw string").withColumn("_a", checked_answer("raw"))
    if make_fixer is not None:
        todo = out.withColumn("_todo", ~F.col("_a.ok")).drop("_a")
        out = todo.mapInPandas(run(make_fixer, lambda raw: f"Return the object below as valid JSON.\n{raw}", "raw", "fixed_raw"), inner + ", " + kinds)
        out = out.withColumn("_b", checked_answer("fixed_raw")).withColumn("_a", F.when(F.col("_b.ok"), F.col("_b")).otherwise(checked_answer("raw")))
    else:
        out = out.withColumn("fixed_raw", F.lit(""))
    a = F.col("_a")
    default = {"label": "无关", "exclusion": "其他", "confidence": "低"}
    return out.select(*df.columns, *[F.coalesce(a[k], F.lit(v)).alias(k) for k, v in default.items()], a["reason"].alias("reason"), a["problem"].alias("problem"), "raw", "fixed_raw")


def labelling_report(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "confidence", "exclusion").agg(F.count("*").alias("rows"), F.count_if(F.col("problem") != "").alias("degraded_rows"))
