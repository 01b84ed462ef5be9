"""Training on several tasks: the same weights on any number of them, and labels of rows that were held out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sampling
from corpusloom.operators.evaluation import metrics
from corpusloom.plans.training import Network, Schedule, network_predictions, train_dual, train_network


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = marks.join(docs.select("doc_id", "text"), "doc_id")
    return sampling.split(rows.withColumn("label", F.col("toxic")), "doc_id", "label").cache()


def test_held_out_f1(labelled):
    network, log = train_network(labelled, network=Network(1 << 12, 8))
    rows = log.orderBy("epoch").collect()
    assert len(rows) == 8 and rows[-1]["loss"] < rows[0]["loss"] and max(r["f1"] for r in rows) > 0.4
    scored = network_predictions(labelled.where("split = 'test'").withColumn("gold_label", F.col("label")), network)
    assert metrics(scored, ["split"]).first()["f1"] > 0.35


def test_weights_do_not_depend_on_tasks(spark):
    rng = np.random.default_rng(0)
    rows = [(" ".join(rng.choice(list("abcdefgh"), 6)), k % 7 == 0, "val" if k % 5 == 0 else "train") for k in range(300)]
    rows = [(t + (" bad" if y else "") if k % 11 else None, int(y) if k % 13 else None, s) for k, (t, y, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "text string, label int, split string")
    one, log = train_network(df, network=Network(64, 4), epochs=2, tasks=1)
    three, again = train_network(df.repartition(7), network=Network(64, 4), epochs=2, tasks=3)
    assert all(np.array_equal(a, b) for a, b in zip(one.weights, three.weights, strict=True)) and log.collect() == again.collect()
    out = network_predictions(df, one)
    assert out.count() == 300 and set(out.columns) >= {"pred_label", "pred_prob_1", "pred_confidence"}
    with pytest.raises(ValueError):
        train_network(df.where("label is null"))


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    net = Network(12, 3).start(1)
    x, y, share = rng.random((5, 12)), np.array([0, 1, 1, 0, 1.0]), rng.random(5)
    loss = lambda: -(share * (y * np.log(net.forward(x)[1]) + (1 - y) * np.log(1 - net.forward(x)[1]))).sum()
    for w, g in zip(net.weights, net.gradient(x, y, share), strict=True):
        for at in np.ndindex(w.shape):
            w[at] += 1e-6
            up = loss()
            w[at] -= 2e-6
            assert abs((up - loss()) / 2e-6 - g[at]) < 1e-5
            w[at] += 1e-6


def test_schedule_rises_and_falls():
    rates = [Schedule(1.0, steps=100).at(k) for k in range(100)]
    assert rates.index(max(rates)) in (9, 10) and rates[0] == 0.1 and rates[-1] < 0.02 and all(a > b for a, b in zip(rates[10:], rates[11:], strict=False))


def test_two_labels(labelled):
    found, table = train_dual(labelled.where("doc_id % 4 = 0").withColumn("good", F.when(F.col("doc_id") % 3 > 0, F.col("quality"))), ("toxic", "good"), network=None, epochs=2)
    assert set(found) == {"toxic", "good"} and {r["label_name"] for r in table.collect()} == {"toxic", "good"}
