"""Runs that break off: labelling goes on where it stopped, a sink leaves no half file."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.dedup import signature
from corpusloom.plans.labelling import label_in_chunks
from corpusloom.sources import per_file
from corpusloom.sources.files import read_tables

GOOD = '{"tangping_related_label": "相关", "confidence": "high", "reason": "%s"}'


def client_of(log, dies=None, answer=GOOD):
    """A client that notes what it is asked, and dies on one text."""

    def make():
        def ask(prompt):
            if prompt == dies:
                os._exit(1)
            with open(log, "a") as out:
                out.write(prompt + "\n")
            return answer % prompt if "%s" in answer else answer

        return ask

    return make


def asked(log):
    return sorted(open(log).read().split()) if os.path.exists(log) else []


def test_a_labelling_run_goes_on(spark, tmp_path):
    """Over two runs every row of a finished chunk is asked once; those of the chunk that broke are asked again."""
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(60)], "id long, text string")
    folder, log = str(tmp_path / "run"), str(tmp_path / "log")
    broken = rows.where(F.pmod(signature(rows.columns), F.lit(6)) == 3).first()["text"]  # of the fourth chunk
    with pytest.raises(Exception):  # noqa: B017  the worker is gone
        label_in_chunks(rows, client_of(log, broken), str, folder, chunk_rows=10, tasks=2).collect()
    done = {r["text"] for k in os.listdir(f"{folder}/done") if os.path.exists(f"{folder}/done/{k}/_SUCCESS") for r in spark.read.parquet(f"{folder}/done/{k}").collect()}
    before = asked(log)
    assert broken not in before and done <= set(before) and 0 < len(done) < 60
    os.remove(log)
    out = label_in_chunks(rows, client_of(log), str, folder, chunk_rows=10, tasks=2)
    assert asked(log) == sorted({f"t{k}" for k in range(60)} - done)
    assert sorted((r["id"], r["label"], r["problem"]) for r in out.collect()) == [(k, "相关", "") for k in range(60)]
    os.remove(log)
    assert label_in_chunks(rows, client_of(log), str, folder, chunk_rows=10, tasks=2).count() == 60 and asked(log) == []
    with pytest.raises(ValueError):
        label_in_chunks(rows.where("id > 0"), client_of(log), str, folder)


def test_answers_are_checked_anew(spark, tmp_path):
    """Of finished chunks only rows whose answers don't hold up are asked again."""
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(20)], "id long, text string")
    folder, log = str(tmp_path / "run"), str(tmp_path / "log")
    label_in_chunks(rows, client_of(log), str, folder, chunk_rows=7).count()
    for k in os.listdir(f"{folder}/done"):
        some = spark.read.parquet(f"{folder}/done/{k}")
        aside = str(tmp_path / f"aside{k}")
        some.withColumn("raw", F.when(F.col("id") % 5 == 0, "broken").otherwise(F.col("raw"))).withColumn("label", F.when(F.col("id") % 5 == 1, "无关").otherwise(F.col("label"))).write.parquet(aside)
        spark.read.parquet(aside).write.mode("overwrite").parquet(f"{folder}/done/{k}")
    os.remove(log)
    out = label_in_chunks(rows, client_of(log), str, folder, chunk_rows=7)
    assert asked(log) == sorted(f"t{k}" for k in range(20) if k % 5 in (0, 1))
    assert out.count() == 20 and out.where("label <> '相关' or problem <> ''").count() == 0


def test_no_rows_to_label(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, text string")
    assert label_in_chunks(rows, client_of(str(tmp_path / "log")), str, str(tmp_path / "run")).count() == 0


@pytest.fixture
def predicted(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for k, name in enumerate(["a.csv", "b.csv", "话题 c.csv"]):
        (root / name).write_text("id,text\n" + "".join(f"{100 * k + j},x\n" for j in range(5 + k)))
    spark.range(900, 903).selectExpr("id", "'p' as text").coalesce(1).write.parquet(str(root / "d.parquet"))
    return read_tables(spark, str(root / "*")).withColumn("pred", F.col("id").cast("long") % 2)


def test_a_file_for_each_file(spark, predicted, tmp_path):
    out = tmp_path / "out"
    per_file.save_per_file(predicted, str(out))
    names = sorted(os.listdir(out))
    assert names[:2] == ["a.csv", "b.csv"] and "话题 c.csv" in names and len(names) == 4 and not any(n.startswith("_") for n in names)
    back = read_tables(spark, str(out / "*"))
    assert back.count() == 5 + 6 + 7 + 3 and sorted(c for c in back.columns if c != "__input_file") == ["id", "pred", "text"]
    assert (out / "a.csv").read_text().splitlines()[0] == '"id","text","pred"'
    with pytest.raises(Exception, match="clash"):
        per_file.save_per_file(predicted.where("id < 5"), str(out), overwrite=False)
    with pytest.raises(Exception, match="clash"):
        per_file.save_per_file(predicted.withColumn("__input_file", F.concat(F.lit("/"), F.col("id"), F.lit("/same.csv"))), str(tmp_path / "other"))
    assert os.listdir(tmp_path / "other") == []


def test_a_broken_job_leaves_what_was_there(spark, predicted, tmp_path):
    out = tmp_path / "out"
    per_file.save_per_file(predicted.where("id < 3"), str(out))
    before = {n: (out / n).read_bytes() for n in os.listdir(out)}
    broken = predicted.withColumn("pred", F.when(F.col("id") == 103, F.raise_error(F.lit("broken"))).otherwise(F.col("pred").cast("string")))
    with pytest.raises(Exception, match="broken"):
        per_file.save_per_file(broken, str(out))
    assert {n: (out / n).read_bytes() for n in os.listdir(out)} == before and len(before) == 1
