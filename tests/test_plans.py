import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.plans import base, ml
from corpusloom.plans.ingest import Collection, preprocess
from corpusloom.sources import files, sinks
from corpusloom.streaming import ingest as stream


def put(root: Path, rel: str, data: str | bytes) -> None:
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "raw"
    put(root, "1/csv/躺平/2024/01/01.csv", "﻿id,微博正文,发布时间,ip\n1,第一条 https://t.cn/x,2024-01-01 10:00,北京\n2,\"带\n换行\",2024-01-01,\n2,重复,x,y\n,没有号,x,y\n3,太,多,列,了,啊\n4,短\n")
    put(root, "1/csv/摆烂/a.csv", "微博正文,id,extra\n第一条,9,NA\n,10,x\n".encode("gb18030"))
    put(root, "1/csv/躺平/2024/01/02.backup.csv", "id\n5\n")
    put(root, "other/x.csv", "id\n6\n")
    put(root, "1/csv/坏/b.csv", b"id\n\xff\xff\xff\n")
    return root


def test_raw_files(spark, raw):
    got = {r["path"]: (r["keyword"], r["year"], r["month"], r["day"]) for r in files.raw_files(spark, str(raw)).collect()}
    assert got == {"1/csv/躺平/2024/01/01.csv": ("躺平", 2024, 1, 1), "1/csv/摆烂/a.csv": ("摆烂", 9999, 99, 99), "1/csv/坏/b.csv": ("坏", 9999, 99, 99)}
    rows = files.read_raw_csv(files.raw_files(spark, str(raw)))
    assert {(r["id"], r["微博正文"]) for r in rows.where("error is null and keyword = '躺平'").collect()} == {("1", "第一条 https://t.cn/x"), ("2", "带\n换行"), ("2", "重复"), ("", "没有号"), ("4", "短")}
    assert rows.where("error is not null").count() == 1


def test_incremental_is_full(spark, raw, tmp_path):
    one = Collection(spark, str(tmp_path / "one"))
    report = one.run(str(raw))
    assert report["id_dedup"] == {"incoming_rows": 7, "missing_id_rows": 1, "batch_dedup_removed": 1, "existing_dedup_removed": 0, "appended_rows": 5} and report["failed_files"] == 1
    assert one.status() == {"merged": 5, "preprocessed": 3, "text_dedup": 2} or one.status()["merged"] == 5
    again = one.run(str(raw))
    assert again["files"] == 1 and again["id_dedup"]["appended_rows"] == 0  # the broken file is tried again
    put(raw, "1/csv/躺平/2024/02/03.csv", "id,微博正文\n1,又来\n11,新的内容\n")
    assert one.run(str(raw))["id_dedup"] == {"incoming_rows": 2, "missing_id_rows": 0, "batch_dedup_removed": 0, "existing_dedup_removed": 1, "appended_rows": 1}
    two = Collection(spark, str(tmp_path / "two"))
    two.run(str(raw))
    for name in ("merged", "text_dedup"):
        columns = ["id", "keyword", "source_file"]
        assert sorted(map(tuple, one.table(name).select(*columns).collect())) == sorted(map(tuple, two.table(name).select(*columns).collect()))
    assert one.export("merged", str(tmp_path / "out"))["merged"] == 6 and (tmp_path / "out/merged.csv").read_bytes().startswith(b"\xef\xbb\xbfid,")
    one.run(str(raw), rebuild=True)
    assert one.status()["merged"] == 6


@pytest.mark.parametrize("last", ["merged", "text_dedup", "seen_texts"])
def test_a_run_that_breaks_off(spark, raw, tmp_path, last):
    """Whatever was written before the crash, the next run gives the same tables."""
    sound = Collection(spark, str(tmp_path / "sound"))
    sound.run(str(raw))

    class Broken(Collection):
        def _write(self, df, name, batch):
            super()._write(df, name, batch)
            if name == last:
                raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Broken(spark, str(tmp_path / "one")).run(str(raw))
    spark.catalog.clearCache()
    one = Collection(spark, str(tmp_path / "one"))
    assert one.finished() == 0
    one.run(str(raw))
    for name in ("merged", "preprocessed", "text_dedup", "seen_ids", "seen_texts"):
        assert sorted(map(str, one.table(name).collect())) == sorted(map(str, sound.table(name).collect()))


def test_preprocess(spark):
    df = spark.createDataFrame([("😀",), ("x",), ("y" * 2500,), (None,)], "`微博正文` string")
    got = sorted((len(r["cleaned_text"]), r["cleaned_text_with_emoji"][:10]) for r in preprocess(df).collect())
    assert got == [(7, ":grinning_"), (2000, "y" * 10)]


def test_analysis_base(spark):
    rows = [("好文", "2024-05-01 10:00", "#躺平#", "IP属地：北京", "1.9", "0.9"), ("x", "bad", "躺平学", None, "1", "0.2"), ("y", "2024-05-01", "别的", "上海", "1", "0.9"), (" ", "2024-05-01", "躺平", "上海", "1", "0.9"), ("z", "2024-05-01", "躺平", "上海", "no", "0.9")]
    df = spark.createDataFrame(rows, "cleaned_text string, `发布时间` string, keyword string, ip string, pred_label string, pred_prob_1 string")
    got = base.analysis_base(df, min_confidence=0.5).collect()
    assert [(r["analysis_text"], r["keyword_normalized"], r["ip_normalized"], r["year_quarter"]) for r in got] == [("好文", "躺平", "北京", "2024Q2")]
    assert base.analysis_base(df, positive_only=False).count() == 3
    assert base.before_month_end(base.with_time(df, "发布时间"), "2024-04").count() == 0 and base.before_month_end(base.with_time(df, "发布时间"), "2024-05").count() == 4


def test_lists_rules_and_reports(spark, tmp_path):
    (tmp_path / "terms.txt").write_text(" a \n\n# note\nb\na\n")
    (tmp_path / "rules.json").write_text(json.dumps({"theme_buckets": [{"bucket": "m", "markers": ["x", " "]}], "context_buckets": []}))
    (tmp_path / "o.csv").write_text("keyword,period_label,term,override_context_bucket,override_theme_bucket,enabled,note\nk,,t,b,,1,n\nk,,t,c,,0,n\nk,,t,,,1,n\n")
    (tmp_path / "c.toml").write_text("top = 1\n[labeler]\nmodel = 'm'\n[fixer]\nmodel = 'f'\n")
    assert sorted(r[0] for r in files.term_list(spark, str(tmp_path / "terms.txt"), comments=True).collect()) == ["a", "b"]
    assert [tuple(r) for r in files.bucket_rules(spark, str(tmp_path / "rules.json")).collect()] == [("theme_buckets", 0, "m", ["x"])]
    assert [r["override_context_bucket"] for r in files.bucket_overrides(spark, str(tmp_path / "o.csv")).collect()] == ["b"]
    assert files.config(str(tmp_path / "c.toml")) == {"top": 1, "model": "m", "fixer_model": "f"}
    assert files.read_or_empty(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    assert files.workbook_layout([["id", "text"], ["1", "a"]], ["id", "text", "label"]) == (0, ["id", "text"])  # two known names are no header
    assert files.workbook_layout([["title"], ["ID", "Text", "Label"], ["1", "a", "b"]], ["id", "text", "label"]) == (2, ["id", "text", "label"])
    df = spark.createDataFrame([(1, "a|b")], "n int, t string")
    assert "a\\|b" in sinks.markdown(df, "T") and "<td>a|b</td>" in sinks.html({"T": df})
    sinks.save_json(str(tmp_path / "d/r.json"), {"a": 1})
    assert files.read_json(str(tmp_path / "d/r.json")) == {"a": 1}


def test_labelling_client(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id long, text string")

    def client():
        def ask(prompt):
            if prompt == "bad":
                raise OSError("no service")
            return '{"tangping_related_label": "相关", "confidence": "高"}' if prompt else "mess"

        return ask

    fixed = lambda: lambda raw: '{"tangping_related_label": "无关", "confidence": "低", "exclusion_type": "宠物"}'
    got = {r["id"]: (r["label"], r["exclusion"], r["problem"]) for r in ml.label_posts(df, client, lambda t: t).collect()}
    assert got == {1: ("相关", "无", ""), 2: ("无关", "其他", "not_object"), 3: ("无关", "其他", "not_object")}
    got = {r["id"]: (r["label"], r["exclusion"], r["problem"]) for r in ml.label_posts(df, client, lambda t: t, make_fixer=fixed).collect()}
    assert got == {1: ("相关", "无", ""), 2: ("无关", "宠物日常", ""), 3: ("无关", "宠物日常", "")}


def test_topics(spark):
    rows = [(k, [float(k % 2), float(1 - k % 2), 0.01 * k]) for k in range(40)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ml.topics(e, k=2, reduced=2, min_size=5)
    assert {r["topic_id"] for r in got.collect()} <= {-1, 0, 1} and got.count() == 40
    adopted = ml.adopt_outliers(got.withColumn("topic_id", F.when(F.col("vec_id") == 3, -1).otherwise(F.col("topic_id"))), e)
    assert adopted.where("topic_id = -1").count() == 0 and adopted.where("vec_id = 3").first()["topic_probability"] is None


def test_stream_appends_each_text_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "id long, text string"
    for k, rows in enumerate(([(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream.append_new(stream.document_stream(spark, source, schema), "text", state, target, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(target).select("text").distinct().count() == spark.read.parquet(target).count() == 2 + k


def test_mixed_tables(spark, tmp_path):
    """Parquet and CSV of one pattern by column name; other kinds and empty patterns are errors."""
    spark.createDataFrame([(1, "a")], "id long, text string").coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    (tmp_path / "two.csv").write_text("text,id,more\nb,2,x\n")
    got = files.read_tables(spark, str(tmp_path / "*"))
    assert sorted((r["id"], r["text"], r["more"]) for r in got.collect()) == [("1", "a", None), ("2", "b", "x")] and all(r["__input_file"] for r in got.collect())
    assert files.read_tables(spark, str(tmp_path / "two.*")).columns == ["text", "id", "more", "__input_file"]
    with pytest.raises(FileNotFoundError):
        files.read_tables(spark, str(tmp_path / "none*"))
    (tmp_path / "three.txt").write_text("x")
    with pytest.raises(ValueError):
        files.read_tables(spark, str(tmp_path / "*"))


def test_tables_of_any_column_order(spark, tmp_path):
    """Three orders, missing and extra columns, quotes, marks and odd names in CSV files, and Parquet files of other types."""
    root = tmp_path / "in put 话+题"
    root.mkdir()
    (root / "a.csv").write_text("id,text,keyword\n1,hello,k1\n")
    (root / "b.csv").write_text("\ufeffkeyword,id,text\nk2,2,world\n", encoding="utf-8")
    (root / "c.csv").write_text('id,extra,text\r\n3,x,"a ""quoted"", \nline"\r\n')
    (root / "d.csv").write_text('"two\nlines",id,id,\nv,4,5,6\n')
    (root / "e.csv").write_text("")
    (root / "f.csv").write_text("id,text,keyword\n7,again,k7\n")
    spark.createDataFrame([(8, 1.5)], "id long, score double").coalesce(1).write.parquet(str(root / "p.parquet"))
    spark.createDataFrame([("9", 2)], "id string, score long").coalesce(1).write.parquet(str(root / "q.parquet"))
    got = files.read_tables(spark, str(root / "*"))
    rows = {r["id"]: r.asDict() for r in got.collect()}
    pick = lambda k, *c: tuple(rows[k][x] for x in c)
    assert len(rows) == 7 and all(pick(k, "text", "keyword", "extra") == v for k, v in {"1": ("hello", "k1", None), "2": ("world", "k2", None), "3": ('a "quoted", \nline', None, "x"), "7": ("again", "k7", None), "8": (None,) * 3}.items())
    assert pick("4", "two\nlines", "id__2", "unnamed_4") == ("v", "5", "6")
    assert (rows["8"]["score"], rows["9"]["score"]) == ("1.5", "2")
    assert rows["2"]["__input_file"] == str(root / "b.csv") and rows["8"]["__input_file"].startswith(str(root / "p.parquet"))
    import gzip

    (root / "g.csv.gz").write_bytes(gzip.compress(("x" * 40_000 + ",id\nlong header,10\n").encode()))
    assert files.read_tables(spark, str(root / "g*")).columns == ["x" * 40_000, "id", "__input_file"]
    assert files.read_tables(spark, str(root / "e*")).collect() == []


def test_only_changed_files_are_opened(spark, raw, tmp_path):
    """A file whose size and time are as before isn't read, even if its bytes are others; names may hold pattern characters."""
    import os

    put(raw, "1/csv/躺平/[a]{b}*?/x.csv", "id,微博正文\n21,甲\n")
    one = Collection(spark, str(tmp_path / "one"))
    one.run(str(raw))
    before = raw / "1/csv/躺平/2024/01/01.csv"
    stat, data = before.stat(), before.read_bytes()
    before.write_bytes(b"\xff" * len(data))
    os.utime(before, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    put(raw, "1/csv/躺平/[a]{b}*?/y.csv", "id,微博正文\n22,乙\n")
    report = one.run(str(raw))
    assert report["files"] == 2 and report["failed_files"] == 1 and report["id_dedup"]["appended_rows"] == 1
    listed = files.raw_files(spark, str(raw)).drop("content")
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString()
    assert {r["path"] for r in listed.collect()} >= {"1/csv/躺平/[a]{b}*?/x.csv", "1/csv/躺平/[a]{b}*?/y.csv"}


def test_large_files_are_read_as_streams(spark, raw):
    put(raw, "1/csv/躺平/more.csv", 'ip,id,微博正文,id\nNA,31,"a ""b"", c",x\nz,32\n\n1,2,3,4,5\n,33,"two\nlines",\n')
    sound = files.raw_files(spark, str(raw)).where("keyword <> '坏'")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(files.read_raw_csv(sound, large=0)) == plain(files.read_raw_csv(sound))


def test_a_header_in_the_second_row(spark, tmp_path):
    plain = [["id", "text", None, "text"], ["1", "a", "b", "c"]]
    assert files.promoted_header(plain) == (1, ["id", "text", "unnamed_2", "text__2"])
    assert files.promoted_header([["title", None, None], ["ID", " Broad", "label"], ["1", "1", "0"]]) == (2, ["ID", "Broad", "label"])
    assert files.promoted_header([["title", None, None], ["id", "id", "label"]]) == (1, ["title", "unnamed_1", "unnamed_2"])  # two known names are none
    assert files.promoted_header([]) == (0, []) and files.promoted_header([["a"]]) == (1, ["a"])
    (tmp_path / "x.csv").write_text("id,label\n1,0\n")
    assert [tuple(r) for r in files.labelled_table(spark, str(tmp_path / "x.csv")).collect()] == [("1", "0")]
    with pytest.raises(ValueError):
        files.labelled_table(spark, str(tmp_path / "x.txt"))
