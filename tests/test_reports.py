import io
import urllib.error

import pytest

from corpusloom.operators import evaluation, report
from corpusloom.plans import clients, ml


def refuse(code):
    return urllib.error.HTTPError("u", code, "no", {}, io.BytesIO())


def test_clients_try_again():
    asked = []

    def send(url, payload, headers, timeout):
        asked.append((url, headers))
        if len(asked) < 3:
            raise refuse(503) if len(asked) == 1 else TimeoutError()
        return {"choices": [{"message": {"content": "yes"}}]}

    assert clients.HttpClient("http://x/", "m", "k", pause=0, send=send)("q") == "yes" and len(asked) == 3
    assert asked[0] == ("http://x/v1/chat/completions", {"Authorization": "Bearer k"})

    def broken(*_):
        raise refuse(400)

    with pytest.raises(urllib.error.HTTPError):
        clients.HttpClient("http://x", "m", pause=0, send=broken)("q")

    def old(url, payload, headers, timeout):
        if url.endswith("/api/chat"):
            raise refuse(404)
        return {"response": payload["prompt"].upper()}

    assert clients.client({"url": "http://x", "model": "m"}, send=old)("q") == "Q"


def test_reports(spark):
    rows = spark.createDataFrame([(k, "s", k % 2, (k // 2) % 2, 0.9) for k in range(8)], "doc_id long, source string, gold_label int, pred_label int, pred_confidence double")
    both = report.combined_predictions({"broad": evaluation.judged(rows), "strict": evaluation.judged(rows.where("doc_id < 4"))})
    bundle = report.run_bundle(both)
    assert {r["label_standard"]: (r["f1"], r["focus"]) for r in bundle["triage"].collect()} == {"broad": (0.5, "mixed_errors"), "strict": (0.5, "mixed_errors")}
    assert report.scorecard({"a": bundle["metrics"], "b": bundle["metrics"]}).count() == 16
    out = report.written_back(rows.select("doc_id"), spark.createDataFrame([(1, "x")], "doc_id long, y string"), "doc_id", ["y"])
    assert sorted((r["doc_id"], r["y"]) for r in out.collect())[1] == (1, "x") and out.count() == 8
    top = report.top_table(spark.createDataFrame([("m", "keep", 2, 1234, 12.345, "2024", 0.5)], "macro_topic string, report_action string, topic_n long, doc_n long, share_of_clustered_docs_pct double, peak_period string, peak_doc_share double"))
    assert tuple(top.first()) == ("m", "keep", 2, "1,234", "12.35%" if top.first()["share"] == "12.35%" else "12.34%", "2024", "50.00%")


def test_outliers_by_terms(spark):
    docs = spark.createDataFrame([(1, -1, ["a", "a", "b"]), (2, -1, ["z"]), (3, 1, ["a"])], "doc_id long, topic_id int, tokens array<string>")
    terms = spark.createDataFrame([(0, "a", 1.0), (1, "b", 1.0), (0, "c", 0.1)], "topic_id int, term string, term_weight double")
    assert {r["doc_id"]: r["topic_id"] for r in ml.adopt_outliers_by_terms(docs, terms).collect()} == {1: 0, 2: -1, 3: 1}
