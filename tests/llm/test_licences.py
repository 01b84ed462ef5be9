"""Licence scans against a search of every start of every template, with notices whole, edited, cut and repeated."""

import math
import random
import re

import numpy as np
import pytest

from corpusloom.llm import licences as L

FILLER = "the work of this and that code is here for any later use with a version 3 or 2 of some files license software copyright".split()


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def brute_base(text):
    ws, out = plain_words(text), []
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        out += [(label, k, k + len(p) - 1) for k in range(len(ws) - len(p) + 1) if ws[k : k + len(p)] == p]
    return sorted(out, key=lambda b: (b[1], b[0]))


def brute_found(text, rarity):
    """{template number: greatest weight} over all starts, with its key phrases inside."""
    ws, out = plain_words(text), {}
    for k, t in enumerate(L.TEMPLATES):
        want = plain_words(t.text)
        weight = [rarity[w] + 1e-9 for w in want]
        for d in range(-len(want), len(ws)):
            lo, hi = max(0, d - L.SLACK), max(0, d + len(want) + L.SLACK)
            near = lambda j: ws[max(0, d + j - L.SLACK) : max(0, d + j + L.SLACK + 1)]  # noqa: B023, E731
            share = sum(w for j, w in enumerate(weight) if want[j] in near(j)) / sum(weight)
            window = " " + " ".join(ws[lo:hi]) + " "
            if share >= L.LEAST and all(f" {' '.join(plain_words(key))} " in window for key in t.keys):
                out[k] = max(out.get(k, 0), share)
    return out


def texts():
    rng = random.Random(5)
    filler = lambda n: " ".join(rng.choice(FILLER) for _ in range(n))
    out = ["", None, "cc", "MIT LICENSE mit-license, mit  license", "cc by cc by\ncc BY", "gnu general public gnu general public license", filler(400), "é" * 50 + " apache\tlicense 日本語"]
    for t in L.TEMPLATES:
        ws = t.text.split()
        some = lambda: [w for w in ws if rng.random() > 0.06]  # noqa: B023, E731
        out += [t.text, f"{filler(60)}\n// {t.text.upper()}\n{filler(20)}", f"{filler(9)} {' '.join(some())} {filler(9)}", " ".join(ws[: len(ws) // 2]) + " " + filler(30), " ".join(f"{w} (c)" if rng.random() < 0.05 else w for w in ws), f"{t.text} " * 40]
    out.append(" ".join(t.text for t in L.TEMPLATES))
    return out


def counted(rows):
    n = len(rows)
    vocabulary = {w for t in L.TEMPLATES for w in plain_words(t.text)} | {w for p in L.PHRASES for w in p.split()}
    sets = [set(plain_words(t or "")) for t in rows]
    return {w: math.log((n + 1) / (sum(w in s for s in sets) + 1)) for w in vocabulary}


def test_equals_brute_force(spark):
    rows = texts()
    rarity = counted(rows)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(rows)], "doc_id long, text string, found string").repartition(5)
    got = {r["doc_id"]: r for r in L.licence_scan(df).collect()}
    assert len(got) == len(rows)
    hits = 0
    for k, text in enumerate(rows):
        assert got[k]["n_words"] == len(plain_words(text or ""))
        assert [tuple(p) for p in got[k]["places"]] == brute_base(text or "")
        want = brute_found(text or "", rarity)
        labels = [L.TEMPLATES[n].label for n in want]
        assert sorted(f["label"] for f in got[k]["found"]) == sorted(labels), text
        assert np.allclose(sorted(f["weight"] for f in got[k]["found"]), sorted(min(1, w) for w in want.values()))
        hits += len(want)
    assert hits > 100


def test_rarities_are_of_all_rows(spark):
    rows = texts()
    index = L.Index()
    want = counted(rows)
    got = L.rarities(spark.createDataFrame([(t,) for t in rows], "text string").repartition(7), index)
    assert np.allclose([got[index.ids[w.encode()]] for w in want], list(want.values()))


def test_pieces_change_nothing(monkeypatch):
    text = " ".join(t or "" for t in texts())
    whole = L.Index().numbers(text)
    for size in (1, 7, 1000):
        monkeypatch.setattr(L, "PIECE", size)
        assert np.array_equal(L.Index().numbers(text), whole)


def test_odd_rows_and_own_templates(spark, odd_documents, no_documents):
    assert L.licence_scan(no_documents).collect() == []
    rows = L.licence_scan(odd_documents, templates=(L.Template("lorem", "lorem ipsum dolor sit amet lorem", ("dolor sit",)),), phrases={"lorem ipsum": "l"}).collect()
    assert len(rows) == odd_documents.count()
    long = [r for r in rows if r["doc_id"] in (5, 6)]
    assert [len(r["places"]) for r in long] == [20_000] * 2 and all(r["found"][0]["weight"] == 1.0 for r in long)
    assert {r["doc_id"]: r["n_words"] for r in rows if r["doc_id"] in (3, 4, 7)} == {3: 0, 4: 0, 7: 0}


@pytest.fixture(scope="module")
def result(spark, sf):
    return L.op13_licence_scan(spark, sf)


def test_query(spark, sf, result):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = result.collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute_base(docs[r["doc_id"]])
        assert (r["n_words"], r["n_base"]) == (len(plain_words(docs[r["doc_id"]])), len(base))
        assert (r["first_word"], r["last_word"]) == ((min(b[1] for b in base), max(b[1] for b in base)) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({b[0] for b in base}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and list(r["labels"].split(",")) == sorted(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert any(set(r["labels"].split(",")) - set(r["base_labels"].split(",")) for r in rows)
