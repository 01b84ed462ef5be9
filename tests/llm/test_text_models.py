import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import langid, quality
from corpusloom.llm.bpe import PairIndexBPE, decode, default_tokenizer, encode, op4_bpe
from corpusloom.llm.common import labelled_sample
from corpusloom.llm.langid import CodedLanguages, codewords, languages, op7_langid, recognised
from corpusloom.llm.quality import CHUNK, ByteConvNet, chunks_of, good_documents, op5_quality, quality_scores


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def own():
    with open(default_tokenizer(), "rb") as f:
        return PairIndexBPE(f.read())


def odd_texts():
    rng = random.Random(1)
    pools = ["ab aaa'sll  \n\t", "äöüßéñ中文𝐀😀​　\xa0 \x1c\x1d\x85̀", "0129²Ⅷ٣'reve ", "\r\n\x0b\x0c\x00"]
    make = lambda: "".join(rng.choice(rng.choice(pools)) if rng.random() < 0.9 else "<|endoftext|>" for _ in range(rng.randrange(60)))
    return [make() for _ in range(1500)] + ["", "a" * 3000, " " * 300, "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]


def test_bpe_is_the_library(library, own):
    texts = odd_texts()
    got = own.encode_batch(texts)
    for t, ids in zip(texts, got, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want and own.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert own.decode(np.array([own.start[255], own.start[97]])) == library.decode([int(own.start[255]), int(own.start[97])], skip_special_tokens=False)


def test_bpe_slices_and_forgetting(monkeypatch, library, own):
    from corpusloom.llm import bpe

    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(bpe, "MOST_PIECES", 20)
    for t in ["some words of a text, " * 40, "日本語 " * 60, "a" * 200]:
        (ids,) = own.encode_batch([t])
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
    own.forget()


def test_bpe_query_and_odd_documents(spark, sf, library, odd_documents, no_documents):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op4_bpe(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    out = encode(odd_documents, default_tokenizer())
    back = decode(out, default_tokenizer())
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in odd_documents.collect())
    assert encode(no_documents, default_tokenizer()).count() == 0


def test_chunks_cover_whole_texts():
    texts = [b"", b"x", bytes(range(256)) * 20, b"y" * CHUNK]
    chunks, owner = chunks_of(texts)
    for k, t in enumerate(texts):
        own = chunks[owner == k]
        joined = b"".join([own[0].tobytes()] + [c[quality.OVERLAP :].tobytes() for c in own[1:]])
        assert joined.rstrip(b"\0") == t.rstrip(b"\0") and len(joined) >= len(t)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op5_quality(spark, sf).collect()
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > 0.93
    assert all(r["predicted"] for r in held if marks[r["doc_id"]] == 1)


def test_quality_odd_documents(spark, odd_documents, no_documents):
    net = ByteConvNet.fit([b"good words here", b"#### $$$$ %%%%"] * 20, [1, 0] * 20)
    rows = quality_scores(odd_documents, net).collect()
    score = {r["doc_id"]: r["score"] for r in rows}
    assert len(rows) == odd_documents.count() and score[3] == score[4] and score[5] == score[6] and score[1] == score[9]
    assert quality_scores(no_documents, net).count() == 0 and good_documents(odd_documents, net, 0.0).columns == odd_documents.columns
    assert ByteConvNet.fit([], []).scores([b"", b"x"]).tolist() == [0.5, 0.5] and ByteConvNet.fit([b"a"], [1]).scores([b"z"])[0] > 0.99


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        code = codewords(n)
        assert len(code) == n and min((code[a] != code[b]).sum() for a in range(n) for b in range(a)) >= 1
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_langid(spark, sf).collect()
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]) > 0.98


def test_parts_of_a_text_are_counted_as_the_whole(monkeypatch):
    """Letters, marks of several bytes, capitals that grow in lower case and a final sigma at the seams."""
    text = "Straße ΟΔΟΣ, İstanbul 日本語 zwei\n" * 40
    whole = langid.shares(text)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "PART", size)
        assert np.array_equal(langid.shares(text), whole) and np.array_equal(langid.shares(""), np.zeros(langid.SLOTS, np.float32))
    monkeypatch.undo()
    long = text * 2500
    monkeypatch.setattr(langid, "PART", 1 << 30)
    once = langid.shares(long)
    monkeypatch.undo()
    assert len(long) > 3_000_000 and np.array_equal(langid.shares(long), once)


def test_language_odd_documents(spark, odd_documents, no_documents):
    model = CodedLanguages.fit(["the words of it", "die Worte und das", "les mots de la"] * 10, ["en", "de", "fr"] * 10)
    rows = languages(odd_documents, model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_documents.count() and all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (3, 4, 7)) and by[8]["lang_pred"] != "und"
    assert languages(no_documents, model).count() == 0 and recognised(odd_documents, model).columns == odd_documents.columns
    nothing = langid.fit_languages(no_documents)
    assert nothing.predict(["text", None]) == [("und", 0.0, False)] * 2
    assert CodedLanguages.fit(["a"], ["en"]).predict(["text"])[0][:2] == ("en", 1.0)


def test_sample_of_many_labels(spark):
    """Of many labels fewer rows each; more labels than a classifier is learned for are an error."""
    rows = [(k, f"l{k % 40}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string")
    some = labelled_sample(df, "doc_id", "lang", 50, 200)
    counts = [sum(r["lang"] == f"l{k}" for r in some) for k in range(40)]
    assert max(counts) <= 6 and 150 <= sum(counts) <= 250 and len(labelled_sample(df, "doc_id", "lang", 50)) > 1500
    assert labelled_sample(df.limit(0), "doc_id", "lang", 50) == []
    with pytest.raises(ValueError):
        labelled_sample(df.withColumn("lang", df.doc_id.cast("string")), "doc_id", "lang", 50)
