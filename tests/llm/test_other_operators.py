import gzip
import hashlib
import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import media, token_counts, warc
from corpusloom.llm.fracsketch import SCALE, TOP, containment, likeness, merged, neighbour_fingerprints, op6_fingerprints, with_next, with_sketch
from corpusloom.llm.packing import boundaries, op2_packing, packed


def test_boundaries_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        count = rng.integers(1, 30, len(lengths))
        for k in (1, 2, 3, 12):
            cost = lambda cuts: sum(c * (min(b for b in cuts if b >= n) - n) for n, c in zip(lengths, count, strict=True))  # noqa: E731, B023
            best = min(cost([*some, lengths[-1]]) for r in range(min(k, len(lengths))) for some in itertools.combinations(lengths[:-1], r))
            got = boundaries(lengths, count, lengths * count, k)
            assert got[-1] == lengths[-1] and len(got) <= k and cost(got) == best


def plain_padding(length, count, buckets):
    """Least padding by the plain recursion over every length."""
    rows, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * length)])
    best = np.full(len(length) + 1, np.inf)
    best[0], answer = 0, np.inf
    for _ in range(buckets):
        best = np.array([np.inf] + [(best[:j] + length[j - 1] * (rows[j] - rows[:j]) - (mass[j] - mass[:j])).min() for j in range(1, len(length) + 1)])
        answer = min(answer, best[-1])
    return int(answer)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_padding_is_the_least(spark, sf):
    """Of the whole query, over every length that occurs, however large."""
    got = op2_packing(spark, f"/root/testdata/{sf}").select("n_tokens", "padding").toPandas()
    length, count = np.unique(got.n_tokens.to_numpy(), return_counts=True)
    assert length.max() > 1000 and got.padding.sum() == plain_padding(length, count, 16)


def test_boundaries_of_a_million_lengths():
    rng = np.random.default_rng(1)
    length = np.cumsum(rng.integers(1, 3, 1_000_000))
    count = rng.integers(1, 100, len(length))
    bounds = boundaries(length, count, length * count, 4)
    best = lambda b: int((count * (np.array(b)[np.searchsorted(b, length)] - length)).sum())
    assert len(bounds) == 4 and all(best([*bounds[:k], length[np.searchsorted(length, bounds[k]) + d], *bounds[k + 1 :]]) >= best(bounds) for k in range(3) for d in (-1000, -1, 1, 1000))


def test_packing_is_the_same_on_every_cluster(spark, sf):
    """Batches and slots don't depend on shuffle partitions, and a repeated id is cut into runs."""
    rows = [(None, 7)] * 9000 + [(k, k % 50) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").repartition(5)
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(tuple, packed(df, budget=200).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] and len(got[0]) == 9500
    check_packed(packed(df, budget=200).collect(), 200)


def check_packed(rows, budget):
    batches = {}
    for r in rows:
        assert 0 <= r["n_tokens"] <= r["bucket_length"] and r["padding"] == r["bucket_length"] - r["n_tokens"]
        batches.setdefault(r["batch_id"], []).append(r)
    for some in batches.values():
        assert sorted(r["slot"] for r in some) == list(range(len(some))) and {r["batch_rows"] for r in some} == {len(some)} and len({r["bucket"] for r in some}) == 1
        assert len(some) == 1 or len(some) * some[0]["bucket_length"] <= budget
    for bucket in {r["bucket"] for r in rows}:
        sizes = sorted((len(b) for b in batches.values() if b[0]["bucket"] == bucket), reverse=True)
        assert len(set(sizes[:-1])) <= 1  # only the last batch of a bucket is short


def test_packing(spark, sf, odd_documents, no_documents):
    rows = op2_packing(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {d: len(t.split()) for d, t in texts.items()}
    check_packed(rows, 16_384)
    odd = packed(odd_documents, F.length("text"), budget=100).collect()
    assert len(odd) == odd_documents.count() and max(r["n_tokens"] for r in odd) == 540_000
    check_packed(odd, 100)
    assert packed(no_documents, F.length("text")).count() == 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_fingerprints(spark, sf):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in op6_fingerprints(spark, sf).collect()}
    off, seen = [], {}
    for k, (d, text) in enumerate(rows):
        after, n, r = rows[(k + 1) % len(rows)][1], len(text), got[d]
        edited = text[: n - n // 4] + after[: n // 4]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        a, b = shingles(text), shingles(edited)
        off.append(abs(r["near_edited"] - len(a & b) / len(a | b)))
    assert len(got) == len(rows) and np.mean(off) < 0.08


def test_sketches_merge_and_estimate(spark):
    words = [f"w{k}" for k in range(4000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:2000])), (3, " ".join(words[2000:])), (4, " ".join(words[:30])), (5, "x"), (6, "")]
    df = with_sketch(spark.createDataFrame(rows, "id long, text string"), "text", "s").select("id", "s", "s_limit")
    pair = lambda i, j: df.where(F.col("id") == i).select(F.col("s").alias("a"), F.col("s_limit").alias("a_limit")).join(df.where(F.col("id") == j).select(F.col("s").alias("b"), F.col("s_limit").alias("b_limit")))
    one = lambda i, j, c: pair(i, j).select(c).first()[0]
    assert one(2, 1, containment("a", "b")) > 0.98 and one(4, 1, containment("a", "b")) > 0.8 and 0.4 < one(1, 2, containment("a", "b")) < 0.6 and 0.4 < one(1, 2, likeness("a", "b")) < 0.6
    assert one(1, 1, likeness("a", "b")) == 1 and one(5, 6, likeness("a", "b")) == 0
    whole, union = set(df.where("id = 1").first()["s"]), set(one(2, 3, merged("a", "b")))
    assert union <= whole and len(whole - union) <= 4  # shingles across the middle


@pytest.mark.parametrize("parts", [1, 7, 300])
def test_next_of_hot_ids(spark, parts):
    """Null ids, an id that many rows have, and repeated rows: ranges of hashes give the same order as one sort."""
    rows = [(None, f"n{k % 90}") for k in range(130)] + [(40, f"h{k}") for k in range(200)] + [(k, f"t{k}") for k in range(-20, 80)] + [(79, "t79")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(((r["doc_id"], r["h"], r["text"]) for r in df.withColumn("h", F.xxhash64("text")).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    got = [(r["doc_id"], r["text"], r["next_text"]) for r in with_next(df, ["text"], parts).collect()]
    assert sorted(got, key=repr) == sorted(((d, t, want[(k + 1) % len(want)][2]) for k, (d, _, t) in enumerate(want)), key=repr)


def test_sketches_of_a_fixed_fraction(spark):
    """With `least` 0 a hash is kept if it is below the fraction, whatever the text; the sketch of a union is the union of sketches."""
    words = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:7])), (3, " ".join(words[7:])), (4, "")]
    got = {r["id"]: r for r in with_sketch(spark.createDataFrame(rows, "id long, text string"), "text", "s", least=0).collect()}
    assert {r["s_limit"] for r in got.values()} == {TOP // SCALE} and all(h < TOP // SCALE for r in got.values() for h in r["s"])
    assert set(got[2]["s"]) | set(got[3]["s"]) <= set(got[1]["s"])


def test_fingerprints_of_odd_documents(odd_documents, no_documents):
    got = neighbour_fingerprints(odd_documents).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd_documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = sorted((d is not None, d or 0, t[: len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][: len(t) // 4]) for k, (d, t) in enumerate(rows))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["edited"]) for r in got) == want
    assert neighbour_fingerprints(no_documents).count() == 0
    single = neighbour_fingerprints(odd_documents.where("doc_id = 1")).first()
    assert single["sketch"] == single["next_sketch"]


def crc(data, polynomial, bits):
    x = 0
    for byte in data:
        x ^= byte << (bits - 8)
        for _ in range(8):
            x = ((x << 1) ^ (polynomial if x >> (bits - 1) else 0)) & ((1 << bits) - 1)
    return x


def flac(frames=3, samples=None, largest=0):
    """Frames of 16 equal 8-bit samples."""
    total = 16 * frames if samples is None else samples
    info = struct.pack(">HH", 16, 16) + bytes(3) + largest.to_bytes(3, "big") + ((8000 << 44) | (7 << 36) | total).to_bytes(8, "big") + bytes(16)
    out = b"fLaC\0\0\0\x22" + info + b"\x81\0\0\5pad.."
    for k in range(frames):
        head = b"\xff\xf8\x60\0" + bytes([k]) + b"\x0f"
        body = head + bytes([crc(head, 0x07, 8)]) + b"\0" + bytes([40 + k])
        out += body + crc(body, 0x8005, 16).to_bytes(2, "big")
    return out


def ogg(pages=3):
    out = b""
    for k in range(pages):
        data = bytes([k]) * 300
        page = b"OggS\0" + bytes([2 * (k == 0) + 4 * (k == pages - 1)]) + struct.pack("<QIII", k, 7, k, 0) + b"\2\xff\x2d" + data
        out += page[:22] + struct.pack("<I", crc(page, 0x04C11DB7, 32)) + page[26:]
    return out


def zipped(inner=b"hello"):
    import io
    import zipfile

    with io.BytesIO() as f:
        with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
            z.writestr("a", inner)
            z.writestr("b.txt", b"x" * 40)
        return f.getvalue()


def riff(kind, *chunks):
    body = kind + b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for n, c in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def samples():
    chunk = lambda n, c: struct.pack(">I", len(c)) + n + c + struct.pack(">I", zlib.crc32(n + c))
    return {
        "image/png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"xy") + chunk(b"IEND", b""),
        "image/gif": b"GIF89a" + b"\1\0\1\0\x80\0\0" + bytes(6) + b"\x2c" + bytes(8) + b"\0" + b"\2\2\x4c\1\0" + b"\x3b",
        "image/bmp": b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(24) + b"abcd",
        "image/jpeg": b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\2\1\2\xff\0\3\xff\xd9",
        "image/webp": riff(b"WEBP", (b"VP8 ", b"odd")),
        "video/x-msvideo": riff(b"AVI ", (b"LIST", b"hdrl"), (b"idx1", b"")),
        "application/gzip": gzip.compress(b"hello" * 100),
        "application/pdf": b"%PDF-1.4 startxref 0 %%EOF",
        "application/zip": zipped(),
        "audio/midi": b"MThd\0\0\0\6\0\0\0\1\0\0MTrk\0\0\0\1x",
        "audio/wav": media.wav(b"abcd"),
        "audio/flac": flac(),
        "audio/ogg": ogg(),
    }


@pytest.mark.parametrize("kind", list(samples()))
def test_sniffing(kind):
    data = samples()[kind]
    assert (6, len(data), kind) in media.sniff(b"..BM.." + data + b"GIF89a tail")
    for cut in range(8, len(data)):  # cut off, it is no such item
        assert not any(at == 0 and n > cut for at, n, _ in media.sniff(data[:cut]))
    assert len({k for _, k, _ in media.FORMATS} | set(media.RIFF_TYPES.values())) - 1 == len(samples()) == 13


def test_structure_is_confirmed():
    """Items whose checksums or lengths are wrong are none; lengths are those of the items, whatever follows."""
    for kind, good, at in (("audio/flac", flac(), 55), ("audio/flac", flac(), -1), ("audio/ogg", ogg(), 40), ("audio/ogg", ogg(), -1)):
        bad = bytearray(good)
        bad[at] ^= 1
        assert (0, len(good), kind) in media.sniff(good + b"tail" * 99) and (0, len(good), kind) not in media.sniff(bytes(bad))
    for data in (flac(largest=12), flac(samples=0), flac(1)):
        assert [(0, len(data), "audio/flac")] == media.sniff(data + b"tail")
    assert not media.sniff(flac(samples=1000)) and not media.sniff(flac()[:50] + b"x" * 500)
    updated = b"%PDF-1.4 startxref 0 %%EOF more startxref 9 %%EOF"
    assert media.sniff(updated + b" and " + updated) == [(0, len(updated), "application/pdf"), (len(updated) + 5, len(updated), "application/pdf")]
    outer = zipped(zipped())
    found = media.sniff(b"....." + outer + b"....")
    assert found[0] == (5, len(outer), "application/zip") and (outer.index(zipped()) + 5, len(zipped()), "application/zip") in found


@pytest.mark.parametrize("piece", [b"PK\3\4abc", b"%PDF-1\n", b"GIF89a0123456!!", b"GIF89a", b"BMRIFF", b"OggS\0\2", b"fLaC", b"MThd\0\0\0\6", b"\xff\xd8\xff\xe0\0\2", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR", b"\x1f\x8b\x08\0"])
def test_repeated_magic_costs_no_more(piece):
    import time

    data = piece * (600_000 // len(piece))
    began = time.process_time()
    media.sniff(data)
    assert time.process_time() - began < 4


def plain_riff(b, at):
    if len(b) < at + 12:
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    if b[at + 8 : at + 12] not in media.RIFF_TYPES or at + size > len(b) or size < 20:
        return 0
    p = at + 12
    while p + 8 <= at + size:
        n = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + n + n % 2
    return size if p == at + size else 0


def plain_midi(b, at):
    if len(b) < at + 14 or b[at + 4 : at + 8] != b"\0\0\0\6":
        return 0
    tracks, p = struct.unpack_from(">H", b, at + 10)[0], at + 14
    for _ in range(tracks):
        if b[p : p + 4] != b"MTrk" or p + 8 > len(b):
            return 0
        p += 8 + struct.unpack_from(">I", b, p + 4)[0]
    return p - at if tracks and p <= len(b) else 0


def nested_riff(items, size, tail=b""):
    """Headers inside the chunks of headers before them; the sizes are those of the whole rest."""
    unit = lambda k: b"RIFF" + struct.pack("<I", max(12, size(k))) + b"WAVE" + b"fmt " + struct.pack("<I", 0)
    out = b""
    for k in range(items):
        out += b"data" + struct.pack("<I", 12) + unit(k)[:12]
    return b"RIFF" + struct.pack("<I", 4 + len(out)) + b"WAVE" + out + tail


def nested_midi(items, tracks):
    return b"".join(b"MTrk" + struct.pack(">I", 14) + b"MThd\0\0\0\6\0\1" + struct.pack(">H", tracks(k)) + b"\0`" for k in range(items))


def test_chains_are_followed_as_one_by_one():
    rng = np.random.default_rng(4)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        sizes, counts = rng.integers(0, 22 * n, n), rng.integers(0, n + 3, n)
        for data, plain, found, magic in ((nested_riff(n, lambda k: int(sizes[k]), b"xy"), plain_riff, media._riff, b"RIFF"), (nested_riff(n, lambda k: 20 * (n - k) - 8 - 8, b""), plain_riff, media._riff, b"RIFF"), (nested_midi(n, lambda k: int(counts[k])), plain_midi, media._midi, b"MThd")):
            v, places = media.Value(data), [k for k in range(len(data)) if data.startswith(magic, k)]
            for at in rng.permutation(places).tolist():
                assert found(v, at) == plain(data, at)


@pytest.mark.parametrize("kind", ["riff", "midi", "midi of one"])
def test_nested_headers_cost_no_more(kind):
    import time

    n = 600_000 // 22
    data = nested_riff(n, lambda k: 20 * (n - k) - 8) if kind == "riff" else nested_midi(n, lambda k: 9000 if kind == "midi" else 1)
    assert len(data) > 500_000
    began = time.process_time()
    media.sniff(data)
    assert time.process_time() - began < 4


def test_names_that_clash(spark):
    rows = spark.createDataFrame([(1, media.wav(bytes(64)), "x", 1.5, "m", "d")], "doc_id long, media binary, feature string, samples double, _media string, `_declared` string")
    out = media.sniffed_media(rows, declared_col="_declared", carry=("doc_id", "feature", "samples", "_media", "_declared"))
    (r,) = out.collect()
    assert len(set(out.columns)) == len(out.columns) == 12 and (r["feature"], r["samples"], r["_media"], r["_declared"], bytes(r["_samples"])) == ("x", 1.5, "m", "d", bytes(64)) and "type=audio/wav" in r["_feature"]


def test_media_round_trip(spark, sf, odd_documents, no_documents):
    rows = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in media.op8_media(spark, sf).collect():
        payload = media.pad(rows[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(rows[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] == len(media.wav(payload)) and r["media_sha256"] == hashlib.sha256(media.wav(payload)).hexdigest() and r["corrected"]
    odd = media.sniffed_media(media.stored_media(odd_documents)).collect()
    assert len(odd) == odd_documents.count() and {bytes(r["samples"]) for r in odd if r["doc_id"] in (3, 4)} == {bytes(64)}
    assert media.stored_media(no_documents).count() == 0
    mixed = spark.createDataFrame([(1, samples()["image/png"], "image/gif"), (2, None, "image/png"), (3, b"plain", "text/plain"), (4, media.wav(media.pad(samples()["image/gif"])), "audio/wav")], "doc_id long, media binary, declared string")
    got = {r["doc_id"]: r for r in media.sniffed_media(mixed).collect()}
    assert got[1]["media_type"] == "image/png" and got[1]["corrected"] and got[2]["media_type"] is None and got[3]["media_type"] == "text/plain" and not got[3]["corrected"]
    assert [(c["start"], c["media_type"]) for c in got[4]["carved"]] == [(44, "image/gif")]


def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_token_counts(spark, sf, odd_documents, no_documents):
    enc, sizes = token_counts.encoding(open(ranks(), "rb").read())
    text = "Überschrift\nerste Zeile 日本語\n\nletzte"
    first, last = token_counts.spans(enc, sizes, text)
    ids = enc.encode_ordinary(text)
    for a, b, k in zip(first, last, ids, strict=True):
        assert enc.decode_single_token_bytes(k) in text[a:b].encode() or len(text[a:b]) >= 1
    for rule in token_counts.RULES:
        rows = token_counts.token_counts(odd_documents, ranks(), ("text", "source"), rule=rule).collect()
        docs = {}
        for r in rows:
            docs.setdefault(r["doc_id"], []).append(r)
        assert all(abs(sum(r["n_tokens"] for r in v) / (2 if d == 2 else 1) - v[0]["doc_tokens"]) < 1e-9 for d, v in docs.items())
    assert token_counts.token_counts(no_documents, ranks()).count() == 0
    got = token_counts.op9_token_counts(spark, sf).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n"] for r in got} == {d: len(enc.encode_ordinary(t)) for d, t in texts.items()}


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "x" + "\t \u3000" * 400_000 + "y z", "word" + " " * 5000 + "'s\x1c" + "\n" * 3000 + "\n", "1" * 300_000 + "!" * 300_000, "é" * 200_000])
def test_very_long_pieces(text):
    """As many tokens as the encoder of the same vocabulary finds that has its own pattern and merges."""
    from corpusloom.llm.bpe import PairIndexBPE, default_tokenizer

    enc, sizes = token_counts.encoding(open(ranks(), "rb").read())
    own = PairIndexBPE(open(default_tokenizer(), "rb").read())
    ids = token_counts.encode(enc, text)
    assert b"".join(enc.decode_single_token_bytes(k) for k in ids).decode() == text
    assert [enc.decode_single_token_bytes(k) for k in ids] == [own.bytes[k] for k in own.encode_batch([text])[0].tolist()]
    first, last = token_counts.spans(enc, sizes, text)
    assert first[0] == 0 and last[-1] == len(text) and (np.diff(first) >= 0).all()


def test_allocation_against_a_loop():
    rng = np.random.default_rng(3)
    for _ in range(200):
        cut = np.sort(rng.integers(0, 40, 12))
        first, last = cut[:-1][np.diff(cut) > 0], cut[1:][np.diff(cut) > 0]
        starts = np.concatenate([[0], np.sort(rng.integers(0, 41, 6)), [40]])
        for rule in token_counts.RULES:
            want = np.zeros(len(starts) - 1)
            for a, b in zip(first, last, strict=True):
                inside = np.array([sum(lo <= c < hi for c in range(a, b)) for lo, hi in zip(starts[:-1], starts[1:], strict=True)])
                held = np.flatnonzero(inside)
                if rule == "split":
                    want += inside / inside.sum()
                else:
                    want[{"start": held[0], "end": held[-1], "majority": inside.argmax()}[rule]] += 1
            assert np.allclose(token_counts.allocate(first, last, starts, rule)[0], want), rule


def test_allocation_rules():
    first, last, starts = np.array([0, 2, 6]), np.array([2, 6, 8]), np.array([0, 3, 5, 5, 8])
    got = {rule: token_counts.allocate(first, last, starts, rule)[0].tolist() for rule in token_counts.RULES}
    assert got == {"start": [2, 0, 0, 1], "end": [1, 0, 0, 2], "majority": [1, 1, 0, 1], "split": [1.25, 0.5, 0, 1.25]}
    assert token_counts.allocate(first, last, starts, "start")[1].tolist() == [1, 1, 0, 1]


def test_audit_finds_exactly_what_differs(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    records = warc.archive(pages, ids_per_file=8).cache()
    bad = warc.decayed(records, 7)
    changed = {r["page_id"] for r in records.join(bad.withColumnRenamed("record", "other"), ["page_id", "file"]).where("record <> other").collect()}
    a, b = warc.Tree(records), warc.Tree(bad)
    assert changed and a.root() != b.root() and warc.Tree(records.repartition(3)).root() == a.root()
    ids = {(r["file"], r["ordinal"]): r["page_id"] for r in a.levels[0].collect()}
    found = warc.audit(a, b).collect()
    assert {ids[r["file"], r["ordinal"]] for r in found} == changed and {r["status"] for r in found} == {"corrupt"}
    assert warc.audit(a, a).count() == 0
    without = warc.Tree(records.where("page_id <> 3"))
    gone = warc.audit(a, without).collect()
    assert {r["status"] for r in gone} <= {"corrupt", "missing"} and sum(r["status"] == "missing" for r in gone) == 1 and {r["file"] for r in gone} == {1}
    assert sum(r["status"] == "extra" for r in warc.audit(without, a).collect()) == 1
    rows = warc.op10_warc_fixity(spark, sf).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(r["page_id"] for r in pages.collect())


def test_leaves_against_a_loop(spark, monkeypatch):
    """Offsets and hashes are those of files written one record after another; repeats are one leaf."""
    rng = np.random.default_rng(5)
    rows = [(int(k), "u", "x" * int(n)) for k, n in zip(rng.integers(-9, 9, 120), rng.integers(0, 4, 120), strict=True)] + [(None, "u", f"{k % 40}") for k in range(90)] + [(3, "v", str(k)) for k in range(300)]
    records = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), ids_per_file=4).cache()
    files = {}
    for r in records.collect():
        files.setdefault(r["file"], []).append((r["page_id"] or 0, hashlib.sha256(r["record"]).hexdigest(), len(r["record"]), r["page_id"]))
    assert {f: {k[3] if k[3] is None else k[3] // 4 for k in v} for f, v in files.items()} == {f: {None if f == 0 else (f - 1) // 2 if f % 2 else -f // 2} for f in files}
    want = []
    for f, held in files.items():
        at = 0
        held.sort(key=lambda r: r[:2])
        for n, (_, digest, size, page) in enumerate(held):
            if n and held[n - 1][:2] == held[n][:2]:
                want[-1][4] += size
                want[-1][5] += 1
            else:
                want.append([f, n, page, at, size, 1, digest])
            at += size
    want = sorted(tuple([*w[:6], hashlib.sha256("|".join(map(str, ["leaf", w[3], w[4], w[5], w[6]])).encode()).hexdigest()]) for w in want)
    assert sorted((tuple(r) for r in warc.leaves(records).collect()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_root_is_the_same_on_every_cluster(spark, sf):
    """Neither shuffle partitions nor other files change a file's root."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    files = lambda t: {r["file"]: r["hash"] for r in t.top[0].select(F.col("ordinal").alias("file"), "hash").collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    tree = warc.Tree(warc.archive(pages, ids_per_file=8))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert warc.Tree(warc.archive(pages, ids_per_file=8)).root() == tree.root()
        few = files(warc.Tree(warc.archive(pages.where("page_id < 24"), ids_per_file=8)))
        assert few == {f: h for f, h in files(tree).items() if f in few} and len(few) == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_warc_of_odd_pages(spark):
    rows = [(1, "http://a", "<p>"), (1, "http://a", "<p>"), (None, None, None), (2, "x\r\ny", ""), (3, "u", "z" * 300_000)]
    records = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1)).withColumn("file", F.lit("f")))
    data = [bytes(r["record"]) for r in records.orderBy("page_id").collect()]
    parsed = list(warc.parse_warc(b"".join(data)))
    assert len(parsed) == 5 and [n for _, n, _, _ in parsed] == [len(d) for d in data] and sorted(len(b) for *_, b in parsed) == [0, 0, 3, 3, 300_000]
    files = spark.createDataFrame([("f", b"".join(data)), ("g", None)], "path string, content binary")
    assert warc.read_warc(files).count() == 5
    with pytest.raises(ValueError):
        list(warc.parse_warc(data[0][:-5]))
    empty = warc.Tree(warc.archive(spark.createDataFrame([], "page_id long, url string, html string")))
    assert empty.root() is None and warc.audit(empty, empty).count() == 0
    assert {r["status"] for r in warc.audit(warc.Tree(records), empty).collect()} == {"missing"} and {r["status"] for r in warc.audit(empty, warc.Tree(records)).collect()} == {"extra"}
    assert sorted((r["page_id"] or 0, r["copies"]) for r in warc.leaves(records).collect()) == [(0, 1), (1, 2), (2, 1), (3, 1)]
