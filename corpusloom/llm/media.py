"""Media columns: bytes stored as 8-bit PCM sound, types found by signature, embedded media carved out.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over the whole column value. A validator of
the format then reads its structure and lengths at each place found. A confirmed format at the start corrects the
declared type; confirmed ones further on are embedded media with a place and a length.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import id_and_text, table, unused

UNIT = 64
RATE = 8000
UNKNOWN = "application/octet-stream"


def pad(data: bytes) -> bytes:
    """The bytes, and zeros up to a positive multiple of UNIT."""
    return data + b"\0" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wav(samples: bytes) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples. Chunks of odd length are padded."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wav_samples(stored: bytes) -> bytes | None:
    """The samples of a file that `wav` could have written; None if it is no such file."""
    at, eight_bit = 12, False
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        return None
    while at + 8 <= len(stored):
        name, size = struct.unpack_from("<4sI", stored, at)
        if name == b"fmt " and size >= 16:
            kind, channels, *_, bits = struct.unpack_from("<HHIIHH", stored, at + 8)
            eight_bit = (kind, channels, bits) == (1, 1, 8)
        elif name == b"data":
            return stored[at + 8 : at + 8 + size] if eight_bit and at + 8 + size <= len(stored) else None
        at += 8 + size + size % 2
    return None


class Value:
    """One media value while it is looked through. What validators learn of a place is kept, so that magic bytes repeated all over a value cost no more than one pass over it."""

    def __init__(self, data: bytes):
        self.data = data
        self.places: dict[bytes, list[int]] = {}
        self.ends: dict[str, dict[int, int]] = {}
        self.chains: dict[str, dict[int, tuple[int, int, int]]] = {}

    def find_all(self, token: bytes) -> list[int]:
        """Where the token starts, in order."""
        if token not in self.places:
            self.places[token] = [m.start() for m in re.finditer(re.escape(token), self.data)]
        return self.places[token]

    def follow(self, kind: str, p: int, step) -> int:
        """Where the chain of blocks that starts at p ends, or 0 if it breaks; `step` gives (next block, whether the chain ends there), or None."""
        ends, path, out = self.ends.setdefault(kind, {}), [], 0
        while True:
            if p in ends:
                out = ends[p]
                break
            path.append(p)
            found = step(p)
            if found is None or found[0] > len(self.data):
                break
            p, over = found
            if over:
                out = p
                break
        ends.update(dict.fromkeys(path, out))
        return out

    def chain(self, kind: str, p: int, step) -> dict[int, tuple[int, int, int]]:
        """(next block, blocks to the end of the chain, a block further on to skip to) of each block from p on; `step` gives the next one or None.

        Skips lengthen as in a skew binary number, so any place or number of blocks ahead is found in logarithmic time.
        """
        known, path = self.chains.setdefault(kind, {}), []
        while p not in known:
            path.append(p)
            if (after := step(p)) is None:
                known[path.pop()] = (p, 0, p)
                break
            p = after
        for q in reversed(path):
            _, depth, skip = known[p]
            far, further = known[skip][1], known[known[skip][2]][1]
            known[q] = (p, depth + 1, known[skip][2] if depth - far == far - further else p)
            p = q
        return known


# Validators: length of a well-formed item of the format that starts at `at`, or 0.


def _riff(v: Value, at: int) -> int:
    b = v.data
    if len(b) < at + 12:
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    if b[at + 8 : at + 12] not in RIFF_TYPES or at + size > len(b) or size < 20:
        return 0

    def chunk(p: int):
        if p + 8 > len(b):
            return None
        n = struct.unpack_from("<I", b, p + 4)[0]
        return p + 8 + n + n % 2

    p, chain = at + 12, v.chain("riff", at + 12, chunk)
    while p < at + size and chain[p][1]:
        p = chain[p][2] if chain[p][2] <= at + size else chain[p][0]
    return size if p == at + size else 0


def _png(v: Value, at: int) -> int:
    b = v.data

    def chunk(p: int):
        if p + 12 > len(b):
            return None
        n, name = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        return p + 12 + n, name == b"IEND"

    return max(0, v.follow("png", at + 8, chunk) - at) if b[at + 8 : at + 16] == b"\0\0\0\x0dIHDR" else 0


def _gif(v: Value, at: int) -> int:
    b = v.data
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0
    part = lambda p: (p + 1 + b[p], b[p] == 0) if p < len(b) else None

    def block(p: int):
        if p >= len(b) or b[p] not in b"\x21\x2c\x3b":
            return None
        if b[p] == 0x3B:
            return p + 1, True
        if b[p] == 0x2C and p + 10 > len(b):
            return None
        end = v.follow("gif parts", p + 2 if b[p] == 0x21 else p + 11 + table(b[p + 9]), part)
        return (end, False) if end else None

    return max(0, v.follow("gif", at + 13 + table(b[at + 10]), block) - at) if len(b) >= at + 13 else 0


def _jpeg(v: Value, at: int) -> int:
    b = v.data

    def segment(p: int):
        if b[p : p + 2] == b"\xff\xd9":
            return p + 2, True
        if p + 4 > len(b) or b[p] != 0xFF or b[p + 1] in (0x00, 0xFF):
            return None
        mark, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return None
        p += 2 + n
        if mark == 0xDA:  # scan data up to a marker other than restart
            while 0 <= (p := b.find(b"\xff", p)) < len(b) - 1 and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7):
                p += 2
            if p < 0:
                return None
        return p, False

    return max(0, v.follow("jpeg", at + 2, segment) - at)


def _bmp(v: Value, at: int) -> int:
    b = v.data
    if len(b) < at + 54:
        return 0
    size, zero, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    ok = zero == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return size if ok and offset >= 14 + header and at + size <= len(b) and size >= offset + row * abs(height) > 54 else 0


def _gzip(v: Value, at: int) -> int:
    b = v.data
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:  # whatever it unpacks to is thrown away piece by piece
            piece = d.unconsumed_tail or b[p : p + 65536]
            p += 0 if d.unconsumed_tail else len(piece)
            d.decompress(piece, 1 << 20)
    except zlib.error:
        return 0
    return p - len(d.unused_data) - at if d.eof else 0


def _pdf(v: Value, at: int) -> int:
    """To the last end mark before another PDF starts, so with all updates that were appended."""
    starts, marks, tables = v.find_all(b"%PDF-"), v.find_all(b"%%EOF"), v.find_all(b"startxref")
    after = bisect_right(starts, at)
    k = bisect_left(marks, starts[after] if after < len(starts) else len(v.data)) - 1
    if k < 0 or marks[k] < at or not v.data[at + 5 : at + 6].isdigit():
        return 0
    t = bisect_left(tables, marks[k]) - 1
    return marks[k] + 5 - at if t >= 0 and tables[t] > at else 0


def _zip(v: Value, at: int) -> int:
    """An end record says where its archive starts; an archive stored inside another one has its own."""
    if "zip" not in v.ends:
        v.ends["zip"] = {}
        for e in v.find_all(b"PK\5\6"):
            if e + 22 <= len(v.data):
                size, start, note = struct.unpack_from("<IIH", v.data, e + 12)
                first = e - size - start
                if first >= 0 and e + 22 + note <= len(v.data) and v.data[first + start : first + start + 4] == b"PK\1\2":
                    v.ends["zip"][first] = e + 22 + note
    return max(0, v.ends["zip"].get(at, 0) - at)


@cache
def _crc_table(polynomial: int, bits: int) -> tuple[int, ...]:
    out = []
    for byte in range(256):
        x = byte << (bits - 8)
        for _ in range(8):
            x = ((x << 1) ^ (polynomial if x >> (bits - 1) else 0)) & ((1 << bits) - 1)
        out.append(x)
    return tuple(out)


def _flac_header(b: bytes, p: int) -> int:
    """Length of the frame header at p if its fields are allowed and its CRC-8 is right, else 0."""
    if p + 6 > len(b) or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8:
        return 0
    size, rate, channels, depth = b[p + 2] >> 4, b[p + 2] & 15, b[p + 3] >> 4, b[p + 3] >> 1 & 7
    if size == 0 or rate == 15 or channels > 10 or depth == 3 or b[p + 3] & 1:
        return 0
    lead = b[p + 4]
    n = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    end = p + 4 + n + (size in (6, 7)) * (size - 5) + (rate in (12, 13, 14)) * (1 + (rate > 12))
    if n > 7 or 0x80 <= lead < 0xC0 or end >= len(b) or any(x & 0xC0 != 0x80 for x in b[p + 5 : p + 4 + n]):
        return 0
    crc, table = 0, _crc_table(0x07, 8)
    for x in b[p:end]:
        crc = table[crc ^ x]
    return end + 1 - p if crc == b[end] else 0


def _flac_samples(b: bytes, p: int) -> int:
    """Samples of the frame whose good header is at p."""
    code = b[p + 2] >> 4
    if code in (6, 7):
        at = p + 4 + (1 if b[p + 4] < 0x80 else 8 - (b[p + 4] ^ 0xFF).bit_length())
        return int.from_bytes(b[at : at + code - 5], "big") + 1
    return 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)


def _flac(v: Value, at: int) -> int:
    """Metadata blocks, then frames. A frame ends where its CRC-16 comes out and another starts or all samples are there."""
    b = v.data

    def block(p: int):
        return (p + 4 + int.from_bytes(b[p + 1 : p + 4], "big"), b[p] >= 128) if p + 4 <= len(b) and b[p] & 127 < 127 else None

    if len(b) < at + 42 or b[at + 4] & 127 or int.from_bytes(b[at + 5 : at + 8], "big") != 34:
        return 0
    largest = int.from_bytes(b[at + 15 : at + 18], "big")
    left = int.from_bytes(b[at + 21 : at + 26], "big") & ((1 << 36) - 1)
    if not int.from_bytes(b[at + 18 : at + 21], "big") >> 4:  # sample rate
        return 0
    p, table = v.follow("flac", at + 4, block), _crc_table(0x8005, 16)
    known = left > 0
    while p:
        head = _flac_header(b, p)
        if not head:
            return 0
        left -= _flac_samples(b, p)
        crc, q, end = 0, p, min(len(b), p + largest if largest else len(b))
        good = 0
        while q < end:
            crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ b[q]]
            q += 1
            if crc == 0 and q >= p + head + 3:
                if (known and left <= 0) or _flac_header(b, q):
                    good = q
                    break
                good = good or q
        if not good:
            return 0
        if good != q or (known and left <= 0) or not _flac_header(b, good):  # the last frame, of unknown length: the first place that fits
            return good - at if not known or left <= 0 else 0
        p = good
    return 0


#: Each byte with its bits in reverse.
REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def _ogg_crc(page: bytes) -> int:
    """CRC-32 of the same polynomial as zlib's, but highest bit first and from zero."""
    return int(f"{zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _ogg(v: Value, at: int) -> int:
    """Pages of right checksum from the one that begins a stream on, up to the one that ends it or the last that follows."""
    b = v.data

    def page(p: int) -> int:
        """End of the page at p, or 0."""
        if p + 27 > len(b) or b[p : p + 5] != b"OggS\0":
            return 0
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + 27 + n > len(b) or end > len(b):
            return 0
        return end if _ogg_crc(b[p : p + 22] + bytes(4) + b[p + 26 : end]) == struct.unpack_from("<I", b, p + 22)[0] else 0

    def chain(p: int):
        end = page(p)
        return (end, bool(b[p + 5] & 4) or b[end : end + 5] != b"OggS\0") if end else None

    return max(0, v.follow("ogg", at, chain) - at) if len(b) > at + 5 and b[at + 5] & 2 else 0


def _midi(v: Value, at: int) -> int:
    b = v.data
    if len(b) < at + 14 or b[at + 4 : at + 8] != b"\0\0\0\6":
        return 0
    tracks, p = struct.unpack_from(">H", b, at + 10)[0], at + 14
    chain = v.chain("midi", p, lambda p: p + 8 + struct.unpack_from(">I", b, p + 4)[0] if b[p : p + 4] == b"MTrk" and p + 8 <= len(b) else None)
    left = chain[p][1] - tracks
    while left >= 0 and chain[p][1] > left:
        p = chain[p][2] if chain[chain[p][2]][1] >= left else chain[p][0]
    return p - at if tracks and left >= 0 and p <= len(b) else 0


#: Magic bytes, type and validator of each format.
FORMATS = [
    (b"RIFF", "riff", _riff), (b"\x89PNG\r\n\x1a\n", "image/png", _png), (b"GIF87a", "image/gif", _gif), (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg), (b"BM", "image/bmp", _bmp), (b"\x1f\x8b\x08", "application/gzip", _gzip), (b"%PDF-", "application/pdf", _pdf),
    (b"PK\3\4", "application/zip", _zip), (b"fLaC", "audio/flac", _flac), (b"OggS", "audio/ogg", _ogg), (b"MThd", "audio/midi", _midi),
]
RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), (len(magic), k))
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of each well-formed item, in order; embedded ones too."""
    out, value = [], Value(data)
    for end, (size, k) in automaton().iter(data.decode("latin-1")):
        at = end + 1 - size
        if n := FORMATS[k][2](value, at):
            kind = FORMATS[k][1]
            out.append((at, n, RIFF_TYPES[data[at + 8 : at + 12]] if kind == "riff" else kind))
    return sorted(out)


def describe(samples: bytes) -> str:
    """Mean, deviation, peak-to-peak, sign changes around the middle and energy of eight equal parts."""
    x = np.frombuffer(samples, np.uint8)
    cuts = (np.arange(9) * len(x) // 8).tolist()
    counts = np.stack([np.bincount(x[p:q], minlength=256) for p, q in zip(cuts[:-1], cuts[1:], strict=True)])
    level, total = np.arange(256), counts.sum(axis=0)
    mean, seen = total @ level / len(x), np.flatnonzero(total)
    spread = np.sqrt(max(0.0, total @ level**2 / len(x) - mean**2))
    high = x >= 128
    crossings = np.count_nonzero(high[1:] != high[:-1])
    parts = ",".join(map(str, (counts @ level // counts.sum(axis=1)).tolist()))
    return f"mean={mean:.4f};std={spread:.4f};range={seen[-1] - seen[0]};crossings={crossings};parts={parts}"


def stored_media(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a media value: doc_id, n_bytes long, media binary (WAV), declared string.

    Null and empty texts become UNIT zero samples. The declared type is the generic one, as of a column whose types are not known.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column("text").to_pylist()
                columns = [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([wav(pad(t)) for t in texts], pa.binary()), pa.array([UNKNOWN] * len(texts))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "declared"])

    return id_and_text(rows, id_col, text_col).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, n_bytes long, media binary, declared string")


def sniffed_media(rows: DataFrame, media_col: str = "media", declared_col: str = "declared", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds to `carry` what each media value is: media_type, corrected boolean, media_bytes long, media_sha256, samples
    binary (of 8-bit sound, else null), feature string and carved array of (start, length, media_type).

    A value that no format claims keeps its declared type. Null values have type null, length 0 and nothing else.
    Embedded items are those found past the start; one that holds others is listed as well as they. Where `carry` has
    a column of one of these names, the new one gets underscores before its name.
    """

    def one(data: bytes | None, declared: str | None) -> tuple:
        if data is None:
            return None, False, 0, None, None, None, []
        found = sniff(data)
        whole = next((k for at, _, k in found if at == 0), None)
        samples = wav_samples(data) if whole == "audio/wav" else None
        carved = [{"start": at, "length": n, "media_type": k} for at, n, k in found if at]
        feature = f"type={whole or declared};carved={len(carved)};" + (describe(samples) if samples else f"bytes={len(data)}")
        return whole or declared, whole not in (None, declared), len(data), hashlib.sha256(data).hexdigest(), samples, feature, carved

    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("media_type", pa.string())])
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.list_(item)]
    ddl = ["string", "boolean", "long", "string", "binary", "string", "array<struct<start: long, length: long, media_type: string>>"]
    carried = rows.select(*[F.col(f"`{c}`") for c in carry])
    names = [unused(carried, c) for c in ("media_type", "corrected", "media_bytes", "media_sha256", "samples", "feature", "carved")]
    media, said = unused(carried, "_media"), unused(carried, "_declared")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = zip(*map(one, part.column(media).to_pylist(), part.column(said).to_pylist()), strict=True)
                columns = [part.column(c) for c in carry] + [pa.array(v, t) for v, t in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [*carry, *names])

    rows = rows.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{media_col}`").cast("binary").alias(media), F.col(f"`{declared_col}`").alias(said))
    added = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in zip(names, ddl, strict=True)))
    return rows.mapInArrow(run, StructType([*carried.schema, *added]))


def op8_media(spark, sf_dir: str) -> DataFrame:
    """All texts stored as 8-bit sound, read back and looked through; null and empty texts are 64 zero samples."""
    stored = stored_media(table(spark, sf_dir, "documents"))
    out = sniffed_media(stored, carry=("doc_id", "n_bytes"))
    tail = F.substring("samples", -UNIT, UNIT)
    return out.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "media_type", "corrected", "carved",
    )
