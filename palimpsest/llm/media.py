"""Media columns by signature sniffing.

An Aho-Corasick automaton finds every magic number in a byte string at once (bytes as Latin-1 characters). A format's
validator then confirms structure and gives the length, from the format's own fields; a signature without a valid
structure behind it doesn't count. So declared types are corrected, and media that lie inside other bytes are carved out
whole, with their offset.

The corpus query takes each text's bytes, declared as plain text, for a payload: what it really is is sniffed, and media
that lie within it are carved. It is stored as an 8-bit PCM WAV under no more than a general type, which sniffing
corrects; the samples are then read back and described.

Defined results: null bytes (or a null text) count as empty; a value that no validator confirms keeps its declared type
and is marked unconfirmed; of formats that a value can end in more than one place, the first confirmed end counts; repeated rows return each, equal values give equal results; an empty table gives no rows;
extra columns are ignored; long values are read whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import _common

FRAME = 576
RATE = 8000


def _wav(b: bytes, at: int) -> int | None:
    """RIFF/WAVE with a fmt chunk and a data chunk whose lengths fit."""
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return None
    end, i, seen = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12, set()
    if end > len(b):
        return None
    while i + 8 <= end:
        size = struct.unpack_from("<I", b, i + 4)[0]
        if i + 8 + size > end:
            return None
        seen.add(b[i : i + 4])
        i += 8 + size + (size & 1)
    return end - at if {b"fmt ", b"data"} <= seen else None


def _webp(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WEBP" or b[at + 12 : at + 16] not in (b"VP8 ", b"VP8L", b"VP8X"):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    return end - at if end <= len(b) else None


def _png(b: bytes, at: int) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    i, first = at + 8, True
    while i + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + size > len(b) or (first and (kind != b"IHDR" or size != 13)):
            return None
        if zlib.crc32(b[i + 4 : i + 8 + size]) != struct.unpack_from(">I", b, i + 8 + size)[0]:
            return None
        i, first = i + 12 + size, False
        if kind == b"IEND":
            return i - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    """Blocks up to the trailer."""
    if len(b) < at + 13:
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while i < len(b):
        kind = b[i]
        if kind == 0x3B:
            return i + 1 - at
        if kind == 0x21:
            i += 2
        elif kind == 0x2C and i + 10 <= len(b):
            flags = b[i + 9]
            i += 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0) + 1
        else:
            return None
        while i < len(b) and b[i]:
            i += 1 + b[i]
        i += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    """Segments with fitting lengths, a frame, a scan and the end marker."""
    i, frame = at + 2, False
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        marker = b[i + 1]
        if marker == 0xFF:
            i += 1
            continue
        size = struct.unpack_from(">H", b, i + 2)[0]
        if size < 2 or i + 2 + size > len(b):
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        i += 2 + size
        if marker == 0xDA:
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b):
                if b[i + 1] == 0xD9:
                    return i + 2 - at if frame else None
                if b[i + 1] and not 0xD0 <= b[i + 1] <= 0xD7 and b[i + 1] != 0xFF:
                    break
                i += 1 if b[i + 1] == 0xFF else 2
            else:
                return None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, _, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + 26)[0]
    ok = header in (40, 52, 56, 108, 124) and planes == 1 and 14 + header <= start <= size and at + size <= len(b)
    return size if ok else None


def _gzip(b: bytes, at: int) -> int | None:
    """A stream that inflates to its end with the right checksum."""
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return None
    unzip = zlib.decompressobj(wbits=31)
    try:
        i = at
        while i < len(b) and not unzip.eof:
            chunk = b[i : i + 65536]
            while chunk and not unzip.eof:
                unzip.decompress(chunk, 1 << 20)
                chunk = unzip.unconsumed_tail
            i += 65536
    except zlib.error:
        return None
    return min(i, len(b)) - at - len(unzip.unused_data) if unzip.eof else None


class _Marks:
    """Places of a value that validators look up instead of searching on from every magic number: found once a value."""

    value: bytes | None = None

    def of(self, b: bytes) -> _Marks:
        if self.value is not b:
            self.value, self.archives, self.ends, self.starts = b, {}, _places(b, b"%%EOF"), _places(b, b"startxref")
            for end in _places(b, b"PK\x05\x06"):
                if end + 22 <= len(b):
                    size, start, note = struct.unpack_from("<IIH", b, end + 12)
                    at = end - size - start
                    if at >= 0 and at not in self.archives and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06") and end + 22 + note <= len(b):
                        self.archives[at] = end + 22 + note
        return self


_MARKS = _Marks()


def _places(b: bytes, mark: bytes) -> list[int]:
    out, at = [], b.find(mark)
    while at >= 0:
        out.append(at)
        at = b.find(mark, at + 1)
    return out


def _zip(b: bytes, at: int) -> int | None:
    """A local header, and a directory end that points back into the archive."""
    end = _MARKS.of(b).archives.get(at)
    return None if end is None else end - at


def _pdf(b: bytes, at: int) -> int | None:
    """A version and an end-of-file mark after a cross-reference start."""
    if not b[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    marks = _MARKS.of(b)
    place = bisect_left(marks.ends, at)
    start = bisect_left(marks.starts, at)
    if place == len(marks.ends) or start == len(marks.starts) or marks.starts[start] > marks.ends[place]:
        return None
    return marks.ends[place] + 5 - at


def _crc_table(poly: int, width: int) -> list[int]:
    out = []
    for x in range(256):
        x <<= width - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x >> (width - 1) else x << 1) & ((1 << width) - 1)
        out.append(x)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _residual(bits: str, i: int, n: int, order: int) -> int:
    """Where the Rice-coded residual of a subframe of n samples ends."""
    width, parts = 4 + (bits[i : i + 2] == "01"), 1 << int(bits[i + 2 : i + 6], 2)
    if bits[i] == "1" or n % parts:
        raise ValueError("no such residual")
    i += 6
    for part in range(parts):
        count = n // parts - (0 if part else order)
        rice, i = int(bits[i : i + width], 2), i + width
        if rice == (1 << width) - 1:
            i += 5 + count * int(bits[i : i + 5], 2)
            continue
        for _ in range(count):
            i = bits.index("1", i) + 1 + rice
    return i


def _flac_frame(b: bytes, at: int, depth: int) -> tuple[int, int] | None:
    """End and samples of the frame there: a header with its checksum, subframes of fitting lengths, the frame's checksum."""
    head = b[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1:
        return None
    sizes, rate, layout, bps = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    ones = 8 - (~head[4] & 0xFF).bit_length()
    if not sizes or rate == 15 or layout > 10 or bps == 3 or ones in (1, 8):
        return None
    i = 4 + max(1, ones)
    n = {1: 192, 6: int.from_bytes(head[i : i + 1], "big") + 1, 7: int.from_bytes(head[i : i + 2], "big") + 1}.get(sizes, 576 << max(0, sizes - 2) if sizes < 6 else 256 << max(0, sizes - 8))
    i += {6: 1, 7: 2}.get(sizes, 0) + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in head[:i]:
        crc = _CRC8[crc ^ x]
    if i >= len(head) or crc != head[i]:
        return None
    depth = (depth, 8, 12, 0, 16, 20, 24, 32)[bps]
    channels = layout + 1 if layout < 8 else 2
    raw = b[at + i + 1 : at + i + 1 + channels * (n * (depth + 2) + 64) // 4 + 64]  # encoders store samples as they are before a frame gets twice as long
    bits, i, body = f"{int.from_bytes(raw, 'big'):0{8 * len(raw)}b}" if raw else "", 0, at + i + 1
    try:
        for channel in range(channels):
            width = depth + ((layout, channel) in ((8, 1), (9, 0), (10, 1)))
            kind, wasted = int(bits[i + 1 : i + 7], 2), bits[i + 7] == "1"
            if bits[i] == "1":
                return None
            i += 8
            if wasted:
                more = bits.index("1", i) + 1
                width, i = width - (more - i), more
            if kind == 0:
                i += width
            elif kind == 1:
                i += n * width
            elif 8 <= kind <= 12:
                i = _residual(bits, i + (kind - 8) * width, n, kind - 8)
            elif kind >= 32:
                order = kind - 31
                precision = int(bits[i + order * width : i + order * width + 4], 2) + 1
                i = _residual(bits, i + order * width + 9 + order * precision, n, order)
            else:
                return None
    except (ValueError, IndexError):
        return None
    end, crc = body + -(-i // 8) + 2, 0
    if end > len(b):
        return None
    for x in b[at : end - 2]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ x]
    return (end, n) if crc == int.from_bytes(b[end - 2 : end], "big") else None


def _flac(b: bytes, at: int) -> int | None:
    """Metadata blocks from STREAMINFO on, then frames one after another, up to the stream's number of samples."""
    i, first, last, depth, total = at + 4, True, False, 0, 0
    while not last:
        if i + 4 > len(b):
            return None
        kind, size, last = b[i] & 0x7F, int.from_bytes(b[i + 1 : i + 4], "big"), b[i] >> 7
        if first and (kind != 0 or size != 34) or i + 4 + size > len(b):
            return None
        if first:
            packed = int.from_bytes(b[i + 14 : i + 22], "big")  # 20 bits of rate, 3 of channels, 5 of depth, 36 of samples
            depth, total = (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
        first, i = False, i + 4 + size
    start, samples = i, 0
    while (not total or samples < total) and (frame := _flac_frame(b, i, depth)):
        i, samples = frame[0], samples + frame[1]
    return i - at if i > start and samples >= total else None


def _ogg(b: bytes, at: int) -> int | None:
    """Pages one after another, up to one that ends the stream."""
    i = at
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b):
        n = b[i + 26]
        size = 27 + n + sum(b[i + 27 : i + 27 + n])
        if b[i + 4] or i + size > len(b):
            return None
        done = b[i + 5] & 4
        i += size
        if done:
            return i - at
    return None


def _mp4(b: bytes, at: int) -> int | None:
    """Boxes from ftyp on with fitting lengths, a moov or mdat among them. The magic number is at the fifth byte."""
    i, seen = at, set()
    while i + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, i)
        if size == 1 and i + 16 <= len(b):
            size = struct.unpack_from(">Q", b, i + 8)[0]
        if size < 8 or i + size > len(b) or not kind.isalnum() or (i == at and kind != b"ftyp"):
            break
        seen.add(kind)
        i += size
    return i - at if seen & {b"moov", b"mdat"} else None


#: (magic number, its place in the format, type, validator). Fixed values of the formats.
FORMATS: tuple[tuple[bytes, int, str, Callable[[bytes, int], int | None]], ...] = (
    (b"RIFF", 0, "audio/wav", _wav),
    (b"RIFF", 0, "image/webp", _webp),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
)
_AUTOMATON: list = []


def _automaton():
    if not _AUTOMATON:
        made, by = ahocorasick.Automaton(), {}
        for magic, place, kind, valid in FORMATS:
            by.setdefault(magic, []).append((place, kind, valid))
        for magic, formats in by.items():
            made.add_word(magic.decode("latin-1"), (len(magic), formats))
        made.make_automaton()
        _AUTOMATON.append(made)
    return _AUTOMATON[0]


def carve(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed medium, outermost ones only: what lies inside one isn't listed."""
    out, clear = [], 0
    _MARKS.value = None
    for end, (size, formats) in _automaton().iter(data.decode("latin-1")):
        for place, kind, valid in formats:
            at = end - size + 1 - place
            if at >= clear and (length := valid(data, at)):
                out.append((at, length, kind))
                clear = at + length
                break
    return out


def sniff(data: bytes, declared: str | None = None) -> tuple[str | None, bool]:
    """The type of the medium that starts the value, and True; or the declared type and False."""
    head = data[:64].decode("latin-1")
    _MARKS.value = None
    for end, (size, formats) in _automaton().iter(head):
        for place, kind, valid in formats:
            if end - size + 1 == place and valid(data, 0):
                return kind, True
    return declared, False


def typed(media: DataFrame, id_col: str, data_col: str, declared_col: str) -> DataFrame:
    """id, declared, type, confirmed, corrected, and the carved media (offset, length, type, sha256) of each value."""
    _common.prepare(media.sparkSession)
    id_type = dict(media.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches):
            rows = []
            for data, declared in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = data or b""
                kind, sure = sniff(data, declared)
                parts = [{"offset": o, "length": n, "type": k, "sha256": hashlib.sha256(data[o : o + n]).hexdigest()} for o, n, k in carve(data)]
                rows.append((kind, sure, sure and kind != declared, parts))
            kinds = [pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names=["id", "declared", "type", "confirmed", "corrected", "carved"]
            )

    return media.select(F.col(id_col).alias("id"), F.col(data_col).cast("binary").alias("data"), F.col(declared_col).cast("string").alias("declared")).mapInArrow(
        run, f"id {id_type}, declared string, type string, confirmed boolean, corrected boolean, carved array<struct<offset:long,length:long,type:string,sha256:string>>"
    )


def payload(text: str) -> tuple[bytes, int]:
    """A text's bytes, filled up with 255 to a positive multiple of FRAME, and their number before that."""
    raw = text.encode()
    return raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME), len(raw)


def as_wav(samples: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) & 1)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(stored: bytes) -> bytes:
    i = 12
    while stored[i : i + 4] != b"data":
        size = struct.unpack_from("<I", stored, i + 4)[0]
        i += 8 + size + (size & 1)
    size = struct.unpack_from("<I", stored, i + 4)[0]
    return stored[i + 8 : i + 8 + size]


def describe(kind: str, samples: bytes) -> str:
    """Type, seconds, mean, deviation, zero crossings and a 16-step histogram of 8-bit samples, in whole numbers."""
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64)
    total, squares = int(x.sum()), int((x * x).sum())
    crossings = int((np.diff(x >= 128) != 0).sum())
    steps = np.bincount(x >> 4, minlength=16)
    mean = total / len(x)
    return f"{kind};ms={1000 * len(x) // RATE};mean={mean:.4f};sd={max(0.0, squares / len(x) - mean * mean) ** 0.5:.4f};zc={crossings};hist={'.'.join(map(str, steps))}"


def stored_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "text/plain") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and media_type of
    each text's stored form, sniffed and read back; declared_type, payload_type and corrected of the text itself, n_carved
    and carved, the media within it (offset:length:type)."""
    _common.prepare(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    columns = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "media_type": "string"}
    columns |= {"declared_type": "string", "payload_type": "string", "corrected": "boolean", "n_carved": "long", "carved": "string"}

    def one(text: str) -> tuple:
        data, n = payload(text)
        raw = data[:n]
        kind_within, sure = sniff(raw, declared)
        parts = carve(raw)
        stored = as_wav(data)
        kind, confirmed = sniff(stored, "application/octet-stream")
        if not confirmed:
            raise ValueError("a stored form must be confirmed")
        back = wav_samples(stored)
        own = n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(kind, back), kind
        return *own, declared, kind_within, sure and kind_within != declared, len(parts), ",".join(f"{o}:{size}:{k}" for o, size, k in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches):
            values = list(zip(*map(one, batch.column(1).to_pylist()), strict=True))
            kinds = [{"long": pa.int64(), "boolean": pa.bool_()}.get(t, pa.string()) for t in columns.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=["doc_id", *columns])

    return docs.select(F.col(id_col).alias("doc_id"), _common.text_or_empty(text_col).alias("text")).mapInArrow(run, ", ".join([f"doc_id {id_type}", *(f"{c} {t}" for c, t in columns.items())]))


def op5_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(_common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_signature_sniffing": op5_signature_sniffing}
