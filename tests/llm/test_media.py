import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from palimpsest.llm import media as M


def png(width=2, height=2):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + bytes(range(width)) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00" + b"\x3b"


def jpeg():
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + segment(0xC0, bytes(9)) + segment(0xDA, bytes(6)) + b"\x12\xff\x00\x34\xff\xd0\x56\xff\xd9"


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello " * 20)
    return out.getvalue()


def mp4():
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", bytes(4)) + box(b"mdat", bytes(10))


def ogg():
    return b"OggS\0\x02" + bytes(20) + bytes([1, 3]) + b"abc" + b"OggS\0\x04" + bytes(20) + bytes([1, 2]) + b"de"


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, width):
        self.text += f"{value & (1 << width) - 1:0{width}b}"
        return self

    def rice(self, value, k):
        folded = 2 * value if value >= 0 else -2 * value - 1
        self.text += "0" * (folded >> k) + "1"
        return self.put(folded, k) if k else self


def checksum(data, poly, width):
    """Bit by bit."""
    crc = 0
    for x in data:
        for bit in range(7, -1, -1):
            top = crc >> (width - 1) ^ (x >> bit & 1)
            crc = (crc << 1 & (1 << width) - 1) ^ (poly if top else 0)
    return crc


def flac(samples, total=None):
    """Stereo frames of 16 samples: a fixed predictor of order one with Rice codes beside a verbatim side channel; then a
    frame of constants and one with an escaped residual."""
    n = 16
    frames = b""
    for number, kind in enumerate(("rice", "constant", "escape")):
        head = bytes([0xFF, 0xF8, 0x60 | 9, (8 if kind == "rice" else 1) << 4 | 4 << 1, number, n - 1])
        b = Bits()
        if kind == "rice":
            b.put(9 << 1, 8).put(samples[0], 16).put(0, 2).put(1, 4)
            for part in range(2):
                b.put(3 + part, 4)
                for i in range(part * 8 or 1, part * 8 + 8):
                    b.rice(samples[i] - samples[i - 1], 3 + part)
            b.put(1 << 1, 8)
            for x in samples:
                b.put(x, 17)
        elif kind == "constant":
            b.put(0, 8).put(7, 16).put(0, 8).put(-7, 16)
        else:
            for _ in range(2):
                b.put(8 << 1, 8).put(1, 2).put(0, 4).put(31, 5).put(6, 5)
                for i in range(n):
                    b.put(i - 8, 6)
        b.text += "0" * (-len(b.text) % 8)
        frame = head + bytes([checksum(head, 0x07, 8)]) + int(b.text, 2).to_bytes(len(b.text) // 8, "big")
        frames += frame + checksum(frame, 0x8005, 16).to_bytes(2, "big")
    packed = 44100 << 44 | 1 << 41 | 15 << 36 | (3 * n if total is None else total)
    info = struct.pack(">HH", n, n) + bytes(6) + packed.to_bytes(8, "big") + bytes(16)
    return b"fLaC" + b"\x00\0\0\x22" + info + b"\x81\0\0\x03abc" + frames


SAMPLES = {
    "image/png": png(), "image/gif": gif(), "image/jpeg": jpeg(), "image/bmp": bmp(), "audio/wav": M.as_wav(b"12345"), "application/gzip": gzip.compress(b"x" * 500), "application/zip": zipped(),
    "application/pdf": b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF", "video/mp4": mp4(), "audio/ogg": ogg(), "image/webp": b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8 " + struct.pack("<I", 4) + b"abcd",
    "audio/flac": flac([5, 3, -200, 40, 41, 42, 90, -1, 0, 0, 1, 7, 300, -300, 2, 3]),
}


def test_each_format_is_sniffed_and_carved():
    for kind, data in SAMPLES.items():
        assert M.sniff(data, "text/plain") == (kind, True), kind
        assert M.carve(b"junk BM RIFF GIF89a" + data + b"tail bytes") == [(19, len(data), kind)], kind
        assert M.sniff(data[:-1], "text/plain") == ("text/plain", False) or kind in ("application/pdf", "video/mp4"), kind


def test_several_media_in_one_value_and_none_within_another():
    data = b"".join(b"--" + v for k, v in SAMPLES.items())
    assert [k for _, _, k in M.carve(data)] == list(SAMPLES)
    inside = M.as_wav(png())
    assert M.carve(inside) == [(0, len(inside), "audio/wav")]


def test_declared_types_are_corrected(spark):
    rows = [(1, png(), "image/jpeg"), (2, png(), "image/png"), (3, b"plain", "image/png"), (4, None, None), (5, b"xx" + gif(), "application/octet-stream")]
    got = {r.id: r for r in M.typed(spark.createDataFrame(rows, "i long, b binary, t string"), "i", "b", "t").collect()}
    assert (got[1].type, got[1].corrected) == ("image/png", True) and not got[2].corrected and got[2].confirmed
    assert (got[3].type, got[3].confirmed) == ("image/png", False) and got[4].type is None and got[4].carved == []
    assert [(c.offset, c.length, c.type) for c in got[5].carved] == [(2, len(gif()), "image/gif")]


def test_flac_frames_end_where_they_end():
    samples = list(range(16))
    unknown, wrong = flac(samples, 0), flac(samples, 4096)
    assert M.carve(unknown + b"\xff\xf8 no frame") == [(0, len(unknown), "audio/flac")] and M.carve(wrong) == []
    broken = bytearray(flac(samples))
    broken[-20] ^= 1
    assert M.carve(bytes(broken)) == [] and M.carve(b"fLaC\x80\0\0\x22" + bytes(34)) == []


def test_many_magic_numbers_stay_linear():
    from time import process_time

    begun = process_time()
    assert M.carve((b"PK\x03\x04" + b"PK\x05\x06" + bytes(18)) * 20_000) == [] and M.carve(b"%PDF-1.4 %%EOF" * 40_000) == []
    assert process_time() - begun < 20


def wav_by_hand(data):
    head = b"RIFF" + (len(data) + 36 + len(data) % 2).to_bytes(4, "little") + b"WAVEfmt " + bytes([16, 0, 0, 0, 1, 0, 1, 0, 0x40, 0x1F, 0, 0, 0x40, 0x1F, 0, 0, 1, 0, 8, 0]) + b"data" + len(data).to_bytes(4, "little")
    return head + data + b"\0" * (len(data) % 2)


def feature_by_hand(data):
    mean = sum(data) / len(data)
    sd = max(0.0, sum(x * x for x in data) / len(data) - mean * mean) ** 0.5
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:], strict=False))
    steps = [sum(x // 16 == k for x in data) for k in range(16)]
    return f"audio/wav;ms={len(data) * 1000 // 8000};mean={mean:.4f};sd={sd:.4f};zc={crossings};hist={'.'.join(map(str, steps))}"


def test_stored_texts(frame, corpus):
    rows = [*corpus, (700, "%PDF-1.4 a startxref 9 %%EOF"), (701, "see: %PDF-1.4 startxref %%EOF and %PDF-1.1 startxref %%EOF"), (702, "BM GIF89a RIFF")]
    got = M.stored_texts(frame(rows)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        data = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        stored = wav_by_hand(data)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(data), len(stored))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(data[-32:]) and r.media_type == "audio/wav"
        assert r.feature == feature_by_hand(data) and r.declared_type == "text/plain"
        if r.doc_id < 700 or r.doc_id == 702:
            assert (r.payload_type, r.corrected, r.n_carved, r.carved) == ("text/plain", False, 0, "")
    by = {r.doc_id: r for r in got}
    assert by[6].feature == by[7].feature and by[1].feature == by[2].feature
    assert (by[700].payload_type, by[700].corrected, by[700].carved) == ("application/pdf", True, "0:28:application/pdf")
    assert (by[701].payload_type, by[701].corrected, by[701].carved) == ("text/plain", False, "5:24:application/pdf,34:24:application/pdf")
    assert M.stored_texts(frame([])).count() == 0
