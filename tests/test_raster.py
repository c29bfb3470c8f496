"""PNG files of every kind against a plain decoder, headers of other formats, broken files, and the time of one photograph."""

import random
import struct
import time
import zlib

import numpy as np
import pytest

from tessera.plans.sources import jpeg_head, png
from tessera.sources import raster


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def paeth(a, b, c):
    p = a + b - c
    return min((a, b, c), key=lambda v: abs(p - v))


def encoded(rows, bpp, rng):
    """Filtered lines of rows of bytes, the filter of each drawn."""
    out, above = b"", None
    for row in rows:
        above = above or bytes(len(row))
        kind = rng.randrange(5)
        at = lambda r, i: r[i] if i >= 0 else 0
        guess = [(0, at(row, i - bpp), above[i], (at(row, i - bpp) + above[i]) // 2, paeth(at(row, i - bpp), above[i], at(above, i - bpp)))[kind] for i in range(len(row))]
        out += bytes([kind]) + bytes((x - g) & 255 for x, g in zip(row, guess, strict=True))
        above = row
    return out


def make(width, height, depth, colour, interlaced, rng):
    """(file, samples) of random samples."""
    channels = raster.CHANNELS[colour]
    top = 2**depth if colour != 3 else min(2**depth, 5)
    samples = np.array([[[rng.randrange(top) for _ in range(channels)] for _ in range(width)] for _ in range(height)]).reshape(height, width, channels)

    def rows(part):
        for line in part:
            flat = line.ravel().tolist()
            if depth == 16:
                yield struct.pack(f">{len(flat)}H", *flat)
            else:
                bits = "".join(f"{v:0{depth}b}" for v in flat)
                yield bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))

    bpp, raw = max(1, depth * channels // 8), b""
    for x, y, sx, sy in raster.PASSES if interlaced else [(0, 0, 1, 1)]:
        part = samples[y::sy, x::sx]
        if part.size:
            raw += encoded(list(rows(part)), bpp, rng)
    packed = zlib.compress(raw)
    palette = bytes(rng.randrange(256) for _ in range(15))
    file = raster.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)) + (chunk(b"PLTE", palette) if colour == 3 else b"") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")
    if colour == 3:
        samples = np.frombuffer(palette, np.uint8).reshape(-1, 3)[samples[..., 0]]
    return file, samples


KINDS = [(d, c, i) for c, depths in raster.DEPTHS.items() for d in depths for i in (0, 1)]


@pytest.mark.parametrize("depth, colour, interlaced", KINDS)
def test_every_kind(depth, colour, interlaced):
    rng = random.Random(f"{depth} {colour} {interlaced}")
    made = [make(w, h, depth, colour, interlaced, rng) for w, h in [(1, 1), (3, 2), (9, 7), (9, 7), (17, 5), (2, 11)]]
    for p, (_, samples) in zip(raster.decode([f for f, _ in made]), made, strict=True):
        assert p.error == "" and p.format == "PNG" and (p.height, p.width) == samples.shape[:2] and (p.pixels == samples).all()
    assert p.mode == {0: {1: "1", 16: "I;16"}.get(depth, "L"), 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[colour]


def test_broken_files():
    rng = random.Random(3)
    good, _ = make(6, 5, 8, 2, 0, rng)
    no_palette = good.replace(struct.pack(">BB", 8, 2), struct.pack(">BB", 8, 3), 1)
    head = good[:33]
    short = raster.PNG + head[8:] + chunk(b"IDAT", zlib.compress(b"\0" * 10)) + chunk(b"IEND", b"")
    strange = raster.PNG + head[8:] + chunk(b"IDAT", zlib.compress(b"\x07" + b"\0" * 18 + (b"\0" * 19) * 4)) + chunk(b"IEND", b"")
    flipped = bytearray(good)
    flipped[50] ^= 1
    cases = [None, b"", b"plain text", good[:-12], good[:20], bytes(flipped), no_palette, short, strange, good]
    got = raster.decode(cases)
    assert [p.error for p in got] == ["missing", "missing", *["corrupt"] * 7, ""]
    assert (got[3].width, got[3].mode, got[2].format, got[4].width) == (6, "RGB", None, None)
    huge = raster.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"")) + chunk(b"IEND", b"")
    assert raster.decode([huge])[0].error == "unsupported"


def test_headers_of_other_formats():
    bmp = b"BM" + bytes(12) + struct.pack("<IiiHH", 40, 31, -17, 1, 24) + bytes(20)
    gif = b"GIF89a" + struct.pack("<HH", 5, 4) + bytes(3)
    vp8x = b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(4) + bytes([16, 0, 0, 0]) + (299).to_bytes(3, "little") + (199).to_bytes(3, "little")
    vp8 = b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(10) + struct.pack("<HH", 640, 480)
    vp8l = b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", 63 | 31 << 14 | 1 << 28)
    tiff = b"II*\0" + struct.pack("<IH", 8, 3) + struct.pack("<HHII", 256, 4, 1, 70) + struct.pack("<HHIHH", 257, 3, 1, 50, 0) + struct.pack("<HHIHH", 277, 3, 1, 3, 0)
    files = [jpeg_head(33, 21), bmp, gif, vp8x, vp8, vp8l, tiff, jpeg_head(33, 21)[:-2], b"GIF89a", jpeg_head(3, 3)[:12]]
    got = [(p.error, p.format, p.width, p.height, p.mode) for p in raster.decode(files)]
    assert got[:7] == [
        ("unsupported", "JPEG", 33, 21, "L"), ("unsupported", "BMP", 31, 17, "RGB"), ("unsupported", "GIF", 5, 4, "P"), ("unsupported", "WEBP", 300, 200, "RGBA"), ("unsupported", "WEBP", 640, 480, "RGB"),
        ("unsupported", "WEBP", 64, 32, "RGBA"), ("unsupported", "TIFF", 70, 50, "RGB"),
    ]
    assert [g[:2] for g in got[7:]] == [("corrupt", "JPEG"), ("corrupt", "GIF"), ("corrupt", "JPEG")]


def test_one_photograph():
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (1024, 768, 3)).astype(np.uint8)
    files = [png(pixels, k) for k in range(2)]
    raster.decode(files[:1])
    began = time.perf_counter()
    got = raster.decode(files)
    took = (time.perf_counter() - began) / 2
    assert all((p.pixels == pixels).all() for p in got) and got[0].mode == "RGB" and took < 1.0  # about 0.1 s on an idle core
