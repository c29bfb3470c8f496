"""PNG files to pixels in numpy, many files at a time, and the headers of other image formats.

The filters of a PNG make a byte depend on its left, upper and upper left neighbours.  Bytes on one anti-diagonal do not
depend on one another, so a picture is restored diagonal by diagonal, and all pictures of one shape together.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import as_strided

# Fixed values of the formats: signatures, channels of a PNG colour type, passes of its interlacing (x, y, step x, step y).
PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
#: Decompressed bytes of a picture that is decoded; one that claims more is refused before anything is unpacked.
MOST_BYTES = 1 << 30


@dataclass
class Picture:
    """What a file is: ``error`` is empty, missing, corrupt (not sound), or unsupported (sound as far as it is read, not decoded)."""

    error: str = ""
    format: str | None = None
    width: int | None = None
    height: int | None = None
    mode: str | None = None
    pixels: np.ndarray | None = None


@dataclass
class _Packed:
    """A PNG whose chunks are sound and whose data are unpacked but still filtered."""

    picture: Picture
    depth: int
    colour: int
    passes: list[tuple[tuple[int, int, int, int], int, int, int, int]]
    raw: bytes
    palette: np.ndarray | None


def _mode(depth: int, colour: int) -> str:
    if colour == 0:
        return "1" if depth == 1 else "I;16" if depth == 16 else "L"
    return {2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[colour]


def _unpacked(data: bytes) -> Picture | _Packed:
    out = Picture("corrupt", "PNG")
    at, packed, head, palette, ended = 8, [], None, None, False
    while at + 12 <= len(data) and not ended:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(data) or struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            return out
        at += 12 + size
        if kind == b"IHDR" and size == 13 and head is None:
            head = struct.unpack(">IIBBBBB", body)
            width, height, depth, colour, method, filters, interlaced = head
            if not width or not height or depth not in DEPTHS.get(colour, ()) or method or filters or interlaced > 1:
                return out
            out.width, out.height, out.mode = width, height, _mode(depth, colour)
        elif kind == b"PLTE" and size % 3 == 0:
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
    if not ended or head is None or colour == 3 and palette is None:
        return out
    bits = depth * CHANNELS[colour]
    passes, total = [], 0
    for x, y, sx, sy in PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = max(0, -(-(width - x) // sx)), max(0, -(-(height - y) // sy))
        if w and h:
            row = -(-w * bits // 8)
            passes.append(((x, y, sx, sy), w, h, row, total))
            total += h * (row + 1)
    if total > MOST_BYTES:
        out.error = "unsupported"
        return out
    try:
        inflate = zlib.decompressobj()
        raw = inflate.decompress(b"".join(packed), total + 1)
    except zlib.error:
        return out
    if len(raw) != total:
        return out
    out.error = ""
    return _Packed(out, depth, colour, passes, raw, palette)


def _by_rows(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of the filters none, left and up only: each is one cumulative sum or one addition."""
    out, above = lines, np.zeros(lines.shape[1], np.uint8)
    for y, kind in enumerate(kinds):
        if kind == 2:
            out[y] += above
        elif kind == 1:
            row = out[y].reshape(-1, step)
            np.cumsum(row, axis=0, dtype=np.uint8, out=row)
        above = out[y]
    return out


def _by_diagonals(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Restore pictures (pictures, rows, bytes) of any filters (pictures, rows), all at once."""
    n, h, length = lines.shape
    w = length // step
    # A border of zeros on the left and above stands for the neighbours outside.
    full = np.zeros((n, h + 1, (w + 1) * step), np.uint8)
    full[:, 1:, step:] = lines
    plane, row, cell = full.strides[0], full.strides[1], step
    uses = {k: (kinds == k).any() for k in (1, 2, 3, 4)}
    masks = {k: (kinds == k)[:, :, None] for k in uses if uses[k]}
    for d in range(w + h - 1):
        first, last = max(0, d - w + 1), min(h - 1, d)
        count = last - first + 1
        here = full[:, first + 1 :, (d - first + 1) * step :]
        shape, strides = (n, count, step), (plane, row - cell, 1)
        # Views of the diagonal and of its neighbours; the last ones lie before it in the same buffer.
        at = as_strided(here, shape, strides)
        left = as_strided(full[:, first + 1 :, (d - first) * step :], shape, strides).astype(np.int16)
        up = as_strided(full[:, first:, (d - first + 1) * step :], shape, strides).astype(np.int16)
        guess = np.zeros(shape, np.int16)
        rows = slice(first, last + 1)
        if 4 in masks:
            corner = as_strided(full[:, first:, (d - first) * step :], shape, strides).astype(np.int16)
            a, b = up - corner, left - corner
            c = np.abs(a + b)
            a, b = np.abs(a), np.abs(b)
            paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
            np.copyto(guess, paeth, where=masks[4][:, rows])
        if 3 in masks:
            np.copyto(guess, (left + up) >> 1, where=masks[3][:, rows])
        if 2 in masks:
            np.copyto(guess, up, where=masks[2][:, rows])
        if 1 in masks:
            np.copyto(guess, left, where=masks[1][:, rows])
        at += guess.astype(np.uint8)
    return full[:, 1:, step:]


def _restored(parts: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray | None]:
    """Bytes of each (filters, lines, step); None where a filter is unknown."""
    out: list[np.ndarray | None] = [None] * len(parts)
    alike: dict[tuple, list[int]] = {}
    for i, (kinds, lines, step) in enumerate(parts):
        if (kinds > 4).any():
            continue
        if (kinds > 2).any():
            alike.setdefault((*lines.shape, step), []).append(i)
        else:
            out[i] = _by_rows(kinds, lines.copy(), step)
    for (*_, step), places in alike.items():
        done = _by_diagonals(np.stack([parts[i][0] for i in places]), np.stack([parts[i][1] for i in places]), step)
        for i, pixels in zip(places, done, strict=True):
            out[i] = pixels
    return out


def _samples(lines: np.ndarray, w: int, depth: int, channels: int) -> np.ndarray:
    """Bytes of rows as samples (rows, w, channels)."""
    if depth == 8:
        return lines.reshape(len(lines), w, channels)
    if depth == 16:
        return np.ascontiguousarray(lines).view(">u2").reshape(len(lines), w, channels).astype(np.uint16)
    bits = np.unpackbits(lines, axis=1)[:, : w * depth].reshape(len(lines), w, depth)
    return np.packbits(bits, axis=2)[..., :1] >> (8 - depth)


def decode(files: list[bytes | None]) -> list[Picture]:
    """Each file as a picture; sound PNG files of every depth, colour type and interlacing have their samples as ``pixels``.

    Palettes are resolved to RGB.  Null or empty bytes are missing; bytes of no known format are corrupt; other formats
    are read as far as their headers and are unsupported.
    """
    found = [Picture("missing") if not f else _unpacked(f) if f[:8] == PNG else other(f) for f in files]
    packed = [x for x in found if isinstance(x, _Packed)]
    parts, owners = [], []
    for x in packed:
        for _, w, h, row, at in x.passes:
            grid = np.frombuffer(x.raw, np.uint8, h * (row + 1), at).reshape(h, row + 1)
            parts.append((grid[:, 0], grid[:, 1:], max(1, x.depth * CHANNELS[x.colour] // 8)))
            owners.append((x, w))
    restored = iter(_restored(parts))
    for x in packed:
        p, channels = x.picture, CHANNELS[x.colour]
        pixels = np.zeros((p.height, p.width, channels), np.uint16 if x.depth == 16 else np.uint8)
        for (x0, y0, sx, sy), w, *_ in x.passes:
            lines = next(restored)
            if lines is None:
                p.error = "corrupt"
            elif not p.error:
                pixels[y0::sy, x0::sx] = _samples(lines, w, x.depth, channels)
        if x.colour == 3 and not p.error:
            if pixels.max(initial=0) >= len(x.palette):
                p.error = "corrupt"
            else:
                pixels = x.palette[pixels[..., 0]]
        if not p.error:
            p.pixels = pixels
    return [x.picture if isinstance(x, _Packed) else x for x in found]


def other(data: bytes) -> Picture:
    """Format, size and mode of a JPEG, GIF, BMP, WebP or TIFF from its header; corrupt where that is cut short."""
    readers = [(b"\xff\xd8\xff", "JPEG", _jpeg), (b"GIF87a", "GIF", _gif), (b"GIF89a", "GIF", _gif), (b"BM", "BMP", _bmp), (b"II*\0", "TIFF", _tiff), (b"MM\0*", "TIFF", _tiff)]
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        readers = [(b"RIFF", "WEBP", _webp)]
    for start, name, read in readers:
        if data.startswith(start):
            try:
                size = read(data)
            except (struct.error, IndexError, KeyError):
                size = None
            return Picture("corrupt", name) if size is None else Picture("unsupported", name, *size)
    return Picture("corrupt")


def _jpeg(data: bytes):
    at = 2
    while data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD7 or kind == 1:
            at += 1 if kind == 0xFF else 2
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width, parts = struct.unpack(">HHB", data[at + 5 : at + 10])
            # A file that was cut short has no end marker.
            return (width, height, {1: "L", 3: "RGB", 4: "CMYK"}[parts]) if b"\xff\xd9" in data[-1024:] else None
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _gif(data: bytes):
    return (*struct.unpack("<HH", data[6:10]), "P")


def _bmp(data: bytes):
    if struct.unpack("<I", data[14:18])[0] == 12:
        width, height, _, bits = struct.unpack("<HHHH", data[18:26])
    else:
        width, height, _, bits = struct.unpack("<iiHH", data[18:30])
    return width, abs(height), {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGBA"}[bits]


def _webp(data: bytes):
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), "RGBA" if data[20] & 16 else "RGB"
    if kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), "RGBA" if bits >> 28 & 1 else "RGB"
    width, height = struct.unpack("<HH", data[26:30])
    return width & 0x3FFF, height & 0x3FFF, "RGB"


def _tiff(data: bytes):
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(e + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
        tag, kind, _, value = struct.unpack(e + "HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
        tags[tag] = struct.unpack(e + "H", value[:2])[0] if kind == 3 else struct.unpack(e + "I", value)[0]
    return tags[256], tags[257], {1: "L", 3: "RGB", 4: "RGBA"}.get(tags.get(277, 1), "other")
