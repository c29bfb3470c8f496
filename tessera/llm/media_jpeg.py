"""Media columns as progressive JPEG.

A payload's bytes are the quantised coefficients of a 4:2:0 image (quantisation 1 throughout): byte b of an AC place
is the coefficient b (128..255) or b - 255 (0..127), whose magnitude category is always 8, and byte b of a DC place is
b - 128.  Each component is written by spectral selection (DC, then AC bands) and successive approximation (all but the
lowest bit, then the lowest bit), so nothing is lost.  The decoder accumulates the scans of a progressive JPEG into
coefficient arrays; scans in which every code has one length are read as whole arrays, others symbol by symbol.  The
inverse transform and the upsampling of chroma give full-resolution RGB tensors.

Texts are small and a file has 18 scans, so files are written and read many at a time: scans of one kind of all files of
a slice are one array, and the blocks of all files are one tall picture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import read_table, slices, text_or_empty, utf8_rows

UNIT = 192
BANDS = [(1, 5), (6, 63)]
_K = np.arange(8)
_DCT = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, 0.5**0.5, 1) / 2).astype(np.float32)
#: Natural place of each place in zigzag order.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


#: Bits of the magnitude of each number up to 255; longest run of blocks that one code can name; bytes of text or media
#: that are written or read together.
_SIZE = np.array([i.bit_length() for i in range(256)])
LONGEST_RUN = 32767
TOGETHER = 1 << 20


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, symbols: list[int], length: int) -> bytes:
    """A Huffman table whose codes all have ``length`` bits."""
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return _segment(0xC4, bytes([kind << 4, *counts, *symbols]))


def _scan(component: int, ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([1, component, 0, ss, se, ah << 4 | al]))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of every run of ``counts`` places."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _packed(bits: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The bits of each file, ``counts`` of them, as bytes of their own; ones fill the last byte."""
    sizes = -(-counts // 8)
    ends = np.cumsum(sizes)
    out = np.ones(8 * int(ends[-1]), np.uint8)
    out[_spread(8 * (ends - sizes), counts)] = bits
    return _cut(np.packbits(out).tobytes(), ends)


def _cut(data: bytes, ends: np.ndarray) -> list[bytes]:
    at = [0, *ends.tolist()]
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def _units(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Height and width of each picture in units of 16 x 16."""
    units = np.array([max(1, -(-len(p) // 384)) for p in payloads])
    across = -(-units // 4095)
    return -(-units // across), across


def _blocks(units: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each component the places of its blocks among those of all files, and how many each file has."""
    begin = 6 * (np.cumsum(units) - units)
    return [(_spread(begin + skip * units, n * units), n * units) for skip, n in ((0, 4), (4, 1), (5, 1))]


def _dc_scans(x: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """DC: differences of the halved values, in categories 0..7 with four-bit codes; then the lowest bits."""
    dc = x[:, 0].astype(np.int16) - 128
    half = dc >> 1
    before = np.concatenate([[0], half[:-1]])
    before[np.cumsum(counts) - counts] = 0
    diff = (half - before).astype(np.int64)
    size = _SIZE[np.abs(diff)]
    value = (size << 8) | (np.where(diff < 0, diff + (1 << size) - 1, diff) << (8 - size))
    places = np.arange(12)
    bits = (value[:, None] >> (11 - places) & 1).astype(np.uint8)[places < 4 + size[:, None]]
    return _packed(bits, np.add.reduceat(4 + size, np.cumsum(counts) - counts)), _packed((dc & 1).astype(np.uint8), counts)


def _refinement(low: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Runs of blocks without new coefficients, each followed by its correction bits."""
    runs = -(-counts // LONGEST_RUN)
    whose = np.repeat(np.arange(len(counts)), runs)
    run = np.minimum(LONGEST_RUN, counts[whose] - LONGEST_RUN * _spread(np.zeros(len(runs), np.int64), runs))
    r = np.floor(np.log2(run)).astype(np.int64)
    body = run * low.shape[1]
    begin = np.cumsum(4 + r + body) - (4 + r + body)
    bits = np.empty(int((4 + r + body).sum()), np.uint8)
    at = _spread(begin, 4 + r)
    bits[at] = np.repeat(r << r | (run - (1 << r)), 4 + r) >> (np.repeat(begin + 3 + r, 4 + r) - at) & 1
    bits[_spread(begin + 4 + r, body)] = low.ravel()
    return _packed(bits, np.bincount(whose, 4 + r + body, len(counts)).astype(np.int64))


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload; its length stands in a comment."""
    down, across = _units(payloads)
    units = down * across
    b = np.frombuffer(b"".join(p + b" " * (n * 384 - len(p)) for p, n in zip(payloads, units.tolist(), strict=True)), np.uint8).reshape(-1, 64)
    pieces: list[list[bytes] | bytes] = []
    for component, (places, counts) in zip((1, 2, 3), _blocks(units), strict=True):
        x = b[places]
        first, last = _dc_scans(x, counts)
        pieces += [_table(0, list(range(8)), 4) + _scan(component, 0, 0, 0, 1), first, _scan(component, 0, 0, 1, 0), last]
        # AC: one symbol (no run, category 7) of one bit "0" and seven bits, so a coefficient is the byte b >> 1.
        head = _table(1, [0x07], 1)
        for lo, hi in BANDS:
            pieces += [head + _scan(component, lo, hi, 0, 1), _cut(np.ascontiguousarray(x[:, lo : hi + 1] >> 1).tobytes(), np.cumsum(counts * (hi + 1 - lo)))]
            head = b""
        low = np.where(x >= 128, x & 1, 1 - (x & 1))
        head = _table(1, [r << 4 for r in range(15)], 4)
        for lo, hi in BANDS:
            pieces += [head + _scan(component, lo, hi, 1, 0), _refinement(low[:, lo : hi + 1], counts)]
            head = b""
    quantisation = _segment(0xDB, bytes([0]) + b"\x01" * 64)
    out = []
    for i, (payload, h, w) in enumerate(zip(payloads, down.tolist(), across.tolist(), strict=True)):
        frame = bytes([8]) + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        scans = [p if isinstance(p, bytes) else p[i].replace(b"\xff", b"\xff\x00") for p in pieces]
        out.append(b"".join([b"\xff\xd8", _segment(0xFE, len(payload).to_bytes(8, "big")), quantisation, _segment(0xC2, frame), *scans, b"\xff\xd9"]))
    return out


def encode(payload: bytes) -> bytes:
    return encode_all([payload])[0]


class _Bits:
    """Reads an entropy-coded segment symbol by symbol."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data + b"\xff\xff\xff\xff", np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        v = 0
        for n in range(1, 17):
            v = v << 1 | self.bits[self.at]
            self.at += 1
            if (n, v) in codes:
                return codes[n, v]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


@lru_cache(256)
def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a canonical table."""
    out, code, k = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _dc_first(data: bytes, blocks: list[np.ndarray], turns: list[int], tables: list[dict], al: int) -> None:
    """``turns``: the component of each block in the order of the scan."""
    if len(blocks) == 1 and {n for n, _ in tables[0]} == {4}:
        blocks[0][:, 0] = np.cumsum(_short_codes(data, tables[0], [0], [len(turns)])) << al
        return
    reader, last, seen = _Bits(data), [0] * len(blocks), [0] * len(blocks)
    for c in turns:
        last[c] += reader.signed(reader.symbol(tables[c]))
        blocks[c][seen[c], 0] = last[c] << al
        seen[c] += 1


def _dc_refine(data: bytes, blocks: list[np.ndarray], turns: list[int], al: int) -> None:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(turns))
    if len(blocks) == 1:
        blocks[0][:, 0] |= bits.astype(np.int32) << al
        return
    order = np.array(turns)
    for c, x in enumerate(blocks):
        x[:, 0] |= bits[order == c].astype(x.dtype) << al


def _ac_first(data: bytes, x: np.ndarray, table: dict, ss: int, se: int, al: int) -> None:
    if list(table) == [(1, 0)] and table[1, 0] == 7:
        v = np.frombuffer(data, np.uint8, len(x) * (se - ss + 1)).reshape(len(x), -1).astype(x.dtype)
        x[:, ss : se + 1] = (v - 127 * (v < 64)) << al
        return
    reader, run = _Bits(data), 0
    for block in x:
        if run:
            run -= 1
            continue
        k = ss
        while k <= se:
            r, s = divmod(reader.symbol(table), 16)
            if s:
                k += r
                block[k] = reader.signed(s) * (1 << al)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + reader.take(r) - 1
                break


def _ac_refine(data: bytes, x: np.ndarray, table: dict, ss: int, se: int, al: int) -> None:
    part, bit = x[:, ss : se + 1], 1 << al
    if (part != 0).all() and {n for n, _ in table} == {4}:
        bits, at, done = np.unpackbits(np.frombuffer(data, np.uint8)), 0, 0
        while done < len(x):
            r = table[4, int(bits[at : at + 4] @ (8, 4, 2, 1))] >> 4
            run = (1 << r) + int("".join(map(str, bits[at + 4 : at + 4 + r])) or "0", 2)
            at += 4 + r
            fixed = bits[at : at + run * part.shape[1]].reshape(run, -1)
            low = part[done : done + run]
            low += np.where(low > 0, bit, -bit).astype(x.dtype) * fixed
            at, done = at + fixed.size, done + run
        return
    reader, run = _Bits(data), 0
    for block in x:
        k = ss
        while k <= se and not run:
            r, s = divmod(reader.symbol(table), 16)
            new = (bit if reader.take(1) else -bit) if s else 0
            if not s and r < 15:
                run = (1 << r) + reader.take(r)
                break
            while k <= se:
                if block[k]:
                    if reader.take(1):
                        block[k] += bit if block[k] > 0 else -bit
                elif r == 0:
                    block[k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        if run:
            for k in range(k, se + 1):
                if block[k] and reader.take(1):
                    block[k] += bit if block[k] > 0 else -bit
            run -= 1


def _parse(media: bytes) -> tuple[dict, list[tuple]]:
    """The frame (size, sampling, tables, comment), and each scan: components and tables, table bytes, selection, data."""
    at, tables, frame, scans = 2, {}, {"quantisation": {}, "comment": b""}, []
    while media[at + 1] != 0xD9:
        marker, length = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body = media[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            frame["comment"] = body
        elif marker == 0xDB:
            while body:
                frame["quantisation"][body[0] & 15], body = np.frombuffer(body, np.uint8, 64, 1).astype(np.float32), body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xDD and any(body):
            raise ValueError("restart intervals are not supported")
        elif marker == 0xC2:
            frame["height"], frame["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            frame["parts"], h, v = parts, max(p[1] for p in parts), max(p[2] for p in parts)
            frame["units"] = (-(-frame["height"] // (8 * v)), -(-frame["width"] // (8 * h)))
            frame["grid"] = [(frame["units"][0] * p[2], frame["units"][1] * p[1]) for p in parts]
        elif marker == 0xC0 or marker == 0xC1:
            raise ValueError("not a progressive JPEG")
        elif marker == 0xDA:
            end = at
            while True:  # the next marker that is not stuffing
                end = media.index(b"\xff", end)
                if media[end + 1]:
                    break
                end += 2
            data, at = media[at:end].replace(b"\xff\x00", b"\xff"), end
            names = [p[0] for p in frame["parts"]]
            chosen = tuple((names.index(body[1 + 2 * k]), body[2 + 2 * k]) for k in range(body[0]))
            selection = (body[-3], body[-2], body[-1] >> 4, body[-1] & 15)
            used = [tables.get(t >> 4) if selection[0] == 0 else tables[0x10 | t & 15] for _, t in chosen]
            scans.append((chosen, tuple(used), selection, data))
    return frame, scans


def decode(media: bytes) -> tuple[list[np.ndarray], dict]:
    """Coefficients (blocks, 64) of each component in zigzag order, and the frame."""
    return _decoded(*_parse(media))


def _decoded(frame: dict, scans: list[tuple]) -> tuple[list[np.ndarray], dict]:
    coefficients = [np.zeros((a * b, 64), np.int32) for a, b in frame["grid"]]
    for chosen, used, selection, data in scans:
        _accumulate(data, coefficients, frame, chosen, [_codes(*u) if u else None for u in used], selection)
    return coefficients, frame


def decode_all(files: list[bytes]) -> list[tuple[list[int], list[np.ndarray], list[dict]]]:
    """Groups of files that were read together: their numbers, the coefficients of each component one file after the
    other, and their frames.  Files with the same scans in codes of one length share a group, others come alone."""
    groups: dict[tuple, list[int]] = {}
    parsed = [_parse(f) for f in files]
    for i, (frame, scans) in enumerate(parsed):
        h, v = max(p[1] for p in frame["parts"]), max(p[2] for p in frame["parts"])
        whole = frame["height"] % (8 * v) == 0 and frame["width"] % (8 * h) == 0
        same = (tuple(frame["parts"]), frame["units"][1], tuple(q.tobytes() for q in frame["quantisation"].values()), tuple(x[:3] for x in scans)) if whole else (i,)
        groups.setdefault(same, []).append(i)
    out = []
    for numbers in groups.values():
        frames = [parsed[i][0] for i in numbers]
        counts = [np.array([f["grid"][c][0] * f["grid"][c][1] for f in frames]) for c in range(len(frames[0]["parts"]))]
        together = [np.zeros((int(n.sum()), 64), np.int32) for n in counts]
        if len(numbers) > 1 and all(_accumulate_all([parsed[i][1][k] for i in numbers], together, counts) for k in range(len(parsed[numbers[0]][1]))):
            out.append((numbers, together, frames))
        else:
            out += [([i], _decoded(*parsed[i])[0], [parsed[i][0]]) for i in numbers]
    return out


def _accumulate_all(scans: list[tuple], coefficients: list[np.ndarray], counts: list[np.ndarray]) -> bool:
    """Adds one scan of each of several files, if all of its codes have one length; says whether it could."""
    chosen, used, (ss, se, ah, al), _ = scans[0]
    if len(chosen) != 1:
        return False
    x, n = coefficients[chosen[0][0]], counts[chosen[0][0]]
    table = _codes(*used[0]) if used[0] else {}
    data = [s[3] for s in scans]
    sizes = np.array([len(d) for d in data])
    begin, width = 8 * (np.cumsum(sizes) - sizes), se - ss + 1
    if ss == 0 and ah:
        bits = np.unpackbits(np.frombuffer(b"".join(data), np.uint8))
        x[:, 0] |= bits[_spread(begin, n)].astype(np.int32) << al
        return True
    if ss == 0 and {k for k, _ in table} == {4}:
        diff = _short_codes(b"".join(data), table, begin.tolist(), n.tolist())
        total = np.cumsum(diff)
        first = np.cumsum(n) - n
        x[:, 0] = (total - np.repeat(total[first] - diff[first], n)) << al
        return True
    if ss and not ah and list(table) == [(1, 0)] and table[1, 0] == 7:
        v = np.frombuffer(b"".join([d[: k * width] for d, k in zip(data, n.tolist(), strict=True)]), np.uint8).reshape(-1, width).astype(np.int32)
        x[:, ss : se + 1] = (v - 127 * (v < 64)) << al
        return True
    if ss and ah and {k for k, _ in table} == {4} and (x[:, ss : se + 1] != 0).all():
        heads = []
        for d, k in zip(data, n.tolist(), strict=True):
            v = int.from_bytes(d[:4].ljust(4, b"\xff"), "big")
            r = table.get((4, v >> 28), 255) >> 4
            if r > 14 or (1 << r) + (v >> (28 - r) & ((1 << r) - 1)) != k:
                return False  # several runs
            heads.append(4 + r)
        fixed = np.unpackbits(np.frombuffer(b"".join(data), np.uint8))[_spread(begin + np.array(heads), n * width)].reshape(-1, width)
        low = x[:, ss : se + 1]
        low += np.where(low > 0, 1 << al, -(1 << al)) * fixed
        return True
    return False


def _short_codes(data: bytes, table: dict, begin: list[int], counts: list[int]) -> np.ndarray:
    """Values of ``counts`` four-bit codes, each followed by as many bits as it says, from each of the places ``begin``."""
    bits = np.unpackbits(np.frombuffer(data + b"\xff\xff", np.uint8)).astype(np.int32)
    window = bits[:-15]
    for k in range(1, 16):
        window = window << 1 | bits[k : len(bits) - 15 + k]
    sizes = [table.get((4, c), 0) for c in range(16)]
    step, starts = (np.array(sizes)[window >> 12] + 4).tolist(), []
    for at, n in zip(begin, counts, strict=True):
        for _ in range(n):
            starts.append(at)
            at += step[at]
    w = window[starts]
    size = np.array(sizes)[w >> 12]
    v = (w & 0xFFF) >> (12 - size)
    return np.where((size > 0) & (v < 1 << np.maximum(size - 1, 0)), v - (1 << size) + 1, v)


def _accumulate(data: bytes, coefficients: list[np.ndarray], frame: dict, chosen: tuple[tuple[int, int], ...], tables: list[dict], selection: tuple[int, int, int, int]) -> None:
    """Adds one scan to the coefficient arrays; blocks are visited in the scan's order, by MCU if it is interleaved."""
    ss, se, ah, al = selection
    places = []
    for i, _ in chosen:
        (down, across), (_, h, v, _) = frame["grid"][i], frame["parts"][i]
        if len(chosen) > 1:
            places.append(np.arange(down * across).reshape(down // v, v, across // h, h).transpose(0, 2, 1, 3).reshape(-1, v * h))
            continue
        # A scan of one component visits the blocks that hold picture only; most often these are all, in order.
        hm, vm = max(p[1] for p in frame["parts"]), max(p[2] for p in frame["parts"])
        used = -(-frame["height"] * v // (8 * vm)), -(-frame["width"] * h // (8 * hm))
        places.append(None if used == (down, across) else np.arange(down * across).reshape(down, across)[: used[0], : used[1]].reshape(-1, 1))
    blocks = [coefficients[i] if p is None else coefficients[i][p.ravel()] for (i, _), p in zip(chosen, places, strict=True)]
    if ss == 0:
        turns = [0] * len(blocks[0]) if len(chosen) == 1 else [c for c, p in enumerate(places) for _ in range(p.shape[1])] * len(places[0])
        if ah:
            _dc_refine(data, blocks, turns, al)
        else:
            _dc_first(data, blocks, turns, tables, al)
    else:
        (_ac_refine if ah else _ac_first)(data, blocks[0], tables[0], ss, se, al)
    for (i, _), p, x in zip(chosen, places, blocks, strict=True):
        if p is not None:
            coefficients[i][p.ravel()] = x


def payloads_of(coefficients: list[np.ndarray], frames: list[dict]) -> list[bytes]:
    """The payloads of files that ``encode_all`` wrote, from their coefficients one file after the other."""
    units = np.array([f["units"][0] * f["units"][1] for f in frames])
    b = np.empty((6 * int(units.sum()), 64), np.uint8)
    for (places, _), x in zip(_blocks(units), coefficients, strict=True):
        y = np.where(x > 0, x, x + 255)
        y[:, 0] = x[:, 0] + 128
        b[places] = y
    return [d[: int.from_bytes(f["comment"], "big")] for d, f in zip(_cut(b.tobytes(), 384 * np.cumsum(units)), frames, strict=True)]


def tensors_of(coefficients: list[np.ndarray], frames: list[dict]) -> list[np.ndarray]:
    """The tensor of each file of a group of ``decode_all``, as one tall picture is one below the other."""
    if len(frames) == 1:
        return [tensor_of(coefficients, frames[0])]
    heights = np.array([f["height"] for f in frames])
    grid = [(sum(f["grid"][c][0] for f in frames), frames[0]["grid"][c][1]) for c in range(len(coefficients))]
    return np.split(tensor_of(coefficients, frames[0] | {"grid": grid, "height": int(heights.sum())}), np.cumsum(heights)[:-1])


def _transformed(x: np.ndarray) -> np.ndarray:
    """``x @ _DCT`` for rows of eight, in a fixed order of sums: a library's product may differ with the number of rows."""
    out = x[:, :1] * _DCT[0]
    for k in range(1, 8):
        out += x[:, k : k + 1] * _DCT[k]
    return out


def tensor_of(coefficients: list[np.ndarray], frame: dict) -> np.ndarray:
    """(height, width, 3) RGB of 8 bits: inverse transform, chroma repeated to full resolution, colour conversion."""
    planes = []
    h, v = max(p[1] for p in frame["parts"]), max(p[2] for p in frame["parts"])
    for x, (down, across), (_, ph, pv, q) in zip(coefficients, frame["grid"], frame["parts"], strict=True):
        natural = np.empty(x.shape, np.float32)
        natural[:, _ZIGZAG] = x * frame["quantisation"][q]
        half = _transformed(natural.reshape(-1, 8)).reshape(-1, 8, 8)
        pixels = _transformed(half.transpose(0, 2, 1).reshape(-1, 8)).reshape(down, across, 8, 8)
        plane = pixels.transpose(0, 3, 1, 2).reshape(8 * down, 8 * across)
        planes.append(plane.repeat(v // pv, axis=0).repeat(h // ph, axis=1) if (ph, pv) != (h, v) else plane)
    y, cb, cr = planes if len(planes) == 3 else (planes[0], np.float32(0), np.float32(0))
    y = y + np.float32(128)
    rgb = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=-1)
    return np.clip(np.rint(rgb[: frame["height"], : frame["width"]]), 0, 255).astype(np.uint8)


def to_media(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes, media (binary) of each whole text in UTF-8, padded with spaces to a positive multiple of ``unit``.

    Null counts as empty; equal texts give equal media; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TOGETHER):
                texts = utf8_rows(part, "text")
                media = encode_all([t + b" " * (max(unit, -(-len(t) // unit) * unit) - len(t)) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, media binary")


def from_media(media: DataFrame, tensors: bool = True) -> DataFrame:
    """Reads ``media`` back: doc_id, n_bytes, figures of payload and media, a feature of the picture, and the tensor.

    ``tensor`` is struct<height, width, data>, RGB of 8 bits in rows at full resolution; it is null when ``tensors`` is
    false, so that a reader of figures alone need not move it.  ``media`` are files of ``to_media``, not null.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensor"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])]

    def figures(files: list[bytes]) -> list[tuple]:
        found: dict[int, tuple] = {}
        for numbers, coefficients, frames in decode_all(files):
            for i, payload, rgb, frame in zip(numbers, payloads_of(coefficients, frames), tensors_of(coefficients, frames), frames, strict=True):
                mean = rgb.reshape(-1, 3).mean(axis=0, dtype=np.float64)
                data = rgb.tobytes()
                feature = f"{frame['width']}x{frame['height']}:{mean[0]:.4f},{mean[1]:.4f},{mean[2]:.4f}:{zlib.crc32(data):08x}"
                tensor = {"height": frame["height"], "width": frame["width"], "data": data} if tensors else None
                found[i] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(files[i]), hashlib.sha256(files[i]).hexdigest(), feature, tensor
        return [found[i] for i in range(len(files))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media", TOGETHER):
                found = figures(part.column("media").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names)

    schema = f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tensor struct<height:int,width:int,data:binary>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_media(to_media(read_table(spark, sf_dir, "documents")))
