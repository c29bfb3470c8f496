import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media_jpeg as M
from tessera.llm import sentencepiece_sampling as S


@pytest.mark.parametrize("n", [192, 384, 576, 1920, 192 * 700])
def test_jpeg_round_trip(n):
    p = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    coefficients, frame = M.decode(M.encode(p))
    assert M.payloads_of(coefficients, [frame]) == [p]
    assert M.tensor_of(coefficients, frame).shape == (frame["height"], frame["width"], 3)


def test_symbolwise_paths_agree_with_whole_arrays(monkeypatch):
    p = np.random.default_rng(1).integers(0, 256, 1920, dtype=np.uint8).tobytes()
    media = M.encode(p)
    whole = M.decode(media)[0]

    class Many(dict):  # tables that do not look uniform are read symbol by symbol
        def __iter__(self):
            return iter([*super().__iter__(), (16, 70000)])

    real = M._codes
    monkeypatch.setattr(M, "_codes", lambda c, s: Many(real(c, s)))
    slow = M.decode(media)[0]
    assert all((a == b).all() for a, b in zip(whole, slow, strict=True))


def test_files_read_together_are_those_read_alone():
    rng = np.random.default_rng(3)
    sizes = [192, 5000, 192, 384, 192 * 40, 70_000]
    payloads = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in sizes]
    files = M.encode_all(payloads)
    assert files == [M.encode(p) for p in payloads]
    groups = M.decode_all([*files, general(*picture(rng, [(1, 1)], 20, 9))])
    assert [g[0] for g in groups] == [[0, 1, 2, 3, 4, 5], [6]]
    _, coefficients, frames = groups[0]
    assert M.payloads_of(coefficients, frames) == payloads
    assert all((a == M.tensor_of(*M.decode(f))).all() for a, f in zip(M.tensors_of(coefficients, frames), files, strict=True))
    long = rng.integers(0, 256, 384 * 9000, dtype=np.uint8).tobytes()  # over one run of blocks, and over one column of units
    assert M.payloads_of(*(lambda c, f: (c, [f]))(*M.decode(M.encode(long)))) == [long]


def picture(rng, sampling, height, width):
    """Sparse coefficients of components with the given (h, v), zero where a scan of one component has no block."""
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    units = -(-height // (8 * v)), -(-width // (8 * h))
    parts = []
    for ch, cv in sampling:
        grid = (units[0] * cv, units[1] * ch)
        x = np.where(rng.random((*grid, 64)) < 0.12, rng.integers(-90, 91, (*grid, 64)), 0)
        x[rng.random(grid) < 0.5, 1:] = 0
        used = -(-height * cv // (8 * v)), -(-width * ch // (8 * h))
        x[used[0] :, :, 1:] = 0
        x[:, used[1] :, 1:] = 0
        parts.append(x)
    return parts, sampling, height, width


def general(parts, sampling, height, width):
    """A progressive JPEG written block by block as the standard says: interleaved DC scans, AC scans with zero runs,
    end-of-band runs and, in refinement, new coefficients among correction bits.  Symbols have codes of 9 or 10 bits."""
    table = bytes([0] * 8 + [255, 1] + [0] * 6 + list(range(256)))
    code = lambda s: [int(b) for b in (f"{s:09b}" if s < 255 else f"{255 << 1:010b}")]
    of = lambda v, n: [int(b) for b in f"{v:0{n}b}"] if n else []
    pack = lambda bits: np.packbits(bits + [1] * (-len(bits) % 8)).tobytes().replace(b"\xff", b"\xff\x00")
    seg = lambda m, body: bytes([255, m]) + (len(body) + 2).to_bytes(2, "big") + body
    signed = lambda d: (n := abs(d).bit_length()) and of(d if d > 0 else d + (1 << n) - 1, n) or []
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    frame = bytes([8, *height.to_bytes(2, "big"), *width.to_bytes(2, "big"), len(parts)]) + b"".join(bytes([i + 1, ch << 4 | cv, 0]) for i, (ch, cv) in enumerate(sampling))
    out = [b"\xff\xd8", seg(0xDB, b"\0" + bytes([2] * 64)), seg(0xC2, frame), seg(0xC4, b"\0" + table), seg(0xC4, b"\x10" + table)]
    order = []  # blocks of an interleaved scan
    for r in range(parts[0].shape[0] // sampling[0][1]):
        for c in range(parts[0].shape[1] // sampling[0][0]):
            order += [(i, r * cv + y, c * ch + x) for i, (ch, cv) in enumerate(sampling) for y in range(cv) for x in range(ch)]
    if len(parts) == 1:
        order = [(0, y, x) for y in range(-(-height // 8)) for x in range(-(-width // 8))]
    last, first, again = [0] * len(parts), [], []
    for i, y, x in order:
        d = (int(parts[i][y, x, 0]) >> 1) - last[i]
        last[i] += d
        first += code(abs(d).bit_length()) + signed(d)
        again.append(int(parts[i][y, x, 0]) & 1)
    heads = lambda ss, se, a, only: seg(0xDA, bytes([len(only), *(b for i in only for b in (i + 1, 0)), ss, se, a]))
    every = range(len(parts))
    out += [heads(0, 0, 0x01, every), pack(first), heads(0, 0, 0x10, every), pack(again)]
    for i, (ch, cv) in enumerate(sampling):
        used = parts[i][: -(-height * cv // (8 * v)), : -(-width * ch // (8 * h))].reshape(-1, 64).tolist()
        for lo, hi in ((1, 9), (10, 63)):
            for al in (1, 0):
                bits, run, tail = [], 0, []

                def end_of_bands():
                    nonlocal run, tail
                    if run:
                        n = run.bit_length() - 1
                        bits.extend(code(n << 4) + of(run - (1 << n), n))
                    bits.extend(tail)
                    run, tail = 0, []

                for block in used:
                    now = [(-1 if c < 0 else 1) * (abs(c) >> al) for c in block]
                    old = [0] * 64 if al else [abs(c) >> 1 for c in block]
                    new = [k for k in range(lo, hi + 1) if now[k] and not old[k]]
                    zeros, fix = 0, []
                    for k in range(lo, (new[-1] if new else lo - 1) + 1):
                        if old[k]:
                            fix.append(abs(now[k]) & 1)
                        elif not now[k]:
                            zeros += 1
                            if zeros == 16:  # written when a new coefficient is still to come, which it is
                                end_of_bands()
                                bits += code(0xF0) + fix
                                zeros, fix = 0, []
                        else:
                            end_of_bands()
                            bits += code(zeros << 4 | (abs(now[k]).bit_length() if al else 1)) + (signed(now[k]) if al else [int(now[k] > 0)]) + fix
                            zeros, fix = 0, []
                    if not new or new[-1] < hi:
                        run += 1
                        tail += [abs(now[k]) & 1 for k in range((new[-1] if new else lo - 1) + 1, hi + 1) if old[k]]
                        if run == 32767:
                            end_of_bands()
                end_of_bands()
                out += [heads(lo, hi, 0x01 if al else 0x10, [i]), pack(bits)]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("sampling, height, width", [([(1, 1)], 40, 33), ([(2, 2), (1, 1), (1, 1)], 37, 70), ([(2, 1), (1, 1), (1, 1)], 24, 100), ([(1, 1)] * 3, 8, 8)])
def test_files_of_another_encoder(sampling, height, width):
    parts, *rest = picture(np.random.default_rng(height), sampling, height, width)
    coefficients, frame = M.decode(general(parts, *rest))
    assert all((c == p.reshape(-1, 64)).all() for c, p in zip(coefficients, parts, strict=True))
    assert M.tensor_of(coefficients, frame).shape == (height, width, 3)


def test_flat_block_is_flat():
    coefficients = [np.zeros((4, 64), np.int32), np.zeros((1, 64), np.int32), np.zeros((1, 64), np.int32)]
    coefficients[0][:, 0] = 80
    frame = M.decode(M.encode(b" " * 192))[1]
    assert (M.tensor_of(coefficients, frame) == 138).all()


def test_media_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 100), (4, "x" * 100_000), (5, "é" * 100), (5, "é" * 100), (None, "a")]
    d = spark.createDataFrame([(i, t, b"clash") for i, t in rows], "doc_id bigint, text string, media binary")
    got = M.from_media(M.to_media(d)).collect()
    for (_, t), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id,))), strict=True):
        raw = (t or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        if r.doc_id not in (5, None):
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    same = {(r.payload_sha256, r.media_sha256, r.feature) for r in got if r.doc_id in (3, 5)}
    assert len(same) == 1 and all(len(r.tensor.data) == r.tensor.height * r.tensor.width * 3 for r in got)
    assert M.from_media(M.to_media(d.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(S.MARK + " a\x01\u0378", max_size=12), min_size=1, max_size=4))
def test_any_text_survives(texts):
    ids = S.sample(texts, np.arange(len(texts)).astype(np.uint64), S.default_model())
    assert [S.decode(x, S.default_model()) for x in ids] == texts


def test_a_text_that_holds_the_mark_is_sampled_like_any_other():
    model, text = S.lattices(S.default_model(), S.ALPHA), "some text with a \u2581 mark and \u2581words behind it, at the end \u2581"
    keys = np.arange(40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = S.sample([text] * 40, keys, S.default_model())
    plain = S.sample([text.replace(S.MARK, "")] * 40, keys, S.default_model())
    mark = [model.byte_ids[b] for b in S.MARK.encode()]
    assert all(S.decode(x, S.default_model()) == text for x in got) and len({tuple(x) for x in got}) > 20
    for x, y in zip(got, plain, strict=True):
        byte = [i in set(model.byte_ids.values()) for i in x.tolist()]
        assert sum(byte) == 9 and [i for i, b in zip(x.tolist(), byte, strict=True) if b] == mark * 3 and len(x) < len(y) + 20


def test_sampling_follows_the_lattice():
    model = S.lattices(S.default_model(), S.ALPHA)
    n = 4000
    got = S.sample(["at"] * n, np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), S.default_model())
    w = lambda p: np.exp(model.weight[p][1])
    ways = {("▁at",): w("▁at"), ("▁a", "t"): w("▁a") * w("t"), ("▁", "at"): w("▁") * w("at"), ("▁", "a", "t"): w("▁") * w("a") * w("t")}
    seen = {k: 0 for k in ways}
    for x in got:
        seen[tuple(model.bytes_of[i].decode().replace(" ", S.MARK) for i in x)] += 1
    total = sum(ways.values())
    assert all(abs(seen[k] / n - v / total) < 0.04 for k, v in ways.items())


def test_pieces_do_not_depend_on_partitions(spark):
    rows = [(i, f"some text number {i} and é▁ more " * (i % 3)) for i in range(30)] + [(None, "x"), (40, None), (41, "y " * 30_000), (7, "some text")]
    d = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, ids int")
    runs = [sorted(map(str, S.decode_rows(S.encode(d.repartition(k), S.default_model()), S.default_model()).collect())) for k in (1, 5)]
    assert runs[0] == runs[1] and "lossless=False" not in "".join(runs[0])
    assert S.encode(d.limit(0), S.default_model()).count() == 0
