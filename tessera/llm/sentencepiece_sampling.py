"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

No piece has a word boundary mark inside, so the lattice of a text falls into units, a run of marks and the word after
it, that are independent given the model.  Forward filtering computes, for each distinct unit, the log weight of all
segmentations of every prefix and so the distribution of the piece that ends there.  Backward sampling walks all units
of all rows of a slice together: in each step every unfinished unit draws the piece that ends where it stands.  The
draws are hashes of the row key, the unit's place and the step, so a row's segmentation does not depend on batches,
partitions or other rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read_table, slices, text_or_empty

MARK = "▁"
#: Stands for a mark of the text itself while it is cut: a lone surrogate, which no text can hold.
OWN_MARK = "\ud800"
#: Weight of a piece is exp(ALPHA * score); scores of the vocabulary fall by one from piece to piece.
ALPHA = 1e-4
SEED = 17
#: Distinct units whose lattices a Python worker remembers, by their total length.
CACHED_CHARACTERS = 3 << 20
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_TURN = np.uint64(0x9E3779B97F4A7C15)
_MODELS: dict[tuple[str, float], Lattices] = {}


class Lattices:
    """Filtered lattices of units, kept as flat arrays: state -> its edges' cumulative probabilities, pieces, lengths."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("lossless decoding asks for a vocabulary with byte fallback")
        self.weight = {names[i]: (i, alpha * model.get_score(i)) for i in plain}
        if any(MARK in n.lstrip(MARK) for n in self.weight):
            raise ValueError("a piece with an inner word mark would join units")
        self.fallback = alpha * (min(model.get_score(i) for i in plain) - 10)
        self.bytes_of = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else names[i].replace(MARK, " ").encode() for i in range(size)]
        #: By length: sorted hashes of the beginnings of pieces, and which are pieces (id or -1, weight).
        self.tables = []
        for length in range(1, max(map(len, self.weight)) + 1):
            heads = sorted({n[:length] for n in self.weight if len(n) >= length})
            h, codes = np.zeros(len(heads), np.uint64), np.array([[ord(c) for c in n] for n in heads], np.uint64).reshape(len(heads), length)
            for k in range(length):
                h = h * _TURN + codes[:, k] + np.uint64(1)
            order = np.argsort(h)
            found = [self.weight.get(n, (-1, 0.0)) for n in heads]
            self.tables.append((h[order], np.array([i for i, _ in found], np.int32)[order], np.array([w for _, w in found])[order]))
        self.clear()

    def clear(self) -> None:
        """States are numbered through all units; a unit has one for its start and one behind each character."""
        self.ends: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)
        self.cumulative, self.jump, self.piece = np.zeros(0, np.float32), np.zeros(0, np.int16), np.zeros(0, np.int32)

    def add(self, units: list[str]) -> None:
        """Forward filtering of new units, short ones together and long ones each alone."""
        for group in [[u for u in units if len(u) <= 32], *([u] for u in units if len(u) > 32)]:
            if group:
                self._filter(group)

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, piece, weight) of all pieces in the characters ``codes``, ``left`` of which belong to the unit.

        Only places where some piece could still go on are looked at again for the next length.  A character that is
        no piece gets a fallback edge, whose bytes are written in full later.
        """
        at, h, out = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        plain = np.zeros(len(codes), bool)
        for k, (hashes, ids, weights) in enumerate(self.tables):
            keep = left[at] > k
            at, h = at[keep], h[keep]
            if not len(at):
                break
            h = h * _TURN + codes[at + k] + np.uint64(1)
            found = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[found] == h
            at, h, found = at[hit], h[hit], found[hit]
            whole = ids[found] >= 0
            out.append((at[whole], np.full(int(whole.sum()), k + 1), ids[found[whole]], weights[found[whole]]))
            if k == 0:
                plain[at[whole]] = True
        rare = np.flatnonzero(~plain)
        out.append((rare, np.ones(len(rare), np.int64), -codes[rare].astype(np.int32) - 1, np.full(len(rare), self.fallback)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _filter(self, units: list[str]) -> None:
        """Sums over all segmentations, one end after the other for all units at once."""
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(u) for u in units])
        begin, n = np.cumsum(sizes) - sizes, len(codes)
        unit_of = np.repeat(np.arange(len(units)), sizes)
        start, length, piece, weight = self._edges(codes, (begin + sizes)[unit_of] - np.arange(n))
        unit = unit_of[start]
        end = start - begin[unit] + length
        order = np.argsort((end * len(units) + unit) * 64 + length)
        end, unit, length, weight = end[order], unit[order], length[order], weight[order]
        alpha, share = np.zeros((len(units), int(sizes.max()) + 1)), np.zeros(len(end))
        cuts = np.searchsorted(end, np.arange(1, int(sizes.max()) + 2))
        for e, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), 1):
            u = unit[a:b]
            score = alpha[u, e - length[a:b]] + weight[a:b]
            heads = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            size = np.diff(np.append(heads, b - a))
            top = np.maximum.reduceat(score, heads)
            p = np.exp(score - np.repeat(top, size))
            total = np.add.reduceat(p, heads)
            alpha[u[heads], e] = top + np.log(total)
            share[a:b] = p / np.repeat(total, size)
        state = begin[unit] + end + unit
        by_state = np.argsort(state * 64 + length)
        counts = np.bincount(state, minlength=n + len(units))
        ends = np.cumsum(counts)
        run = np.cumsum(share[by_state])
        run = run - np.repeat(np.concatenate([[0.0], run])[ends - counts], counts)
        run[ends[counts > 0] - 1] = 1.0
        base, edges = len(self.first) - 1, len(self.cumulative)
        self.cumulative = np.concatenate([self.cumulative, run.astype(np.float32)])
        self.jump = np.concatenate([self.jump, length[by_state].astype(np.int16)])
        self.piece = np.concatenate([self.piece, piece[order][by_state]])
        self.first = np.concatenate([self.first, edges + ends])
        self.ends.update(zip(units, (base + begin + np.arange(len(units)) + sizes).tolist(), strict=True))


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _MODELS:
        _MODELS[path, alpha] = Lattices(path, alpha)
    return _MODELS[path, alpha]


def _uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers of [0, 1) from 64-bit keys."""
    x = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def sample(texts: list[str], keys: np.ndarray, path: str, alpha: float = ALPHA) -> list[np.ndarray]:
    """Sampled ids of each text; ``keys``: one 64-bit number a row, from its row key and the seed."""
    model = lattices(path, alpha)
    units = [_UNIT.findall(MARK + t.replace(MARK, OWN_MARK).replace(" ", MARK)) if t else [] for t in texts]
    if len(model.first) > CACHED_CHARACTERS:
        model.clear()
    model.add(sorted({u for row in units for u in row if u not in model.ends}))
    first, cumulative, jump, piece = model.first, model.cumulative, model.jump, model.piece
    sizes = np.array([len(row) for row in units])
    state = np.array([model.ends[u] for row in units for u in row], np.int64)
    if not len(state):
        return [np.zeros(0, np.int32) for _ in texts]
    starts = state - np.array([len(u) for row in units for u in row])
    place = np.arange(len(state)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    draw = np.repeat(keys, sizes) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    active, drawn = np.arange(len(state)), []
    step = 0
    while len(active):
        at = state[active]
        u = _uniform(draw[active] + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
        edge = first[at]
        todo = np.flatnonzero(first[at + 1] - edge > 1)
        while len(todo):  # few pieces end at a place, and the last one's share reaches 1
            todo = todo[cumulative[edge[todo]] <= u[todo]]
            edge[todo] += 1
        drawn.append((active, piece[edge]))
        state[active] = at - jump[edge]
        active = active[state[active] > starts[active]]
        step += 1
    # Steps run from the end of a unit to its start: order by unit, latest step first, and write fallback bytes out.
    unit = np.concatenate([a for a, _ in drawn])
    found = np.concatenate([p for _, p in drawn])
    steps = np.repeat(np.arange(len(drawn)), [len(a) for a, _ in drawn])
    order = np.lexsort((-steps, unit))
    unit, found = unit[order], found[order]
    rare = np.flatnonzero(found < 0)
    if len(rare):
        parts = {c: [model.byte_ids[b] for b in chr(-c - 1).replace(OWN_MARK, MARK).encode()] for c in set(found[rare].tolist())}
        width = np.ones(len(found), np.int64)
        width[rare] = [len(parts[c]) for c in found[rare].tolist()]
        at = np.cumsum(width) - width
        unit, spread = np.repeat(unit, width), np.repeat(found, width)
        for k in rare.tolist():
            spread[at[k] : at[k] + width[k]] = parts[int(found[k])]
        found = spread
    row = np.repeat(np.arange(len(texts)), sizes)[unit]
    return np.split(found.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts))))


def decode(ids: np.ndarray, path: str, alpha: float = ALPHA) -> str:
    """The text of ids; of any segmentation of a text, that text.

    Marks of pieces are spaces, before bytes are joined; the mark of the text itself is always written in bytes.
    """
    return b"".join(map(lattices(path, alpha).bytes_of.__getitem__, ids.tolist())).decode()[1:]


def encode(docs: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, text, ids (array<int>): one sampled segmentation of each whole text.

    Null counts as empty, and an empty text has no ids.  The word mark itself, if a text holds it, is written in bytes,
    which tells it from a space; the rest of the text is sampled as any other.  Rows with equal doc_id and text get
    equal ids, a null doc_id is a key like any other, an empty table gives an empty result, and other columns are not
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                keys = part.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
                ids = sample(part.column("text").to_pylist(), keys, path, alpha)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), lists], ["doc_id", "text", "ids"])

    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")).alias("key")
    rows = docs.select("doc_id", text_or_empty().alias("text"), key)
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, ids array<int>")


def decode_rows(encoded: DataFrame, path: str, alpha: float = ALPHA, texts: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit), decoded text (null unless ``texts``), its SHA-256,
    and whether that is the hash of ``text``; only doc_id and ids are decoded from, the text's hash passes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in batch.column("ids")]
            found = [decode(x, path, alpha) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    pa.array(found if texts else [None] * len(found), pa.string()), pa.array([hashlib.sha256(f.encode()).hexdigest() for f in found], pa.string()), batch.column("text_sha256"),
                ],
                ["doc_id", "n_pieces", "ids_crc32", "decoded", "decoded_sha256", "text_sha256"],
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", "ids", F.sha2(F.col("text"), 256).alias("text_sha256"))
    done = rows.mapInArrow(run, f"doc_id {kind}, n_pieces bigint, ids_crc32 bigint, decoded string, decoded_sha256 string, text_sha256 string")
    return done.select("doc_id", "n_pieces", "ids_crc32", "decoded", (F.col("decoded_sha256") == F.col("text_sha256")).alias("lossless"), "decoded_sha256")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return decode_rows(encode(docs, default_model()), default_model(), texts=False).select("doc_id", "n_pieces", "ids_crc32", "lossless", "decoded_sha256")
