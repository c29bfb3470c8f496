"""Images in columns: an audit of their bytes and a 64-bit perceptual hash, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.raster import PNG, decode

#: Bytes of files that are decoded together.
SLICE_BYTES = 8 << 20


def perceptual_hash(pixels: np.ndarray) -> int:
    """Signs of the low 8 x 8 cosine coefficients of a 32 x 32 grey thumbnail against their median."""
    colours = 3 if pixels.shape[2] >= 3 else 1  # transparency does not count
    grey = pixels[..., :colours].astype(np.float64).mean(axis=2)
    ys, xs = (np.linspace(0, n, 33).astype(int) for n in grey.shape)
    # A cell below one pixel takes the pixel it starts in; reduceat does so where a start is not below the next.
    sums = np.add.reduceat(np.add.reduceat(grey, ys[:-1], axis=0), xs[:-1], axis=1)
    small = sums / np.outer(np.maximum(np.diff(ys), 1), np.maximum(np.diff(xs), 1))
    k = np.arange(32)
    basis = np.cos((2 * k[None, :] + 1) * k[:8, None] * np.pi / 64)
    low = (basis @ small @ basis.T).ravel()
    bits = low > np.median(low[1:])
    return sum(int(b) << (63 - i) for i, b in enumerate(bits))


def audit(df: DataFrame, content: str = "bytes", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys..., sha256, present, decodable, width, height, mode, format, error, phash (16 hex digits) of each image.

    Null or empty bytes are missing; bytes of no known format, and files that are not sound, are corrupt.  PNG files of
    any kind are decoded, ``SLICE_BYTES`` of files together; of JPEG, GIF, BMP, WebP and TIFF the header is read, and
    they are unsupported, not corrupt.
    """
    fields = [("present", pa.bool_(), "boolean"), ("decodable", pa.bool_(), "boolean"), ("width", pa.int32(), "int"), ("height", pa.int32(), "int"), ("mode", pa.string(), "string"), ("format", pa.string(), "string"), ("error", pa.string(), "string"), ("phash", pa.string(), "string")]

    def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        start = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(content)), 0).to_pylist()):
            if i > start and held + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                found = []
                for p in decode(part.column(content).to_pylist()):
                    found.append((p.error != "missing", p.pixels is not None, p.width, p.height, p.mode, p.format, p.error, f"{perceptual_hash(p.pixels):016x}" if p.pixels is not None else None))
                cols = [pa.array([f[i] for f in found], t) for i, (_, t, _) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), part.column("sha256"), *cols], [*keys, "sha256", *(n for n, _, _ in fields)])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "sha256 string", *(f"{n} {s}" for n, _, s in fields)])
    return df.select(*keys, content, F.sha2(content, 256).alias("sha256")).mapInArrow(run, schema)


def png_header(content: str) -> tuple[Column, Column]:
    """Width and height from the header alone, without Python; null if the bytes are no PNG."""
    ok = F.hex(F.substring(content, 1, 8)) == PNG.hex().upper()
    number = lambda at: F.when(ok, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int"))
    return number(17), number(21)


def integrity(audited: DataFrame, by: str, width: int, height: int) -> DataFrame:
    """Per modality: missing, wrong size (an unknown size is wrong), unreadable, and rows that pass every check."""
    wrong = F.coalesce((F.col("width") != width) | (F.col("height") != height), F.lit(True))
    return audited.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("present")).cast("long")).alias("missing"), F.sum(wrong.cast("long")).alias("wrong_size"), F.sum((F.col("present") & ~F.col("decodable")).cast("long")).alias("unreadable"),
        F.sum((F.col("present") & F.col("decodable") & ~wrong).cast("long")).alias("compliant"),
    )
