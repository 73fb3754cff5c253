"""Media columns: texts stored as PNG images in a binary column, and features of images.

A text's UTF-8 bytes, padded with zeros to a positive multiple of WIDTH, are the grey samples of an image WIDTH wide.
Features come from the stored bytes read back: a perceptual hash from the low frequencies of a two-dimensional cosine
transform, as 8 bytes.

Defined results: null text is empty (one row of zeros); equal texts have equal images and features; repeated rows are
kept; an empty table gives an empty result; other columns don't matter. A stored image that fails a checksum raises
in `read_media`, with its doc_id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csift.llm import png
from csift.llm.common import slices

WIDTH = 64
SIDE = 32
LOW = 8


def _transform(n: int = SIDE, low: int = LOW) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


COSINES = _transform()


def averaged(samples: np.ndarray, axis: int, n: int) -> np.ndarray:
    """Means over n equal stretches of an axis; a stretch may begin and end within a sample."""
    size = samples.shape[axis]
    sums = np.concatenate([np.zeros_like(samples.take([0], axis)), np.cumsum(samples, axis)], axis)
    at = np.arange(n + 1) * size / n
    low = np.minimum(at.astype(np.int64), size - 1)
    part = np.expand_dims(at - low, 1 - axis)
    level = sums.take(low, axis) * (1 - part) + sums.take(low + 1, axis) * part
    return np.diff(level, axis=axis) * (n / size)


def cosine_hash(samples: np.ndarray) -> bytes:
    """8 bytes: for each low frequency whether its coefficient is above the median of all but the constant one."""
    image = averaged(averaged(samples.astype(np.float64), 0, SIDE), 1, SIDE)
    low = np.round(COSINES @ image @ COSINES.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes()


def samples_of(text: bytes) -> np.ndarray:
    rows = max(1, -(-len(text) // WIDTH))
    return np.frombuffer(text.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (a PNG file) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]
            files = [png.write(samples_of(x)) for x in texts]
            yield pa.record_batch([part.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature (binary), all from what is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            out = []
            for doc_id, data in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist()):
                try:
                    samples = png.read(data)
                except png.BadImage as error:
                    raise png.BadImage(f"doc_id {doc_id}: {error}") from error
                payload = samples.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(samples)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out), kinds)]
            yield pa.record_batch([part.column("doc_id"), part.column("n_bytes"), *columns], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature binary"
    return stored.mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores and reads back; the contract's columns, feature as 16 hex digits."""
    return read_media(store_texts(docs)).withColumn("feature", F.lower(F.hex("feature")))
