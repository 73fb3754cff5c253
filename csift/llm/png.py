"""PNG files of 8-bit grey samples: writing, reading with checksum tests, and unfiltering with numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
CHUNK = 1 << 16


class BadImage(ValueError):
    """The bytes aren't an image that this module reads, or a checksum differs."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(samples: np.ndarray, kind: int) -> np.ndarray:
    """Each row less its prediction by filter `kind`."""
    left = np.zeros_like(samples)
    left[:, 1:] = samples[:, :-1]
    if kind == NONE:
        return samples
    if kind == SUB:
        return samples - left
    up = np.zeros_like(samples)
    up[1:] = samples[:-1]
    if kind == UP:
        return samples - up
    if kind == AVERAGE:
        return samples - ((left.astype(np.uint16) + up) // 2).astype(np.uint8)
    corner = np.zeros_like(samples)
    corner[1:, 1:] = samples[:-1, :-1]
    return samples - _nearest(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16))


def _nearest(left, up, corner):
    guess = left + up - corner
    a, b, c = abs(guess - left), abs(guess - up), abs(guess - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner)).astype(np.uint8)


def write(samples: np.ndarray, kinds: tuple[int, ...] = (NONE, UP), level: int = 4) -> bytes:
    """A lossless file; of the filters in `kinds`, each for the whole image, the one that compresses best."""
    height, width = samples.shape
    best = b""
    for kind in kinds:
        rows = np.empty((height, width + 1), np.uint8)
        rows[:, 0] = kind
        rows[:, 1:] = filtered(samples, kind)
        packed = zlib.compress(rows.tobytes(), level)
        if not best or len(packed) < len(best):
            best = packed
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"".join([SIGNATURE, _chunk(b"IHDR", header), *(_chunk(b"IDAT", best[i : i + CHUNK]) for i in range(0, len(best), CHUNK)), _chunk(b"IEND", b"")])


def chunks(data: bytes):
    """(kind, data) of each chunk; raises if a length or a checksum is wrong."""
    if data[:8] != SIGNATURE:
        raise BadImage("no signature")
    at, kind = 8, b""
    while at < len(data):
        if at + 12 > len(data):
            raise BadImage("cut off in a chunk")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body, end = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], at + 12 + size
        if end > len(data):
            raise BadImage("cut off in a chunk")
        if struct.unpack_from(">I", data, end - 4)[0] != zlib.crc32(kind + body):
            raise BadImage(f"checksum of chunk {kind!r}")
        yield kind, body
        at = end
    if kind != b"IEND":
        raise BadImage("no end")


def read(data: bytes) -> np.ndarray:
    """The samples. Every chunk's CRC and the stream's Adler checksum are tested."""
    header, stream, unpack = None, [], zlib.decompressobj()
    for kind, body in chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            try:
                stream.append(unpack.decompress(body))
            except zlib.error as error:
                raise BadImage(str(error)) from error
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise BadImage("not 8-bit grey without interlacing")
    width, height = header[:2]
    flat = b"".join(stream)
    if not unpack.eof or len(flat) != height * (width + 1):
        raise BadImage("wrong number of samples")
    rows = np.frombuffer(flat, np.uint8).reshape(height, width + 1)
    return unfiltered(rows[:, 1:], rows[:, 0])


def unfiltered(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Adds predictions again; runs of rows with one filter at a time."""
    if kinds.size and kinds.max() > PAETH:
        raise BadImage("unknown filter")
    out = rows.copy()
    turns = [0, *(np.nonzero(np.diff(kinds))[0] + 1).tolist(), len(rows)]
    for begin, end in zip(turns[:-1], turns[1:]):
        if begin == end:
            continue
        kind = kinds[begin]
        if kind == SUB:
            np.cumsum(rows[begin:end], axis=1, dtype=np.uint8, out=out[begin:end])
        elif kind == UP:
            if begin:
                out[begin] = rows[begin] + out[begin - 1]
            np.cumsum(out[begin:end], axis=0, dtype=np.uint8, out=out[begin:end])
        elif kind in (AVERAGE, PAETH):
            for y in range(begin, end):
                _undo(out[y], out[y - 1] if y else np.zeros_like(out[y]), kind)
    return out


def _undo(row: np.ndarray, above: np.ndarray, kind: int) -> None:
    """In place; a sample needs its left neighbour, so there is no array form."""
    x, up, left, corner = row.tolist(), above.tolist(), 0, 0
    for i, (d, b) in enumerate(zip(x, up)):
        if kind == AVERAGE:
            left = d + (left + b) // 2 & 255
        else:
            p, q, r = abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)
            left, corner = d + (left if p <= q and p <= r else b if q <= r else corner) & 255, b
        x[i] = left
    row[:] = x
