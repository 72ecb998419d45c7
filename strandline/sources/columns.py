"""Whole Arrow columns as flat bytes with places, and back: what encoders and decoders do to many records at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..functions.records import CIGAR_CODES
from .codecs import CodecError

_OPERATION = np.full(256, 255, np.uint8)
_OPERATION[np.frombuffer(CIGAR_CODES.encode(), np.uint8)] = np.arange(len(CIGAR_CODES))
_DIGITS = 9


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each begins and the last ends) of an Arrow array of strings or binaries; a null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    wide = texts.cast(pa.large_binary())
    if wide.null_count:
        wide = pc.fill_null(wide, b"")
    if not len(wide):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = wide.buffers()
    at = np.frombuffer(offsets, np.int64, len(wide) + 1, wide.offset * 8)
    n = int(at[-1] - at[0])
    return (np.frombuffer(data, np.uint8, n, int(at[0])) if n else np.zeros(0, np.uint8)), at - at[0]


def offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def binaries(data: np.ndarray, lengths: np.ndarray):
    """A large binary Arrow array of values of given lengths, which stand one after another."""
    import pyarrow as pa

    at = offsets(lengths)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def strings(data: np.ndarray, lengths: np.ndarray, null: np.ndarray | None = None):
    """A string Arrow array, checked to be UTF-8, with nulls where ``null`` says so."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out = binaries(data, lengths).cast(pa.string())
    return out if null is None or not null.any() else pc.if_else(pa.array(null), pa.scalar(None, pa.string()), out)


def side_by_side(*parts):
    """Row by row, the parts one after another, as large binaries."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(*[p.cast(pa.large_binary()) if isinstance(p, pa.Array) else pa.scalar(p, pa.large_binary()) for p in parts], pa.scalar(b"", pa.large_binary()))


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, one after another."""
    at = offsets(lengths)
    return data[np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])]


def cigar_ops(cigars) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(operations a row, their lengths, their codes) of a column of CIGARs; None if a text is anything but numbers and operations in turn."""
    data, at = flat(cigars)
    codes = _OPERATION[data]
    ends = np.flatnonzero(codes != 255)
    digits = (data >= 48) & (data <= 57)
    sizes = np.diff(np.concatenate(([-1], ends))) - 1
    last = at[1:][np.diff(at) > 0] - 1  # every text ends with an operation
    if not (digits | (codes != 255)).all() or (codes[last] == 255).any() or (sizes < 1).any() or (sizes > _DIGITS).any():
        return None
    lengths = np.zeros(len(ends), np.int64)
    for k in range(int(sizes.max(initial=0))):
        more = sizes > k
        lengths[more] += (data[ends[more] - 1 - k].astype(np.int64) - 48) * 10**k
    return np.diff(np.searchsorted(ends, at)), lengths, codes[ends]


def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of each row's values."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    at = offsets(counts)
    return total[at[1:]] - total[at[:-1]]


def mapped(values, f: Callable[[object], bytes]):
    """``f`` of each value of an Arrow array as large binaries, called once for each different value."""
    import pyarrow as pa

    coded = values.dictionary_encode()
    return pa.array([f(v) for v in coded.dictionary.to_pylist()], pa.large_binary()).take(coded.indices)


def itf8s(values: np.ndarray):
    """Each of many 32-bit integers in one to five bytes, as :func:`codecs.itf8` writes them, as large binaries."""
    v = np.asarray(values, np.int64) & 0xFFFFFFFF
    more = np.select([v < 1 << 7, v < 1 << 14, v < 1 << 21, v < 1 << 28], [0, 1, 2, 3], 4)
    out = np.zeros((len(v), 5), np.uint8)
    for n, mark in enumerate((0, 0x80, 0xC0, 0xE0)):
        rows = more == n
        if rows.any():
            w = v[rows]
            for k in range(n + 1):
                out[rows, k] = w >> 8 * (n - k) & 0xFF
            out[rows, 0] |= mark
    rows = more == 4
    if rows.any():
        w = v[rows]
        for k, shift in enumerate((28, 20, 12, 4)):
            out[rows, k] = w >> shift & 0xFF
        out[rows, 0] |= 0xF0
        out[rows, 4] = w & 0x0F
    return binaries(out[np.arange(5) <= more[:, None]], more + 1)


def itf8_bytes(values: np.ndarray) -> bytes:
    """The bytes of :func:`itf8s`, one integer after another."""
    v = np.asarray(values)
    if not len(v) or (v.min() >= 0 and v.max() < 1 << 7):
        return v.astype(np.uint8).tobytes()
    if v.min() >= 0 and v.max() < 1 << 14:
        two = v >= 1 << 7
        out = np.stack((np.where(two, 0x80 | v >> 8, 0), v & 0xFF), 1).astype(np.uint8)
        return out[np.stack((two, np.ones(len(v), bool)), 1)].tobytes()
    return flat(itf8s(v))[0].tobytes()


_SIZES = bytes(1 if b < 0x80 else 2 if b < 0xC0 else 3 if b < 0xE0 else 4 if b < 0xF0 else 5 for b in range(256))


def read_itf8s(data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """(the first ``n`` integers that :func:`itf8s` wrote, signed; where the next one begins)."""
    if n <= len(data) and not (data[:n] & 0x80).any():
        return data[:n].astype(np.int64), n
    sizes, starts, at = data.tobytes().translate(_SIZES), [], 0
    for _ in range(n):
        if at >= len(sizes):
            raise CodecError("data end early")
        starts.append(at)
        at += sizes[at]
    if at > len(data):
        raise CodecError("data end early")
    where = np.array(starts, np.int64)
    padded = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.int64)
    b0, b1, b2, b3, b4 = (padded[where + k] for k in range(5))
    v = np.select(
        [b0 < 0x80, b0 < 0xC0, b0 < 0xE0, b0 < 0xF0],
        [b0, (b0 & 0x3F) << 8 | b1, (b0 & 0x1F) << 16 | b1 << 8 | b2, (b0 & 0x0F) << 24 | b1 << 16 | b2 << 8 | b3],
        (b0 & 0x0F) << 28 | b1 << 20 | b2 << 12 | b3 << 4 | b4 & 0x0F,
    )
    return np.where(v >= 1 << 31, v - (1 << 32), v), at
