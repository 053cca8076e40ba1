"""Whole Arrow columns of text as numpy arrays: bytes, words, and 64-bit hashes of words and runs of words."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes hashed at a time; bounds the scratch arrays of a task.
PIECE = 1 << 19
U = np.uint64


@lru_cache(maxsize=None)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n modulo 2 ** 64."""
    p = np.full(n + 1, base, dtype=U)
    p[0] = 1
    return np.multiply.accumulate(p)


def both_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n at least of a base and of its inverse modulo 2 ** 64; kept unless one text is very long."""
    size = PIECE + (PIECE >> 2)
    f, m = (powers, size) if n <= size else (powers.__wrapped__, n)
    return f(base, m), f(pow(base, -1, 1 << 64), m)


@lru_cache(maxsize=None)
def byte_values() -> np.ndarray:
    """A fixed random value for each byte."""
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def release() -> None:
    """Give freed memory back to the system: Spark uses its Python workers again, for other operators too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits (the splitmix64 finish)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def flat(column) -> pa.Array:
    """A column as one array without nulls: a null text is an empty one."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], pa.string())
    return a.fill_null("") if a.null_count else a


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets of the texts in them)."""
    a = flat(column)
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = a.buffers()
    o = np.frombuffer(offsets, kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes with `inside[byte]`; a run never crosses two texts."""
    w = inside[data]
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(w) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(w), bool)
    before[0], before[1:] = False, w[:-1]
    after = np.empty(len(w), bool)
    after[-1], after[:-1] = False, w[1:]
    return np.flatnonzero(w & (~before | edge[:-1])), np.flatnonzero(w & (~after | edge[1:])) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for every span, equal for equal bytes wherever they stand; spans in order of start."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + PIECE)))
        hi = int(ends[i:j].max())
        n = hi - lo
        up, down = both_powers(0x5851F42D4C957F2D, n)
        h = np.zeros(n + 1, U)
        np.cumsum(byte_values()[data[lo:hi]] * up[:n], out=h[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((h[e] - h[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


def run_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n successive items; len(items) - n + 1 of them."""
    m = len(items) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out, step = np.empty(m, U), 1 << 18
    for i in range(0, m, step):
        part = items[i : min(m, i + step) + n - 1]
        up, down = both_powers(0xD1342543DE82EF95, len(part))
        h = np.zeros(len(part) + 1, U)
        np.cumsum(part * up[: len(part)], out=h[1:])
        k = len(part) - n + 1
        out[i : i + k] = mix((h[n:] - h[:k]) * down[:k])
    return out


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def byte_class(keep: str) -> np.ndarray:
    """256 flags: `alnum` for ASCII letters, digits and every byte beyond ASCII; `nospace` for all but ASCII white space."""
    b = np.arange(256)
    if keep == "nospace":
        return ~((b == 32) | ((b >= 9) & (b <= 13)))
    return ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t[data]


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending 64-bit values as their differences in as few whole bytes as the largest needs."""
    if not len(h):
        return b""
    d = np.diff(h, prepend=U(0))
    width = max(1, (int(d[1:].max()).bit_length() + 7) // 8) if len(d) > 1 else 1
    body = np.ascontiguousarray(d[1:]).view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + int(h[0]).to_bytes(8, "little") + body.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    d = np.zeros((len(body) + 1, 8), np.uint8)
    d[1:, :width] = body
    d = d.view(U).ravel()
    d[0] = int.from_bytes(blob[1:9], "little")
    return np.cumsum(d, dtype=U)
