"""Hashes that any SQL engine with md5 gives alike, for folds, splits and draws."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F


def portable_hash(keys: Sequence[str], salt: Column | int = 0, digits: int = 8) -> Column:
    """The leading hex digits of the md5 of `key|..|salt` as a number; null keys are left out."""
    s = F.lit(salt) if isinstance(salt, int) else salt
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], s.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def portable_hash_sql(keys: Sequence[str], salt: str | int = 0, digits: int = 8) -> str:
    """The same number in SQL."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(keys)}, {salt})), 1, {digits}))::BIGINT"


#: Of md5: shifts, constants and start of the state.
_SHIFTS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Longest text of a single md5 block.
_BLOCK = 55


def hash_prefix(keys: Sequence[str]) -> Column:
    """What stands before the salt in the text of `portable_hash`, for `prefixed_hashes`."""
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(""))


def prefixed_hashes(prefixes: Sequence[bytes], salts: Sequence[int]) -> np.ndarray:
    """`portable_hash` to 10 digits of each prefix (a row) with each salt (a column), many rows at a time."""
    out = np.empty((len(prefixes), len(salts)), np.int64)
    size = np.array([len(p) for p in prefixes], np.int64)
    most = _BLOCK - max((len(str(s)) for s in salts), default=0)
    short, long = np.flatnonzero(size <= most), np.flatnonzero(size > most)
    for i in long.tolist():
        out[i] = [int(hashlib.md5(prefixes[i] + b"%d" % s).hexdigest()[:10], 16) for s in salts]
    if len(short):
        base = np.zeros((len(short), 64), np.uint8)
        flat = np.frombuffer(b"".join([prefixes[i] for i in short.tolist()]), np.uint8)
        base[np.arange(64) < size[short, None]] = flat
        for j, s in enumerate(salts):
            text, row, tail = base.copy(), np.arange(len(short)), b"%d\x80" % s
            for k, c in enumerate(tail):
                text[row, size[short] + k] = c
            text[:, 56:] = ((size[short] + len(tail) - 1) * 8).astype("<u8").view(np.uint8).reshape(-1, 8)
            out[short, j] = _leading(np.ascontiguousarray(text.view("<u4").T))
    return out


def _leading(words: np.ndarray) -> np.ndarray:
    """The first five bytes of the md5 of one-block messages, given as 16 rows of words."""
    a, b, c, d = (np.full(words.shape[1], v, np.uint32) for v in _START)
    used = words.any(1)
    for i in range(64):
        kind, at = divmod(i, 16)
        if kind == 0:
            f, g = d ^ (b & (c ^ d)), at
        elif kind == 1:
            f, g = c ^ (d & (b ^ c)), (5 * at + 1) % 16
        elif kind == 2:
            f, g = b ^ c ^ d, (3 * at + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * at % 16
        f += a
        f += _SINES[i]
        if used[g]:
            f += words[g]
        shift = _SHIFTS[kind][at % 4]
        high = f << np.uint32(shift)
        f >>= np.uint32(32 - shift)
        high |= f
        high += b
        a, d, c, b = d, c, b, high
    first, second = a + _START[0], b + _START[1]
    return (first.byteswap().astype(np.int64) << 8) | (second & np.uint32(255))
