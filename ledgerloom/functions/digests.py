"""MD5 of many short keys at once: the first 32 bits of each, the same as in any engine; numpy in, numpy out."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_LONGEST = 55  # bytes that fit one block


def _first(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """First 32 bits of the digests of one-block messages; a word is an array that broadcasts to shape."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps don't reach the first word
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[g] + np.uint32(_ADD[i])
        turn = _TURN[i // 16][i % 4]
        np.left_shift(f, turn, out=t)
        f >>= 32 - turn
        t |= f
        t += b
        a, b, c, d, t = d, t, b, c, a
    b += np.uint32(_START[0])
    return b.byteswap(inplace=True)


def _digits(values: np.ndarray, width: int, at: int, axis: int) -> list[np.ndarray]:
    """The 16 words of a block that holds only the decimal digits of values from byte `at` on."""
    shape = (-1, 1) if axis == 0 else (1, -1)
    out = [np.zeros((1, 1), np.uint32)] * 16
    for j in range(width):
        k, digit = at + j, (values // 10 ** (width - 1 - j) % 10 + 48).astype(np.uint32).reshape(shape)
        out[k // 4] = out[k // 4] | digit << 8 * (k % 4)
    return out


def uniforms(prefix: str, s: np.ndarray, i: np.ndarray) -> np.ndarray:
    """(s, i) numbers in [0, 1): the first 32 bits of the MD5 of prefix|s|i over 2^32; the numbers of s have one count of digits, those of i, too."""
    ws, wi = len(str(int(s[0]))), len(str(int(i[0])))
    head = f"{prefix}|".encode()
    mid, end = len(head) + ws, len(head) + ws + 1 + wi
    if end > _LONGEST:
        rows = [[int(hashlib.md5(f"{prefix}|{x}|{y}".encode()).hexdigest()[:8], 16) for y in i.tolist()] for x in s.tolist()]
        return np.array(rows) / 2.0**32
    fixed = bytearray(64)
    fixed[: len(head)], fixed[mid], fixed[end], fixed[56:60] = head, ord("|"), 0x80, (8 * end).to_bytes(4, "little")
    fixed = np.frombuffer(bytes(fixed), "<u4").reshape(16, 1, 1)
    words = [x | y | z for x, y, z in zip(fixed, _digits(s, ws, len(head), 0), _digits(i, wi, mid + 1, 1))]
    return _first(words, (len(s), len(i))) / 2.0**32


def by_digits(lo: int, hi: int):
    """The ranges [a, b) of [lo, hi), each of numbers of one count of digits."""
    while lo < hi:
        b = min(hi, 10 ** len(str(lo)))
        yield lo, b
        lo = b
