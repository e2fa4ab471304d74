"""MD5 of many short texts at once, as arrays: all texts of one shape go through the rounds together."""

from __future__ import annotations

import numpy as np

#: Longest text, in bytes: one MD5 block with its padding.
LONGEST = 55
_K = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_S = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def first_words(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of every head followed by every tail, a row a head."""
    return _rounds(heads, tails, 61)[0]  # the last three rounds leave the first word as it is


def units(heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The first 52 bits as numbers in [0, 1), as ``vectors.hashed_unit`` has them."""
    first, second = _rounds(heads, tails, 64)
    return ((first.astype(np.int64) << 20) | (second >> np.uint32(12))) / 2.0**52


def _rounds(heads: np.ndarray, tails: np.ndarray, n: int) -> list[np.ndarray]:
    """The first word after 61 rounds, or the first two after 64.

    heads and tails are arrays of bytes rows (uint8), each of one length.
    """
    (rows, before), (columns, after) = heads.shape, tails.shape
    if (size := before + after) > LONGEST:
        raise ValueError(f"a text has {size} bytes; {LONGEST} are the most")
    left, right = np.zeros((rows, 64), np.uint8), np.zeros((columns, 64), np.uint8)
    left[:, :before], right[:, before:size] = heads, tails
    right[:, size], right[:, 56:58] = 0x80, (8 * size % 256, 8 * size // 256)
    left, right = left.view("<u4"), right.view("<u4")
    words = []
    for i in range(16):  # a word is a number if all texts share it
        same = (left[:, i] == left[0, i]).all() and (right[:, i] == right[0, i]).all()
        words.append(int(left[0, i]) + int(right[0, i]) if same else np.ascontiguousarray(np.add(left[:, i, None], right[None, :, i])).ravel())
    a, b, c, d = (np.full(rows * columns, x, np.uint32) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(n):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            at = (3 * i + 5) % 16
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            at = 7 * i % 16
        np.add(f, a, out=f)
        if isinstance(words[at], int):
            np.add(f, np.uint32((_K[i] + words[at]) % 2**32), out=f)
        else:
            np.add(f, np.uint32(_K[i]), out=f), np.add(f, words[at], out=f)
        s = _S[i // 16][i % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    # the newest word is b; that of the 61st round ends as the first one, three rounds later in a
    return [(x + np.uint32(start)).byteswap().reshape(rows, columns) for x, start in zip((a, b) if n == 64 else (b,), _START, strict=False)]
