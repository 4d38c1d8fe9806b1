"""Md5-keyed draws of whole runs of slots at once, the same as ``expr.draw_index`` row by row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import floor, sin

import numpy as np

U = np.uint32
#: The constants of md5 (RFC 1321): one addend a step, turns by round and step, start values.
ADDENDS = [floor(abs(sin(i + 1)) * 2**32) for i in range(64)]
TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: The first digest bytes are settled in this step.
STEPS = 61
#: Slots that are hashed together; below ``FEW`` a call for each is faster. Longest text of one md5 block.
RUN, FEW, BLOCK = 1 << 15, 512, 55


def _slot_words(n: int, at: int) -> dict[int, np.ndarray]:
    """The words of the message block that differ between slots 0..n-1, whose digits begin at byte ``at``."""
    words = {w: np.zeros(n, U) for w in (*range(at // 4, (at + len(str(n - 1))) // 4 + 1), 14)}
    lo = 0
    while lo < n:
        digits = len(str(lo))
        hi = min(n, 10**digits)
        slots = np.arange(lo, hi)
        for j in range(digits + 1):
            byte = U(0x80) if j == digits else (slots // 10 ** (digits - 1 - j) % 10 + ord("0")).astype(U)
            words[(at + j) // 4][lo:hi] |= byte << U((at + j) % 4 * 8)
        words[14][lo:hi] = 8 * (at + digits)
        lo = hi
    return words


def _first_word(fixed: list[int], moving: dict[int, np.ndarray]) -> np.ndarray:
    """First four bytes of the md5 of each message, as a big-endian number."""
    n = len(moving[14])
    a, b, c, d = (np.full(n, x, U) for x in START)
    f = np.empty(n, U)
    for i in range(STEPS):
        kind = i // 16
        if kind == 0:
            w = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            w = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            w = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            w = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        if w in moving:
            a += moving[w]
        a += U((ADDENDS[i] + fixed[w]) & 0xFFFFFFFF)
        turn = TURNS[kind][i % 4]
        np.left_shift(a, U(turn), out=f)
        a >>= U(32 - turn)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return (b + U(START[0])).byteswap()


def draw_hashes(seed: int, draws: Iterable[int], n: int) -> Iterator[np.ndarray]:
    """For each draw the first 32 bits of md5(``seed:draw:slot``) of slots 0..n-1."""
    words, at = {}, None
    for draw in draws:
        head = f"{seed}:{draw}:".encode()
        if n < FEW or len(head) + len(str(n)) > BLOCK:
            yield np.fromiter((int.from_bytes(hashlib.md5(head + str(slot).encode()).digest()[:4], "big") for slot in range(n)), U, n)
            continue
        if at != len(head):
            at = len(head)
            words = _slot_words(n, at)
        fixed = [int.from_bytes(head[4 * w: 4 * w + 4], "little") for w in range(16)]
        yield np.concatenate([_first_word(fixed, {w: x[lo: lo + RUN] for w, x in words.items()}) for lo in range(0, n, RUN)])
