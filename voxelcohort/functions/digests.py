"""md5 of many short keys at once: numpy columns of one 64-byte block a message, for use inside tasks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np

ONE_BLOCK = 55  # bytes of a message that fit one block next to its padding
LANES, ACROSS = 16_384, 1_024  # messages, and tails among them, worked on together; their columns stay in the processor's cache
SHIFTS = (7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _rounds(words: Sequence[np.ndarray | int], shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    """First two words of the digests; a word of the messages is a column or one number for all."""
    a, b, c, d = (np.full(shape, s, dtype=np.uint32) for s in START)
    f, g = np.empty(shape, dtype=np.uint32), np.empty(shape, dtype=np.uint32)
    for i in range(64):
        kind, word = i // 16, words[WORDS[i]]
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        if isinstance(word, int):
            f += np.uint32((word + SINES[i]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(SINES[i])
        shift = SHIFTS[kind][i % 4]
        np.left_shift(f, np.uint32(shift), out=g), np.right_shift(f, np.uint32(32 - shift), out=f)
        np.bitwise_or(f, g, out=a)
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(START[0])
    b += np.uint32(START[1])
    return a, b


def numbered_md5(first: int, last: int, tails: Sequence[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(number, at, a, b)`` for runs of numbers from ``first`` until before ``last``: rows of ``a`` and ``b`` are numbers
    from ``number`` on, columns the messages ``<number><tails[at]>``, values the first two little-endian words of their md5.

    Every number meets every tail once, in some order of pieces.
    """
    lengths = np.array([len(t) for t in tails])
    for length in np.unique(lengths):
        every = np.flatnonzero(lengths == length)
        for begin in range(0, len(every), ACROSS):
            at = every[begin:begin + ACROSS]
            own, number = [tails[i] for i in at], first
            while number < last:
                digits = len(str(number))
                shared = _ends(own, digits, int(length)) if digits + length <= ONE_BLOCK else None
                for start in range(number, min(last, 10**digits), max(1, LANES // len(at))):
                    stop = min(last, 10**digits, start + max(1, LANES // len(at)))
                    if shared is None:
                        raw = b"".join(hashlib.md5(str(k).encode() + t, usedforsecurity=False).digest()[:8] for k in range(start, stop) for t in own)
                        pair = np.frombuffer(raw, dtype="<u4").reshape(stop - start, len(at), 2)
                        yield start, at, pair[:, :, 0], pair[:, :, 1]
                    else:
                        yield start, at, *_rounds(_words(start, stop, digits, shared), (stop - start, len(at)))
                number = min(last, 10**digits)


def _ends(tails: list[bytes], digits: int, length: int) -> np.ndarray:
    """Words of the messages without their numbers: the sixteen rows of a table with a column for each tail."""
    ends = np.zeros((len(tails), 64), dtype=np.uint8)
    ends[:, digits:digits + length] = np.frombuffer(b"".join(tails), dtype=np.uint8).reshape(-1, length)
    ends[:, digits + length] = 0x80
    ends[:, 56:58] = np.frombuffer((8 * (digits + length)).to_bytes(2, "little"), dtype=np.uint8)
    return np.ascontiguousarray(ends.view("<u4").T)


def _words(start: int, stop: int, digits: int, ends: np.ndarray) -> list[np.ndarray | int]:
    """The sixteen words of the messages, numbers down and tails across; a word that all messages share is one number."""
    heads = np.zeros((stop - start, 64), dtype=np.uint8)
    heads[:, :digits] = np.frombuffer("".join(map(str, range(start, stop))).encode(), dtype=np.uint8).reshape(-1, digits)
    words = []
    for head, end in zip(np.ascontiguousarray(heads.view("<u4").T), ends):
        if (head == head[0]).all() and (end == end[0]).all():
            words.append(int(head[0]) + int(end[0]))
        else:
            words.append(head[:, None] + end[None, :])
    return words
