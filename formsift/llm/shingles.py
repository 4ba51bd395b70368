"""Word shingles of whole texts as sorted arrays of 64-bit hashes, worked out with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed together.
GATHER = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    """Powers of an odd base modulo 2^64."""
    row = np.ones(1, np.uint64)
    while len(row) < n:
        row = np.concatenate([row, row * np.uint64(pow(base, len(row), 1 << 64))])
    return row[:n]


class Tables:
    """Powers of the base and of its inverse, grown as longer texts come."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = powers(int(BASE), size), powers(pow(int(BASE), -1, 1 << 64), size)
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word, from prefix sums of the bytes' polynomial."""
    codes = np.frombuffer(data, np.uint8)
    word = ~IS_SPACE[codes]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = Tables.upto(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:len(codes)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; of fewer words, all of them as one."""
    raw = [t.encode("utf-8", "surrogatepass").translate(TO_LOWER) for t in texts]
    hashes, starts = word_hashes(b"\n".join(raw))
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    bounds = np.searchsorted(starts, offsets)
    rolled = hashes
    for k in range(1, width):
        rolled = mix(rolled[:max(0, len(hashes) - k)]) * BASE + hashes[k:]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a:b - width + 1]))
        elif b > a:
            whole = hashes[a:a + 1]
            for k in range(1, b - a):
                whole = mix(whole) * BASE + hashes[a + k:a + k + 1]
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def gathered(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Rows of (identifier, text) in lists of about ``GATHER`` characters, null text as empty."""
    some, chars = [], 0
    for key, text in rows:
        some.append((key, text or ""))
        chars += len(some[-1][1])
        if chars >= GATHER:
            yield some
            some, chars = [], 0
    if some:
        yield some
