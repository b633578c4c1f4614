"""Distinct word shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import functools

import numpy as np

from loamgraph.llm._common import release

_U = np.uint64
#: Texts are hashed in blocks of about so many bytes.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    values[65:91] = values[97:123]  # A-Z count as a-z
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return values, blank


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words; ends with a blank."""
    values, blank = _tables()
    gap = blank[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    size = BLOCK * 2
    while size < len(data) + 1:
        size *= 2
    up, down = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of so many words; of fewer words, the whole sequence is one."""
    release()
    out: list[np.ndarray] = []
    coded = [x.encode("utf-8", "surrogatepass") for x in texts]
    at = 0
    while at < len(coded):
        to, size = at, 0
        while to < len(coded) and (to == at or size + len(coded[to]) < BLOCK):
            size += len(coded[to]) + 1
            to += 1
        data = np.frombuffer(b" ".join([*coded[at:to], b""]), np.uint8)
        starts, _, h = _words(data)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in coded[at:to])]))
        full = h[: max(0, len(h) - words + 1)].copy()
        for k in range(1, words):
            full = full * _U(0xD6E8FEB86659FD93) + h[k : k + len(full)]
        full = mix(full)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(full[a : b - words + 1]))
            elif b > a:
                x = np.array([b - a], np.uint64)
                for k in range(a, b):
                    x = x * _U(0xC2B2AE3D27D4EB4F) + h[k]
                out.append(mix(x))
            else:
                out.append(np.zeros(0, np.uint64))
        at = to
    return out


def signature(x: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a = int(np.add.reduce(mix(x ^ _U(0xA0761D6478BD642F)), dtype=np.uint64)) if len(x) else 0
    b = int(np.bitwise_xor.reduce(mix(x + _U(0xE7037ED1A0B428DB)))) if len(x) else 0
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return signed(a), signed(b)
