"""Words of texts as 64-bit hashes, computed over whole blocks of bytes at once."""

from __future__ import annotations

import functools

import numpy as np

_RANDOM = np.random.default_rng(20)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_IS_WORD = np.array([c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])
#: Bytes hashed at a time, and the most for which powers are kept.
BLOCK, LONG = 1 << 18, 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64; those of both usual lengths are kept by a worker that needs them."""
    up, down = _kept_powers(BLOCK if n <= BLOCK else LONG) if n <= LONG else _powers(n)
    return up[: n + 1], down[: n + 1]


@functools.lru_cache(maxsize=2)
def _kept_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    step = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]))
    return step(np.uint64(_BASE)), step(np.uint64(pow(_BASE, -1, 2**64)))


def _block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of a block no longer than ``BLOCK``, or of one longer word."""
    x = np.frombuffer(raw, np.uint8)
    up, down = powers(len(x))
    edge = np.diff(np.concatenate([[False], _IS_WORD[x], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[x] * up[: len(x)])])
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (and the last end).

    Words are runs of digits, letters a-z and characters beyond ASCII of the
    lower-cased text. Long texts are cut between words into blocks.
    """
    hashes, bounds, done = [], [0], 0
    waiting: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal waiting, held, done
        if waiting:
            start, found = _block(b"\n".join(waiting))
            first = np.cumsum([0, *(len(raw) + 1 for raw in waiting)])
            hashes.append(found)
            bounds.extend((done + np.searchsorted(start, first[1:])).tolist())
            done += len(found)
            waiting, held = [], 0

    for text in texts:
        raw = text.lower().encode()
        if len(raw) > BLOCK // 2:
            flush()
            at = 0
            while at < len(raw):
                end = min(len(raw), at + BLOCK)
                while end < len(raw) and _IS_WORD[raw[end]]:
                    end += 1
                found = _block(raw[at:end])[1]
                hashes.append(found)
                done += len(found)
                at = end
            bounds.append(done)
            continue
        if held + len(raw) + 1 > BLOCK:
            flush()
        waiting.append(raw)
        held += len(raw) + 1
    flush()
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.array(bounds)
