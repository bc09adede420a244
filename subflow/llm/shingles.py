"""Sets of word shingles as sorted 64-bit numbers, computed with numpy, text by text."""

from __future__ import annotations

import numpy as np

from subflow.llm.common import mixed

_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the step and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, _STEP_BACK)):
            table = np.full(max(n, 1 << 16), np.uint64(base))
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def word_numbers(text: str) -> np.ndarray:
    """A 64-bit number per word `[^\\x20\\x09-\\x0D]+`, A-Z taken as a-z.

    A polynomial over random numbers of the bytes, from differences of one running sum,
    so the work is linear in the text however long a word is.
    """
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = np.concatenate(([False], ~_IS_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _steps(len(raw) + 1)
    with np.errstate(over="ignore"):
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])))
        value = (running[ends] - running[starts]) * down[starts]
        return mixed(value + (ends - starts).astype(np.uint64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct numbers of the runs of ``words`` words; a shorter text is one run."""
    numbers = word_numbers(text)
    if not len(numbers):
        return numbers
    size = min(words, len(numbers))
    with np.errstate(over="ignore"):
        runs = np.full(len(numbers) - size + 1, np.uint64(size))
        for k in range(size):
            runs = mixed(runs * np.uint64(_STEP) + numbers[k : len(numbers) - size + 1 + k])
    return np.unique(runs)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        one = np.add.reduce(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)))
        two = np.add.reduce(mixed(shingles + np.uint64(0x14057B7EF767814F)))
    return np.array([one, two], "<u8").tobytes()


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
