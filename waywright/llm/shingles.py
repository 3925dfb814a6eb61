"""Words, shingles and minwise signatures of texts, with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

WIDTH = 5
_table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_base = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_mix = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def powers(n: int) -> list[np.ndarray]:
    """_base ** i and its inverse ** i modulo 2 ** 64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 4096)
        for k, base in enumerate((_base, pow(_base, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out, dtype=np.uint64)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _mix[0]
    x = (x ^ (x >> np.uint64(27))) * _mix[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased, in order."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").lower() + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.nonzero(space[:-1] & ~space[1:])[0] + 1
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = np.nonzero(~space[:-1] & space[1:])[0] + 1
    up, down = powers(len(data))
    summed = np.cumsum(_table[data] * up[: len(data)], dtype=np.uint64)
    return mixed((summed[ends - 1] - summed[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of width words, in order; none if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up = powers(width + 1)[0]
    total = words[:n] * up[1]
    for k in range(1, width):
        total = total + words[k : k + n] * up[k + 1]
    return mixed(total)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of fewer than width words, the whole sequence is one; without words none."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    return np.unique(windows(words, min(width, len(words))) + np.uint64(min(width, len(words)) if len(words) < width else 0))


_signers: dict[int, np.ndarray] = {}


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """size minwise values, 64 bits each; of an empty set zeros."""
    if size not in _signers:
        _signers[size] = np.random.default_rng(7).integers(1, 1 << 63, (size, 1), np.uint64) | np.uint64(1)
    if not len(shingles):
        return np.zeros(size, np.uint64)
    factors, out = _signers[size], None
    for i in range(0, len(shingles), 2048):
        low = (factors * shingles[i : i + 2048]).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return mixed(mixed(out))


def fingerprint(shingles: np.ndarray) -> bytes:
    """The same for equal sets only."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
