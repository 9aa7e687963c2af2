"""Words of texts and their hashes, without a Python object a word."""

from __future__ import annotations

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15
WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cased ASCII letters and digits are words, all else is in between.
LETTERS_DIGITS = np.ones(256, bool)
LETTERS_DIGITS[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], space: np.ndarray = WHITE_SPACE, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and each word's text. Words are runs of bytes that are not ``space``, after folding.

    A word's hash is a polynomial of its bytes, taken from running sums, so all words cost a few passes over the bytes."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if fold is not None:
        raw = fold[raw]
    between = space[raw]
    edges = np.flatnonzero(between[1:] != between[:-1]) + 1
    if not between[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    power = np.multiply.accumulate(np.full(len(raw), MULTIPLIER, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    back = np.multiply.accumulate(np.full(len(raw), pow(MULTIPLIER, -1, 1 << 64), np.uint64))
    hashes = mix((total[ends] - total[starts]) * back[starts])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    return hashes, owner
