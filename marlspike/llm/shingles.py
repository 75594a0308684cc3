"""Word shingles of whole texts as 64-bit hashes, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 & ~7 | 5
_P_INVERSE = pow(_P, -1, 2**64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        grown = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        grown[0] = 1
        held = _powers[base] = np.multiply.accumulate(grown)
    return held[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each word, in order; words are runs without blanks and 0x09 to 0x0D, A-Z lower-cased."""
    flat = np.frombuffer(b" ".join([*(t.lower() for t in texts), b""]) or b" ", dtype=np.uint8)
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANK[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[flat] * _power(_P, len(flat)), out=sums[1:])
    hashed = (sums[end] - sums[start]) * _power(_P_INVERSE, len(flat) + 1)[start]
    return mix(hashed), np.searchsorted(ends_of_text, start, side="right")


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number): the distinct shingles of each text, sorted within the text.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    hashed, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    n = len(hashed) - words + 1
    parts, owners = [], []
    if n > 0:
        whole = np.zeros(n, dtype=np.uint64)
        for j in range(words):
            whole += hashed[j : j + n] * _COEF[j]
        inside = owner[:n] == owner[words - 1 :]
        parts.append(mix(whole[inside]))
        owners.append(owner[:n][inside])
    for i in np.flatnonzero((counts > 0) & (counts < words)):
        own = hashed[first[i] : first[i + 1]]
        parts.append(mix((own * _COEF[: len(own)]).sum(keepdims=True) + _COEF[40 + len(own) : 41 + len(own)]))
        owners.append(np.array([i]))
    if not parts:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    sh, own = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((sh, own))
    sh, own = sh[order], own[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (own[1:] != own[:-1])
    return sh[new], own[new]
