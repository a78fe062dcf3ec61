"""Keyed permutations: where each of n people goes in a replicate, without sorting or a table of labels."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
ROUNDS = 6


def permuted(rank: np.ndarray, n: np.ndarray, key: int) -> np.ndarray:
    """The place in 0 ... n - 1 of each rank in 0 ... n - 1, different for different ranks of the same n and key.

    A Feistel network permutes the numbers of twice as many bits as half of n's take; a number that falls outside goes
    through it again until it is inside, which keeps it a permutation.
    """
    n = np.asarray(n, np.uint64)
    half = np.maximum((np.frexp(np.maximum(n.astype(float) - 1, 1))[1] + 1) // 2, 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(rank, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x, h, m = out[todo], half[todo], mask[todo]
        left, right = x >> h, x & m
        for k in range(ROUNDS):
            f = (right + np.uint64(((key * ROUNDS + k + 1) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)) * _A
            f = (f ^ (f >> np.uint64(29))) * _B
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)
