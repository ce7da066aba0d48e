"""Permutations that any engine can repeat: the place of a number is computed, so nothing is sorted or shuffled to permute.

The numbers below n are pairs of digits to the base A, the least one with A * A >= n (16 at least: fewer digits don't mix well). Six
rounds of a Feistel network over the digits permute the numbers below A * A; a number that leaves the range is permuted again until
it is back.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

# fixed values: the multipliers of the 32-bit finaliser of MurmurHash3, and odd numbers that set seeds, permutations and rounds apart
MIX_1, MIX_2 = 0x85EBCA6B, 0xC2B2AE35
SEED_STEP, ROUND_STEP = 0x9E3779B1, 0x27D4EB2F
ROUNDS = 6


def mix(x: np.ndarray) -> np.ndarray:
    """A hash of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(MIX_1)
    x ^= x >> np.uint32(13)
    x *= np.uint32(MIX_2)
    x ^= x >> np.uint32(16)
    return x


def base(n: int) -> int:
    """The least A with A * A >= n, and 16 at least."""
    return max(16, isqrt(max(n, 1) - 1) + 1)


def _rounds(numbers: np.ndarray, keys: np.ndarray, a: int) -> np.ndarray:
    high, low = (x.astype(np.uint32) for x in np.divmod(numbers, np.uint64(a)))
    for key in keys:
        drawn = mix(low + key)
        moved = high + ((drawn.astype(np.uint64) * np.uint64(a)) >> np.uint64(32)).astype(np.uint32)
        moved -= np.uint32(a) * (moved >= a)
        high, low = low, moved
    return high.astype(np.uint64) * np.uint64(a) + low


def places(numbers: np.ndarray, permutations: np.ndarray, n: int, seed: int) -> np.ndarray:
    """numbers x permutations: the place of each number below n in each of the permutations 1, 2, ... of a seed."""
    a = base(n)
    with np.errstate(over="ignore"):
        own = mix(permutations.astype(np.uint32) + np.uint32(seed * SEED_STEP & 0xFFFFFFFF))
        keys = np.stack([mix(own + np.uint32(t * ROUND_STEP & 0xFFFFFFFF)) for t in range(ROUNDS)])
        out = np.empty((len(numbers), len(permutations)), np.uint64)
        # one permutation at a time keeps the temporary arrays in the cache
        numbers = numbers.astype(np.uint64)
        for column, key in enumerate(keys.T):
            found = _rounds(numbers, key, a)
            out_of_range = np.flatnonzero(found >= n)
            while len(out_of_range):
                found[out_of_range] = _rounds(found[out_of_range], key, a)
                out_of_range = out_of_range[found[out_of_range] >= n]
            out[:, column] = found
    return out.astype(np.int64)
