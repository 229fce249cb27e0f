"""Numpy's default generator for many seeds at once: the first draws of each seed, by array arithmetic over a whole batch.

A generator object for each row costs some ten microseconds; here a batch of seeds is spread over the pool, stepped and read as columns of integers.
"""

from __future__ import annotations

import numpy as np

#: The constants by which the public seed sequence hashes a seed into its pool and reads states from it.
POOL, INIT_A, MULT_A, INIT_B, MULT_B, MIX_L, MIX_R, SHIFT = 4, 0x43B0D7E5, 0x931E8875, 0x8B51F9DD, 0x58F38DED, 0xCA01F9DD, 0x4973F715, 16
#: Fixed value: the multiplier of the public 128-bit congruential generator.
MULTIPLIER = 0x2360ED051FC65DA44385DF649FCCF645

U32, U64 = np.uint32, np.uint64
Wide = tuple[np.ndarray, np.ndarray]  # high and low halves of 128-bit numbers


class _Hash:
    """Hashes columns of 32-bit words; its constant moves on with every word."""

    def __init__(self, start: int, factor: int):
        self.now, self.factor = start, factor

    def __call__(self, value: np.ndarray) -> np.ndarray:
        value = value ^ U32(self.now)
        self.now = self.now * self.factor & 0xFFFFFFFF
        value = value * U32(self.now)
        return value ^ (value >> U32(SHIFT))


def states(seeds: np.ndarray) -> np.ndarray:
    """Four 64-bit words (rows, 4) for each seed, a whole number from 0 to 2 ** 64 - 1."""
    seeds = seeds.astype(U64)
    words = [(seeds & U64(0xFFFFFFFF)).astype(U32), (seeds >> U64(32)).astype(U32)] + [np.zeros(len(seeds), U32)] * (POOL - 2)
    mixed = _Hash(INIT_A, MULT_A)
    pool = [mixed(w) for w in words]
    for source in range(POOL):
        for target in range(POOL):
            if source != target:
                both = U32(MIX_L) * pool[target] - U32(MIX_R) * mixed(pool[source])
                pool[target] = both ^ (both >> U32(SHIFT))
    read = _Hash(INIT_B, MULT_B)
    halves = [read(pool[i % POOL]).astype(U64) for i in range(8)]
    return np.stack([halves[2 * i] | halves[2 * i + 1] << U64(32) for i in range(4)], 1)


def _product(a: np.ndarray, b: int) -> Wide:
    """a * b in 128 bits, both of 64 bits, from products of halves."""
    low = U64(0xFFFFFFFF)
    a0, a1, b0, b1 = a & low, a >> U64(32), U64(b & 0xFFFFFFFF), U64(b >> 32)
    cross = a1 * b0 + (a0 * b0 >> U64(32))
    more = a0 * b1 + (cross & low)
    return a1 * b1 + (cross >> U64(32)) + (more >> U64(32)), a * U64(b)


def _plus(a: Wide, b: Wide) -> Wide:
    low = a[1] + b[1]
    return a[0] + b[0] + (low < a[1]).astype(U64), low


def _step(state: Wide, increment: Wide) -> Wide:
    high, low = _product(state[1], MULTIPLIER & (1 << 64) - 1)
    high = high + state[0] * U64(MULTIPLIER & (1 << 64) - 1) + state[1] * U64(MULTIPLIER >> 64)
    return _plus((high, low), increment)


def first_draws(seeds: np.ndarray, count: int) -> np.ndarray:
    """(rows, count) numbers from 0 to 1: what ``numpy.random.default_rng(seed).random(count)`` gives for each seed."""
    s = states(seeds)
    increment = (s[:, 2] << U64(1) | s[:, 3] >> U64(63), s[:, 3] << U64(1) | U64(1))
    state = _step(_plus(increment, (s[:, 0], s[:, 1])), increment)  # a step from 0 leaves the increment
    out = np.empty((len(seeds), count))
    for k in range(count):
        state = _step(state, increment)
        turn = state[0] >> U64(58)
        both = state[0] ^ state[1]
        both = both >> turn | both << ((U64(64) - turn) & U64(63))
        out[:, k] = (both >> U64(11)).astype(np.float64) * 2.0**-53
    return out
