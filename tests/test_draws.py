"""Draws of many seeds at once against numpy's own generator, seed by seed."""

import numpy as np

from quillforge.functions.draws import first_draws


def test_first_draws_equal_the_generator():
    seeds = np.array([0, 1, 2, 42, 2**31, 2**32 - 1, 2**32, 2**40 + 7, 2**63 - 1, *range(100, 400), *np.random.default_rng(1).integers(0, 2**63 - 1, 300).tolist()], np.uint64)
    got = first_draws(seeds, 9)
    assert np.array_equal(got, np.array([np.random.default_rng(int(s)).random(9) for s in seeds]))
    assert first_draws(np.zeros(0, np.uint64), 5).shape == (0, 5)
