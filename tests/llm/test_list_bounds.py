"""Pairs of an inverted list that what is left behind the common value rules out aren't compared further."""

import numpy as np

from kinspark.llm.near_duplicates import Lists


def test_what_is_left_bounds_the_length_of_the_other():
    zero = np.zeros(3, np.int64)
    rows = [zero, np.arange(3), np.array([80, 80, 85]), np.array([12, 16, 0]), zero, zero, zero, zero]
    fit = Lists(4, 5).fit(rows, np.array([0, 1]), np.array([2, 2]))
    assert fit.tolist() == [True, False]  # 68 of 85 are needed: 68 and 64 are left
