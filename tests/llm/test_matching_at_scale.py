"""What problem 4 learns about matches doesn't drift to chance pairs, which outnumber them the more the larger the tables."""

import itertools
import math

import numpy as np
import pytest

from kinspark.llm.entity_match import COMPARED, LEVELS, RARE, _learn

N, MATCHES, CHANCE = 25_000_000, 18_700_000, 2_000_000_000
YEARS, MILES, PRICES, PLACES = (0.9, 0.1), (0.25, 0.37, 0.38), (0.47, 0.47, 0.06), (0.71, 0.29)


def _code(**levels):
    """As _patterns makes it; places of one in 128 records, models of one in 256."""
    code = sum(k << 3 * COMPARED.index(f) for f, k in levels.items())
    bits = {"loc_bits": 7 * (levels["loc"] == 1), "model_bits": 8 * (levels["name"] == 1), "make_bits": 0}
    return code | sum(bits[c] << 3 * len(COMPARED) + 4 * at for at, c in enumerate(RARE.values()))


def _patterns():
    """Matches, 40 % of them with a VIN on both sides; and chance pairs of one model at one place, in which years, prices and positions agree more often than in others."""
    rows = []
    for vin, known in ((1, 0.4), (0, 0.6)):
        for (y, a), (m, b), (p, c), (x, d) in itertools.product(*(list(enumerate(q, 1)) for q in (YEARS, MILES, PRICES, PLACES))):
            rows.append((_code(loc=1, name=1, vin=vin, year=y, miles=m, price=p, place=x), int(MATCHES * known * a * b * c * d)))
    for (y, a), (m, b), (p, c), (x, d) in itertools.product(*(list(enumerate(q, 1)) for q in ((0.6, 0.4), (0.0001, 0.001, 0.01, 0.9889), (0.2, 0.3, 0.5), (0.001, 0.01, 0.1, 0.889)))):
        rows.append((_code(loc=1, name=1, vin=0, year=y, miles=m, price=p, place=x), int(CHANCE * a * b * c * d)))
    return rows


def _chance():
    pairs = N * (N - 1) / 2
    shares = {"loc": (2**-7, 1 - 2**-7), "name": (2**-8, 1 - 2**-8, 0, 0), "vin": (0, 0.16), "year": (0.06, 0.1, 0.08, 0.76), "miles": (1e-4, 2e-3, 2e-2, 0.05, 0.92), "price": (0.02, 0.03, 0.05, 0.1, 0.8), "place": (2e-6, 2e-5, 1e-3, 1e-2, 0.98)}
    out = {f: np.zeros(LEVELS) for f in COMPARED}
    for f, q in shares.items():
        out[f][1 : len(q) + 1] = pairs * np.array(q)
    out["vin"][1] = 0.4 * MATCHES
    return out


def test_chance_pairs_are_not_taken_for_matches(spark):
    worth, prior = _learn(spark.createDataFrame(_patterns(), "code long, n long"), _chance(), N)
    assert 2**prior * N * (N - 1) / 2 == pytest.approx(MATCHES, rel=0.15)
    found = [math.log2(q) for q in PLACES]
    assert worth["place"][1] - worth["place"][2] == pytest.approx(found[0] - found[1] + math.log2(10), abs=0.2)  # chance: one in ten
