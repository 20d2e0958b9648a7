"""What problem 4 learns rests on all records and all candidate pairs."""

import inspect
import random

import numpy as np
from pyspark.sql import functions as F

from kinspark.llm.entity_match import COMPARED, LEVELS, _by_chance, _levels, match_sources


def test_levels_are_counted_over_all_pairs(spark):
    r = random.Random(1)
    maybe = lambda x: x if r.random() > 0.2 else None
    rows = []
    for i in range(180):
        lat = maybe(round(r.uniform(29.5, 30.6), 3))
        rows.append((
            f"r{i:03}", i, r.choice((0, 1, 2)), r.choice((0, 3, 4, 5)), r.choice((0, 7, 8)), maybe(r.randrange(5)), maybe(r.randrange(1995, 2010)), maybe(r.choice((0, 100, 30_000, 31_000, r.randrange(200_000)))),
            maybe(float(r.choice((100, 130, r.randrange(100, 40_000))))), lat, None if lat is None else round(r.uniform(-0.7, 0.7), 3), maybe(4), maybe(r.randrange(3)), maybe(1), maybe(r.randrange(2)), maybe(2), maybe(r.randrange(60)),
        ))
    rows += [("s1", 900, *rows[0][2:]), ("s2", 901, *rows[0][2:])]
    schema = "rec string, id long, make int, model int, color int, loc long, year int, miles int, price float, lat float, lon float, cyl int, body int, gear int, drive int, fuel int, vin long"
    coded = spark.createDataFrame(rows, schema)
    pairs = coded.alias("a").join(coded.alias("b"), F.col("a.id") < F.col("b.id")).select(*[c.alias(f) for f, c in _levels().items()]).toPandas()
    got = _by_chance(coded)
    for f in COMPARED:
        want = np.bincount(pairs[f], minlength=LEVELS)
        assert got[f][1:].tolist() == want[1:].tolist(), f
    assert all(not x.any() for x in _by_chance(coded.limit(0)).values())


def test_no_sample_sizes():
    assert not {"sample", "random"} & set(inspect.signature(match_sources).parameters)
