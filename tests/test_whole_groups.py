"""Negatives from whole groups, exact profiles, leaders of keys with many rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from kinspark.operators.groundtruth import leaders, negative_candidates, with_attributes
from kinspark.operators.profile import describe, drop_incomplete, dropped_counts, profile
from kinspark.operators.stage import Stage, close_all
from kinspark.sources.tables import PAIR_ATTRIBUTES


def _cars(spark, groups):
    rows = [(f"r{g}_{i:03}", f"v{g}_{i // 2}", f"make{g}", 2000.0, "suv", 1) for g, n in enumerate(groups) for i in range(n)]
    return spark.createDataFrame(rows, "rec_id string, vin string, manufacturer string, year double, body_type string, _rank int")


def test_every_record_of_a_large_group_can_be_drawn(spark):
    pairs = [tuple(r) for r in negative_candidates(_cars(spark, [130, 50, 1]), ["mfr", "yr"]).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)
    small = {p for p in pairs if p[0].startswith("r1_")}
    assert len(small) == 50 * 49 // 2 - 25  # all pairs but those of one key
    large = [p for p in pairs if p[0].startswith("r0_")]
    degree = Counter(x for p in large for x in p)
    assert len(degree) == 130 and 130 * 23 <= len(large) <= 130 * 25
    assert all(int(a[3:]) // 2 != int(b[3:]) // 2 for a, b in pairs)


def test_negatives_of_nothing(spark):
    assert negative_candidates(_cars(spark, []), ["mfr", "yr"]).count() == 0


def test_attributes_of_a_record_with_several_rows_do_not_change(spark):
    kinds = ", ".join(f"{a} {'double' if a in ('price', 'year', 'mileage', 'latitude', 'longitude') else 'string'}" for a in PAIR_ATTRIBUTES)
    row = lambda i, price: (i, *[price if a == "price" else None for a in PAIR_ATTRIBUTES])
    records = spark.createDataFrame([row("a", 5.0), row("a", 3.0), row("b", 1.0)], "rec_id string, " + kinds)
    got = with_attributes(spark.createDataFrame([("a", "b", 1), ("a", "z", 0)], "id_A string, id_B string, label int"), records).collect()
    assert [(r.price_A, r.price_B) for r in got] == [(3.0, 1.0)]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500])
def test_quartiles_are_exact(spark, n):
    r = random.Random(n)
    rows = [(r.choice([-1.0, 0.0, 3.5, r.uniform(-1e6, 1e6), 10.0**12]), None if i % 3 else 5.0) for i in range(n)] + [(None, None)]
    got = {x.attribute: x for x in describe(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).collect()}
    for k, c in enumerate("xy"):
        values = [v[k] for v in rows if v[k] is not None]
        assert got[c].n == len(values)
        want = np.quantile(values, [0.25, 0.5, 0.75]).tolist() if values else [None] * 3
        assert [got[c].q25, got[c].q50, got[c].q75] == pytest.approx(want) if values else [got[c].q25, got[c].q50, got[c].q75] == want


def test_profile(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), ("b", 2.0)], "t string, x double")
    for approximate in (False, True):
        assert sorted(tuple(r) for r in profile(df, approximate).collect()) == [("t", 25.0, 50.0, "string"), ("x", 25.0, 50.0, "double")]
        assert {tuple(r)[1:3] for r in profile(df.limit(0), approximate).collect()} == {(0.0, 0.0)}


def test_dropped_rows_are_counted(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), (None, None)], "t string, x int")
    assert {r.attribute: r.n_missing for r in dropped_counts(df, ["t", "x"]).collect()} == {"t": 2, "x": 1, "(any)": 2}
    assert drop_incomplete(df, ["t", "x"]).count() == 1


def test_leaders_of_a_key_with_many_equal_rows(spark):
    r = random.Random(5)
    names = list("pqrstu")
    rows = [("hot" if i % 3 else f"k{i % 7}", f"id{i:04}", r.choice([None, *range(20)]), *(r.choice([None, "x", "y"]) for _ in names)) for i in range(600)]
    df = spark.createDataFrame(rows, "vin string, rec_id string, utc_second int, " + ", ".join(f"{c} string" for c in names))
    want = defaultdict(list)
    for row in sorted(rows, key=lambda x: (x[0], x[2] is None, -(x[2] or 0), x[1])):
        if all(sum(a != b for a, b in zip(row[3:], other[3:])) > 1 for other in want[row[0]]):
            want[row[0]].append(row)
    got = [tuple(x) for x in leaders(df, compared=names, most=1).collect()]
    assert sorted(got, key=repr) == sorted((x for v in want.values() for x in v), key=repr)
    assert leaders(df.limit(0), compared=names).count() == 0


def test_stages_are_deleted(spark):
    stage = Stage(spark)
    kept = stage.put(spark.range(3), "t")
    other = stage.put(spark.range(4), "t")
    assert kept.count() == 3 and other.count() == 4
    jvm = spark.sparkContext._jvm
    exists = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(p))
    stage.drop(other)
    assert exists(kept._kinspark_path) and not exists(other._kinspark_path)
    close_all()
    assert not exists(stage.root)
