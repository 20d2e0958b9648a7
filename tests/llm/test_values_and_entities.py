"""Problems 3, 4, 7: canonical values, cars in two sources, survivors."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinspark.llm.canonical import Resolver, canonical_entries, typing_distance
from kinspark.llm.entity_match import _cells_of, _meet, _propagate, match_sources
from kinspark.llm.survivors import survivors
from kinspark.operators.stage import Stage
from kinspark.sources.tables import MEDIATED

ENTRIES = [(1, "silver", ["slv"]), (2, "red", []), (3, "grey", ["gray"]), (4, "green", []), (5, "atlas 150", []), (6, "atlas 250", [])]


@pytest.mark.parametrize(
    "value, ref",
    [("slv", 1), ("silvre", 1), ("silve", 1), ("dark red", 2), ("rred", 2), ("hundred", 0), ("gray", 3), ("gret", 3), ("gren", 4), ("atlas250", 6), ("the atlas 150 gt", 5), ("atlsa 150", 5), ("atlsa150", 5), ("at las 250", 6), ("", 0), ("zzz", 0), ("x" * 3000, 0), ("silver or red", 1)],
)
def test_resolve(value, ref):
    assert Resolver(ENTRIES).resolve(value) == ref


def test_mentions_do_not_overlap():
    r = Resolver([(1, "new york", []), (2, "york", []), (3, "new", [])])
    assert [m[2] for m in r.mentions("new york")] == [1] and sorted(m[2] for m in r.mentions("york new")) == [2, 3]
    assert Resolver([]).resolve("a") == 0


def test_typing_distance():
    assert typing_distance("gret", "grey", 2) == pytest.approx(0.9) and typing_distance("gery", "grey", 2) == pytest.approx(0.9)
    assert typing_distance("gre", "grey", 2) == 1 and typing_distance("abc", "xyz", 2) == float("inf")


def test_canonical_entries(spark, rows):
    rec = spark.createDataFrame([("a", "silver", "rred"), ("a", "silver", "rred"), ("b", None, " "), ("c", "slv", "nothing"), ("d", "Silver", "red")], "rec_id string, f string, g string")
    ref = spark.createDataFrame([(1, "f", "silver", "slv; slvr"), (2, "g", "red", None), (3, "g", None, "x")], "ref_id long, field_name string, canonical string, aliases string")
    assert rows(canonical_entries(rec, ref, ["f", "g"]), "rec_id", "field_name", "ref_id") == [("a", "g", 2), ("c", "f", 1), ("c", "g", 0), ("d", "f", 1)]
    assert canonical_entries(rec.limit(0), ref, ["f", "g"]).count() == 0
    assert {r.ref_id for r in canonical_entries(rec, ref.limit(0), ["f", "g"]).collect()} == {0}


def _car(i, **other):
    return {"location": f"town {i % 7}", "price": 9000.0 + 137 * i, "year": 2000.0 + i % 18, "manufacturer": f"make{i % 5}", "model": f"type{i % 11}", "mileage": 30000.0 + 997 * i, "latitude": 30 + i * 0.07, "longitude": -80 - i * 0.05, "main_color": ["red", "grey"][i % 2], "transmission": "automatic"} | other


def _listings(spark, rows):
    kinds = {c: "double" if c in ("price", "year", "mileage", "latitude", "longitude") else "string" for c in MEDIATED}
    return spark.createDataFrame([tuple(r.get(c) for c in MEDIATED) for r in rows], ", ".join(f"{c} {k}" for c, k in kinds.items()))


@pytest.fixture(scope="module")
def reference(spark):
    names = [(f"make{i}", "manufacturer") for i in range(5)] + [(f"type{i}", "model") for i in range(11)] + [("red", "main_color"), ("grey", "main_color")]
    return spark.createDataFrame([(i + 1, f, c, None) for i, (c, f) in enumerate(names)], "ref_id long, field_name string, canonical string, aliases string")


def test_match_sources(spark, reference):
    first = [{"id_source_vehicles": f"1{i:03d}"} | _car(i) for i in range(40)]
    second = [{"id_source_used_cars": f"S2_{i}"} | _car(i, price=9100.0 + 137 * i, mileage=round(30000.0 + 997 * i, -2)) for i in range(20, 60)]
    second[3] |= {"location": None, "model": None}
    second[4] |= {"mileage": None, "year": None}
    second[5] |= {"manufacturer": None, "latitude": None, "longitude": None, "year": second[5]["year"] + 1}
    again = {"id_source_vehicles": "1930"} | _car(30, price=9050.0 + 137 * 30)
    nothing = [{"id_source_vehicles": "1999"}, {"id_source_used_cars": "S2_999"}, {"manufacturer": "make1"}]
    df = _listings(spark, [*first, *second, again, second[0], *nothing])
    got = {(r.rec_id_a, r.rec_id_b): r.probability for r in match_sources(df, reference).collect()}
    sure = {p for p, x in got.items() if x >= 0.5}
    assert sure == {(f"1{i:03d}", f"S2_{i}") for i in range(20, 40)} | {("1930", "S2_30")}
    assert all(0 < x <= 1 for x in got.values())
    assert match_sources(df.limit(0), reference).count() == 0


def test_messages_prefer_one_to_one(spark):
    edges = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 3.0), ("b", "x", 4.0), ("c", "z", 2.0)], "u string, v string, w double")
    p = {(r.u, r.v): r.p for r in _propagate(Stage(spark), edges, 30, 1e-4).collect()}
    # The exact marginals of the three-edge chain, by listing all allowed choices.
    e = {k: np.exp(w) for k, w in ((("a", "x"), 5.0), (("a", "y"), 3.0), (("b", "x"), 4.0))}
    total = 1 + sum(e.values()) + e["a", "y"] * e["b", "x"]
    assert p["a", "x"] == pytest.approx(e["a", "x"] / total, abs=0.01)
    assert p["a", "y"] == pytest.approx((e["a", "y"] + e["a", "y"] * e["b", "x"]) / total, abs=0.01)
    assert p["c", "z"] == pytest.approx(1 / (1 + np.exp(-2)))


def test_messages_that_never_settle_raise(spark):
    edges = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 3.0), ("b", "x", 4.0)], "u string, v string, w double")
    with pytest.raises(RuntimeError):
        _propagate(Stage(spark), edges, 2, 1e-9)


def test_hot_blocks_are_split_without_losing_pairs(spark):
    r = random.Random(4)
    df = spark.createDataFrame([(1 if i % 3 else i, i, r.randrange(4), 3, 0, -1) for i in range(120)], "key long, id long, codes long, known long, year int, miles int")
    run = lambda most: sorted((x.i, x.j) for x in _cells_of(df, df, most, 1).mapInArrow(_meet, "i long, j long").collect())
    whole = run(1000)
    assert len(whole) > 500 and run(10) == whole


def test_meeting_across_batches():
    known = (1 << 14) - 1
    cols = [[1, 1, 1, 2, 2], [5, 6, 7, 5, 8], [1, 2, 0, 0, 0], [known, known, 0, 0, 0], [2000, 2001, 0, 0, 0], [100, 90000, -1, -1, -1], [0] * 5]
    for size in (1, 2, 5):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], names=list("abcdefg")) for i in range(0, 5, size)]
        assert sorted(p for b in _meet(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())) == [(5, 7), (5, 8), (6, 7)]


def test_survivors(spark):
    rows = [("v", "a", 10, "x", None), ("v", "b", 20, None, 2.0), ("v", "S2_c", 5, "y", 3.0), ("v", "a", 10, "x", None), ("w", "d", None, None, None), (None, "e", 1, "z", 1.0), ("t", "f", 1, "x", 1.0), ("t", "g", 1, "x", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k string, r string, at long, name string, n double, several string")
    out = survivors(df, "k", "r", "at", {"name": F.col("name").isNotNull(), "n": F.col("n") > 0}, F.when(F.col("r").startswith("S2_"), 1).otherwise(0))
    got = {x.k: x for x in out.collect()}
    assert set(got) == {"v", "w", "t"}
    v = got["v"]
    assert (v.several, v["name"], v["n"], v.latest, v.latest_alone, v.fullest, v.fullest_alone) == (True, "y", 3.0, "b", True, "S2_c", True)
    assert (got["w"].several, got["w"]["name"], got["w"].latest) == (False, None, "d")
    assert (got["t"].latest_alone, got["t"].fullest, got["t"].fullest_alone) == (False, "f", True)
    assert survivors(df.limit(0), "k", "r", "at", {"n": F.col("n") > 0}, F.lit(0)).count() == 0
