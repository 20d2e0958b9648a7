import pytest
from pyspark.sql import functions as F

from kinspark.operators import blocking, evaluate, groundtruth, hash_order, mediate, profile, serialize
from kinspark.sources.tables import MEDIATED, PAIR_ATTRIBUTES

PAIR = "id_A string, id_B string, year_A string, year_B string, manufacturer_A string, manufacturer_B string, model_A string, model_B string, fuel_type_A string, fuel_type_B string, label int"


def _pairs(spark, *cases):
    return spark.createDataFrame([(str(i), f"b{i}", *c, 1) for i, c in enumerate(cases)], PAIR)


def test_blocking_cases(spark, rows):
    p = _pairs(
        spark,
        ("2020", "2020", "Toyota", "toyota", "a", "b", "gas", "x"),
        ("2020", "2019", "Toyota", "Toyota", "a", "a", "gas", "gas"),
        ("2022", "2022", "Honda", "honda", "Civic", "civic", "gas", "gas"),
        ("2022", "2022", "Honda", "honda", "Civic", "civic", "gas", "diesel"),
        ("2020.0", "2020", "kia", "kia", "rio", "rio", None, None),
        (None, None, "kia", "kia", "rio", "rio", "gas", "gas"),
        ("2020", "2020", None, None, "rio", "rio", "gas", "gas"),
    )
    assert [r[0] for r in rows(blocking.block(p, "B1"), "id_A")] == ["0", "2", "3", "4"]
    assert [r[0] for r in rows(blocking.block(p, "B2"), "id_A")] == ["2", "4"]
    s = blocking.blocking_stats(p, "B1").first()
    assert (s["positives_in_test"], s["positives_captured"], s["n_candidates"], s["blocking_recall"]) == (7, 4, 4, 0.571429)
    empty = blocking.blocking_stats(p.limit(0), "B2").first()
    assert (empty["blocking_recall"], empty["reduction_ratio_vs_test"], empty["n_test_pairs"]) == (0.0, 0.0, 0)
    with pytest.raises(ValueError):
        blocking.block(p, "B3")
    assert blocking.block(p.drop("fuel_type_A", "fuel_type_B"), "B2").count() == 3  # an absent column is a missing value


def test_block_records_equals_the_pair_predicate(spark, rows):
    r = spark.createDataFrame([("1", 2020.0, "toyota"), ("2", 2020.0, "toyotta"), ("3", 2020.0, "honda"), ("4", None, "toyota"), ("5", 2020.0, None), ("2", 2020.0, "toyotta")], "rec_id string, year double, manufacturer string")
    assert rows(blocking.block_records(r)) == [("1", "2")]


def test_global_predictions_and_metrics(spark, rows):
    truth = spark.createDataFrame([("1", "10", 1), ("2", "20", 0), ("3", "30", 1), ("4", "40", 0)], "id_A string, id_B string, label int").withColumn("pos", F.lit(0))
    cand = spark.createDataFrame([("1", "10", 1, 0), ("20", "2", 1, 1)], "id_A string, id_B string, pred int, pos int")
    g = evaluate.global_predictions(truth, cand, ["pos"])
    assert [r[3] for r in rows(g)] == [1, 1, 0, 0]
    m = evaluate.confusion(g).first()
    assert tuple(m) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    again = cand.unionByName(spark.createDataFrame([("10", "1", 0, 5)], cand.schema))
    assert [r[3] for r in rows(evaluate.global_predictions(truth, again, ["pos"]))] == [0, 1, 0, 0]  # the last wins
    assert tuple(evaluate.confusion(g.limit(0)).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_threshold_sweep(spark):
    s = spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.55), (0, 0.2), (None, 0.5), (1, None)], "label int, prob double")
    assert tuple(evaluate.best_threshold(s).first()) == (0.6, 1.0)
    assert evaluate.threshold_sweep(s).count() == 18
    none = spark.createDataFrame([(0, 0.9), (0, 0.3)], "label int, prob double")
    assert tuple(evaluate.best_threshold(none).first()) == (0.1, 0.0)
    tie = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, prob double")
    assert evaluate.best_threshold(tie).first()["threshold"] == 0.15


def test_leaders(spark, rows):
    cols = [f"c{i}" for i in range(14)]
    base = list("abcdefghijklmn")
    r1 = ("v", "r1", 30, *base)
    r2 = ("v", "r2", 20, *"xyz", *base[3:])
    r3 = ("v", "r3", 10, *"xyzw", *base[4:])
    nulls = ("w", "r4", None, *[None] * 14)
    near = ("w", "r5", None, *[None] * 11, "a", "b", "c")
    df = spark.createDataFrame([r3, r2, r1, near, nulls], "vin string, rec_id string, utc_second long, " + ", ".join(f"{c} string" for c in cols))
    assert rows(groundtruth.leaders(df, compared=cols), "rec_id") == [("r1",), ("r3",), ("r4",)]
    assert groundtruth.leaders(df.limit(0), compared=cols).count() == 0


def _records(spark, cases):
    return spark.createDataFrame([(r, v, m, y, b) for r, v, m, y, b in cases], "rec_id string, vin string, manufacturer string, year double, body_type string").select("*", *[F.lit(None).cast("string").alias(c) for c in PAIR_ATTRIBUTES if c not in ("manufacturer", "year", "body_type")])


def test_ground_truth_invariants(spark):
    cases = [(f"{'S2_' if i % 2 else ''}{i}", f"v{i // 2}", f"m{i % 3}", 2000.0 + i % 2, f"b{i % 4}") for i in range(60)]
    r = _records(spark, [*cases, cases[0]])
    pos = groundtruth.positive_pairs(r)
    neg = groundtruth.negative_pairs(r, pos, 40)
    p, n = {(x.id_A, x.id_B) for x in pos.collect()}, [(x.id_A, x.id_B) for x in neg.collect()]
    assert len(p) == 30 and all(a < b for a, b in [*p, *n]) and len(set(n)) == len(n) and not p & set(n) and len(n) <= 40
    gt = groundtruth.split(groundtruth.ground_truth(r))
    assert gt.columns[:2] == ["id_A", "location_A"] and gt.columns[-2:] == ["label", "split"]
    counts = {(x.label, x.split): x["count"] for x in gt.groupBy("label", "split").count().collect()}
    assert (counts[1, "train"], counts[1, "val"], counts[1, "test"]) == (21, 3, 6)
    shares = {x.stratum: x.pct for x in groundtruth.stratum_shares(neg).collect()}
    assert sum(shares.values()) == pytest.approx(100)
    assert groundtruth.stratum_shares(neg.limit(0)).count() == 0


def test_negatives_of_a_large_group_grow_in_proportion(spark):
    r = _records(spark, [(str(i), f"v{i}", None, None, None) for i in range(80)])
    pairs = groundtruth.negative_candidates(r, ["mfr", "yr"], most=10).collect()
    assert len(pairs) == 80 * 5 and len({x for p in pairs for x in p}) == 80


def test_hash_order(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") % 3).cast("int"))
    ranked = hash_order.with_rank(df, ["id"], groups=["g"])
    per = {r["g"]: (r["lo"], r["hi"], r["n"], r["size"]) for r in ranked.groupBy("g").agg(F.min("_rank").alias("lo"), F.max("_rank").alias("hi"), F.count_distinct("_rank").alias("n"), F.max("_n").alias("size")).collect()}
    assert per == {0: (1, 334, 334, 334), 1: (1, 333, 333, 333), 2: (1, 333, 333, 333)}
    first, again = ({r.id for r in hash_order.take(df, 10, ["id"]).collect()} for _ in range(2))
    assert first == again and len(first) == 10
    assert hash_order.take(df.limit(0), 5, ["id"]).count() == 0


def test_row_ids_are_dense(spark):
    df = spark.range(0, 500, 1, 7).withColumn("k", -F.col("id"))
    got = {(r.k, r.id) for r in mediate.with_row_id(df.drop("id"), ["k"]).collect()}
    assert got == {(-i, f"S2_{499 - i}") for i in range(500)}


def test_mediate(spark):
    first = spark.createDataFrame([("7.0", "u", "Austin", "12", "2010", "Ford!", "F 150", "gasoline", "A", "1e3", "x http://q y", None)], "id string, url string, region string, price string, year string, manufacturer string, model string, fuel string, transmission string, odometer string, description string, VIN string")
    second = spark.createDataFrame([("S2_0", "Dallas", "x", "KIA", "m")], "id string, city string, price string, make_name string, transmission string")
    out = mediate.mediate(first, second)
    assert out.columns == [c for c in MEDIATED if c in out.columns]
    a = out.where("id_source_vehicles is not null").first()
    assert (a.id_source_vehicles, a.location, a.price, a.manufacturer, a.fuel_type, a.transmission, a.mileage, a.description) == ("7", "austin", 12.0, "ford", "gas", "automatic", 1000.0, "x y")
    b = out.where("id_source_used_cars is not null").first()
    assert (b.id_source_used_cars, b.manufacturer, b.price, b.transmission, b.year) == ("S2_0", "kia", None, "manual", None)


def test_source_cleaning(spark):
    df = spark.createDataFrame([(i, None if i < 7 else "x", None if i < 8 else "y", None if i == 9 else "m") for i in range(10)], "id int, at70 string, above string, manufacturer string")
    kept = profile.drop_mostly_missing(df)
    assert kept.columns == ["id", "at70", "manufacturer"]
    assert mediate.clean_first(df).count() == 9
    assert profile.drop_mostly_missing(df.limit(0)).columns == df.columns


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "a"), (None, None)], "x int, y string")
    p = {r.attribute: (r.missing_pct, r.unique_pct, r.data_type) for r in profile.profile(df).collect()}
    assert p == {"x": (25.0, 50.0, "int"), "y": (50.0, 25.0, "string")}
    assert {r.pattern: r.n_rows for r in profile.missing_patterns(df).collect()} == {"00": 2, "01": 1, "11": 1}
    d = profile.describe(df, ["x"]).first()
    assert (d.n, d["mean"], d["min"], d.q50, d["max"]) == (3.0, pytest.approx(5 / 3), 1.0, 2.0, 2.0)
    assert [r.missing_pct for r in profile.null_percents(df.limit(0)).collect()] == [0.0, 0.0]


def test_serialize(spark):
    df = spark.createDataFrame([("ford", 2015.0, None, "a\tb", "ford", 7), (None, 1e7, "nan", "", None, 1)], "manufacturer_A string, year_A double, model_A string, description_A string, manufacturer_B string, label int")
    assert [r.value for r in serialize.pair_lines(df).collect()] == [
        "COL manufacturer VAL ford COL year VAL 2015.0 COL description VAL a b\tCOL manufacturer VAL ford\t0",
        "COL year VAL 10000000.0\t\t1",
    ]
