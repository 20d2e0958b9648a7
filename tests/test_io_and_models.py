import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.matching import models
from kinspark.operators.groundtruth import split
from kinspark.plans import core_queries
from kinspark.plans.pipeline import run_step
from kinspark.sources import io
from kinspark.streaming.listings import arriving, read_listings


def test_csv_round_trip_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q"\nline', 1.5), ("2", "NA", None)], "id string, t string, x double")
    io.write_csv(df, str(tmp_path / "c"))
    got = sorted(tuple(r) for r in io.read_csv(spark, str(tmp_path / "c"), "id string, t string, x double", multi_line=True).collect())
    assert got == [("1", 'a "q"\nline', 1.5), ("2", None, None)]
    assert io.read_csv(spark, str(tmp_path / "c"), columns=["id", "nothing"]).dtypes == [("id", "string")]
    with pytest.raises(FileNotFoundError, match="nowhere"):
        io.read_csv(spark, str(tmp_path / "nowhere"))


def test_csv_types(spark, tmp_path):
    spark.createDataFrame([("1", "4.5", "a"), ("2", "x", "NA")], "id string, x string, t string").write.option("header", True).csv(str(tmp_path / "c"))
    at = str(tmp_path / "c")
    assert sorted(tuple(r) for r in io.read_csv(spark, at, doubles=["x", "nothing"]).collect()) == [("1", 4.5, "a"), ("2", None, None)]
    assert dict(io.read_csv(spark, at, infer=True).dtypes) == {"id": "int", "x": "string", "t": "string"}


def test_other_files(spark, tmp_path):
    io.write_json({"a": 1}, str(tmp_path / "m" / "x.json"))
    assert io.load_json(str(tmp_path / "m" / "x.json")) == {"a": 1}
    assert io.read_json(spark, str(tmp_path / "m" / "x.json")).first()["a"] == 1
    io.write_lines(spark.createDataFrame([("l",)], "value string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "l"
    c = io.Catalog(str(tmp_path))
    assert c.split("val").endswith("ground_truth/val")
    for bad in (lambda: c.split("x"), lambda: c.model("x"), lambda: c.candidates("B9")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileNotFoundError):
        io.load_json(str(tmp_path / "none.json"))


@pytest.fixture(scope="module")
def splits(spark, data):
    sets = core_queries._splits(spark, data)
    p = split(sets[0].unionByName(sets[1]).unionByName(sets[2]).dropDuplicates(["id_A", "id_B"])).persist()
    return [p.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")]


@pytest.mark.parametrize("name", list(models.FITS))
def test_matchers_learn(splits, name):
    fit = (lambda *a: models.fit_logistic(*a, strengths=[1.0], balances=(False,))) if name == "logistic" else models.FITS[name]
    fitted = fit(splits[0], splits[1])
    rows = fitted.score(splits[2]).collect()
    assert rows and sum(r.pred == r.label for r in rows) / len(rows) >= (0.6 if name == "text" else 0.7)
    assert fitted.score(splits[2].limit(0)).count() == 0


def test_saved_model_scores_the_same(spark, splits, tmp_path):
    fitted = models.fit_distance(splits[0], splits[1], sample=200)
    fitted.save(str(tmp_path / "m"), str(tmp_path / "m.json"))
    again = models.load(spark, str(tmp_path / "m"), str(tmp_path / "m.json"))
    assert again.threshold == fitted.threshold and models.evaluate(again, splits[2]) == models.evaluate(fitted, splits[2])
    few = models.training_sample(splits[0], 40, 0.5)
    assert 20 <= few.count() <= 40 and few.columns == splits[0].columns


def test_a_scorer_of_batches(splits):
    def equal_starts():  # inside, so that workers need no import of this file
        return lambda left, right: np.array([1.0 if a[:40] == b[:40] else 0.1 for a, b in zip(left, right)])

    scorer = models.BatchScorer("starts", equal_starts, batch_size=7).tuned(splits[1])
    rows = scorer.score(splits[2]).collect()
    assert rows and {r.prob for r in rows} <= {1.0, 0.1} and all(r.pred == int(r.prob >= scorer.threshold) for r in rows)
    assert models.compare(*splits, models=("starts",), fitted={"starts": scorer}, strategies=("B1",))[0]["model"] == "starts"


def test_comparison_rows(splits):
    rows = models.compare(*splits, models=("text",))
    assert [r["strategy"] for r in rows] == ["B1", "B2"] and rows[0]["tp"] + rows[0]["fn"] == rows[0]["positives_in_test"]


def test_pipeline_from_csv(spark, data, tmp_path):
    for first, name in ((True, "first"), (False, "second")):
        df = core_queries._source(spark, data, first)
        io.write_csv(df.drop("id") if not first else df, str(tmp_path / name))
    c = io.Catalog(str(tmp_path / "out"))
    c.ensure()
    for step in ("mediate", "ground_truth", "block", "lines"):
        run_step(spark, step, c, str(tmp_path / "first"), str(tmp_path / "second"), ["B1"])
    n = {s: io.read_table(spark, c.split(s)).count() for s in io.SPLITS}
    assert n["train"] > n["test"] > 0
    assert io.load_json(c.stats("B1"))["n_test_pairs"] == n["test"]


def test_stream_counts_each_listing_once(spark, data, tmp_path):
    src = spark.read.parquet(f"{data}/mediated_schema_normalized.parquet")
    for i in range(2):
        src.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = arriving(read_listings(spark, str(tmp_path / "in"), src.schema)).writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select count(*) n, count(distinct rec_id) m from arrived").first()
    assert got.n == got.m == src.select(F.coalesce("id_source_vehicles", "id_source_used_cars")).distinct().count()
