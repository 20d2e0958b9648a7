"""Three matchers on labelled pairs: logistic, distance and text. All are Spark ML pipelines.

Each has ``fit(train, val)``, which tunes on val without blocking, and gives a Fitted with
its threshold; ``save`` and ``load`` keep all of it. The text matcher stands in for a
transformer, which needs libraries that this engine doesn't require; ``BatchScorer`` takes
any other scorer of serialised pairs, which then gets them in batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.blocking import block, blocking_stats
from ..operators.evaluate import best_threshold, confusion, global_predictions, threshold_sweep
from ..operators.hash_order import take
from ..operators.serialize import serialized
from ..sources.io import load_json, load_model, save_model, write_json
from .features import LOGISTIC, distance_features, logistic_features

STRENGTHS = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
KEEP = ["id_A", "id_B", "label"]
ROWS_PER_TASK = 50_000


@dataclass
class Fitted:
    """A model, its threshold, and what turns pairs into its features."""

    name: str
    model: PipelineModel
    threshold: float
    featurize: Callable[[DataFrame], DataFrame]
    meta: dict = field(default_factory=dict)

    def score(self, pairs: DataFrame) -> DataFrame:
        """id_A, id_B, label, prob, pred; a pair that can't be scored has prob 0."""
        out = self.model.transform(self.featurize(pairs))
        prob = F.coalesce(vector_to_array("probability")[1], F.lit(0.0))
        return out.select(*[c for c in KEEP if c in out.columns], prob.alias("prob")).withColumn("pred", (F.col("prob") >= self.threshold).cast("int"))

    def save(self, path: str, meta: str) -> None:
        """The model to the folder ``path``, everything else to the JSON file ``meta``."""
        save_model(self.model, path)
        write_json(self.meta | {"name": self.name, "threshold": self.threshold}, meta)


def load(spark: SparkSession, path: str, meta: str) -> Fitted:
    """What ``Fitted.save`` wrote."""
    about = load_json(meta)
    return Fitted(about["name"], load_model(spark, path), about["threshold"], FEATURIZE[about["name"]], about)


@dataclass
class BatchScorer:
    """Any scorer of serialised pairs: ``make`` is called once per Python worker, which may load a model there, and gives a function from two arrays of texts to the probabilities of a match."""

    name: str
    make: Callable[[], Callable]
    threshold: float = 0.5
    batch_size: int = 64
    meta: dict = field(default_factory=dict)

    def score(self, pairs: DataFrame) -> DataFrame:
        """As ``Fitted.score``; ``batch_size`` pairs at a time."""
        prob = predict_batch_udf(self.make, return_type=DoubleType(), batch_size=self.batch_size)
        texts = pairs.select(*[c for c in KEEP if c in pairs.columns], serialized(pairs, "_A").alias("_a"), serialized(pairs, "_B").alias("_b"))
        scored = texts.withColumn("prob", F.coalesce(prob("_a", "_b"), F.lit(0.0))).drop("_a", "_b")
        return scored.withColumn("pred", (F.col("prob") >= self.threshold).cast("int"))

    def tuned(self, val: DataFrame) -> BatchScorer:
        """With the threshold of the best F1 on ``val``."""
        best = best_threshold(self.score(val)).first()
        return replace(self, threshold=best["threshold"] if best else 0.5)


def evaluate(fitted: Fitted | BatchScorer, pairs: DataFrame) -> dict:
    """Counts and scores of a model, fitted now or loaded, on labelled pairs."""
    return confusion(fitted.score(pairs)).first().asDict() | {"model": fitted.name, "threshold_used": fitted.threshold}


def _weights(train: DataFrame) -> DataFrame:
    """``train`` with ``_w``: the same total weight for both labels."""
    n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    w = F.lit(1.0)
    for label, k in n.items():
        w = F.when(F.col("label") == label, F.lit(total / (2.0 * k))).otherwise(w)
    return train.withColumn("_w", w)


def _tune(name: str, names: list[str], train: DataFrame, val: DataFrame, strengths: list[float], balances: list[bool]) -> Fitted:
    """Best F1 on val over strengths and balances (the first of equals), with its threshold.

    Features are assembled once and kept, in few partitions if they are few; fits run side
    by side, and one pass over val sweeps the thresholds of all of them. ``strengths`` are
    those of the loss: its weight against half the squared norm of the coefficients.
    """
    featurize = FEATURIZE[name]
    join = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    tr = _weights(join.transform(featurize(train)).select("features", F.col("label").cast("double").alias("label"))).persist()
    va = featurize(val).select("label", *[F.col(c).cast("double").alias(c) for c in names]).persist()
    try:
        n = tr.count()
        few = tr.coalesce(max(1, -(-n // ROWS_PER_TASK)))
        grid = [(c, balanced) for c in strengths for balanced in balances]

        def fit(at: tuple[float, bool]):
            c, balanced = at
            lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=100, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, **({"weightCol": "_w"} if balanced else {}))
            return lr.fit(few)

        with ThreadPool(min(4, len(grid))) as pool:
            fitted = pool.map(fit, grid)
        sums = [sum((F.col(c) * float(w) for c, w in zip(names, m.coefficients)), F.lit(float(m.intercept))) for m in fitted]
        probs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (1 / (1 + F.exp(-x))).alias("prob")) for k, x in enumerate(sums)]))
        rows = threshold_sweep(va.select("label", probs.alias("x")).select("label", "x.*"), by=["k"]).collect()
    finally:
        tr.unpersist()
        va.unpersist()
    f1 = lambda r: 2 * r["tp"] / max(2 * r["tp"] + r["fp"] + r["fn"], 1)
    best = min(rows, key=lambda r: (-f1(r), r["k"], r["threshold"]), default={"k": 0, "threshold": 0.5, "tp": 0, "fp": 0, "fn": 0})
    c, balanced = grid[best["k"]]
    return Fitted(name, PipelineModel([join, fitted[best["k"]]]), best["threshold"], featurize, {"C": c, "balanced": balanced, "threshold": best["threshold"], "val_f1": round(f1(best), 6)})


def fit_logistic(train: DataFrame, val: DataFrame, strengths: list[float] | None = None, balances: tuple[bool, ...] = (False, True)) -> Fitted:
    return _tune("logistic", LOGISTIC, train, val, strengths or STRENGTHS, list(balances))


def training_sample(train: DataFrame, n: int, blocked: float = 0.9, seed: int = 42) -> DataFrame:
    """``n`` pairs in hash order, a share of ``blocked`` from those that B1 keeps (as far as there are enough of each)."""
    keys = ["id_A", "id_B"]
    inside = block(train, "B1")
    outside = train.join(inside.select(*keys).distinct(), keys, "left_anti").select(*train.columns)
    k = int(n * blocked)
    return take(inside, k, keys, seed).unionByName(take(outside, n - k, keys, seed))


def fit_distance(train: DataFrame, val: DataFrame, sample: int | None = None, blocked: float = 0.9, strengths: list[float] | None = None) -> Fitted:
    """On all of ``train``, or a sample of it."""
    _, names = distance_features(train)
    return _tune("distance", names, train if sample is None else training_sample(train, sample, blocked), val, strengths or [1.0], [False])


def text_features(pairs: DataFrame) -> DataFrame:
    """Overlaps of the serialised records: shared words of either side, of both, and of the descriptions."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    out = pairs.withColumns({"_a": words(serialized(pairs, "_A")), "_b": words(serialized(pairs, "_B"))})
    da, db = (words(F.coalesce(F.col(f"description_{s}"), F.lit(""))) for s in "AB")
    out = out.withColumns({"_s": F.size(F.array_intersect("_a", "_b")), "_d": F.size(F.array_intersect(da, db)), "_dn": F.least(F.size(da), F.size(db))})
    n_a, n_b = F.size("_a"), F.size("_b")
    return out.withColumns({"t_jaccard": F.col("_s") / (n_a + n_b - F.col("_s")), "t_inside": F.col("_s") / F.least(n_a, n_b), "t_length": F.abs(n_a - n_b) / F.greatest(n_a, n_b), "t_text": F.col("_d") / F.greatest(F.col("_dn"), F.lit(1))}).drop("_a", "_b", "_s", "_d", "_dn")


def fit_text(train: DataFrame, val: DataFrame) -> Fitted:
    return _tune("text", ["t_jaccard", "t_inside", "t_length", "t_text"], train, val, [1.0], [False])


FEATURIZE = {"logistic": logistic_features, "distance": lambda p: distance_features(p)[0], "text": text_features}
FITS = {"logistic": fit_logistic, "distance": fit_distance, "text": fit_text}


def compare(train: DataFrame, val: DataFrame, test: DataFrame, strategies: tuple[str, ...] = ("B1", "B2"), models: tuple[str, ...] = tuple(FITS), fitted: dict | None = None) -> list[dict]:
    """One row per strategy and model: blocking quality, whole-test and candidate quality, threshold, seconds of an action.

    ``fitted`` has models that are fitted or loaded already; the others are fitted.
    """
    fitted = {m: (fitted or {}).get(m) or FITS[m](train, val) for m in models}
    rows = []
    for s in strategies:
        stats = blocking_stats(test, s).first().asDict()
        candidates = block(test, s).persist()
        for m in models:
            began = time.perf_counter()
            scored = fitted[m].score(candidates).persist()
            scored.count()
            took = time.perf_counter() - began
            near = confusion(scored).first()
            whole = confusion(global_predictions(test, scored, ["label"])).first()
            rows.append(stats | {"model": m} | {k: whole[k] for k in ("tp", "fp", "fn", "tn")} | {f"{k}_global": whole[k] for k in ("precision", "recall", "f1")} | {f"{k}_candidates": near[k] for k in ("precision", "recall", "f1")} | {"threshold_used": fitted[m].threshold, "inference_time_sec": round(took, 6)})
            scored.unpersist()
        candidates.unpersist()
    return rows
