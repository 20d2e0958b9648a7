"""Quality of decisions: confusion counts, precision, recall, F1, best threshold, whole-test predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 0.10 to 0.95 in steps of 0.05, exact.
THRESHOLDS = [k / 100 for k in range(10, 100, 5)]


def pair_key(a: str = "id_A", b: str = "id_B") -> tuple[Column, Column]:
    """The ends of a pair in canonical order."""
    return F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")


def confusion_columns(label: str, pred: str) -> list[Column]:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return [F.count_if(y & p).alias("tp"), F.count_if((F.col(label) == 0) & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if((F.col(label) == 0) & ~p).alias("tn")]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def with_scores(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Adds precision, recall and F1 to tp, fp and fn; shares of nothing are 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": F.round(_ratio(tp, tp + fp), digits), "recall": F.round(_ratio(tp, tp + fn), digits), "f1": F.round(_ratio(2 * tp, 2 * tp + fp + fn), digits)})


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return with_scores(df.agg(*confusion_columns(label, pred)))


def threshold_sweep(scores: DataFrame, label: str = "label", prob: str = "prob", thresholds: list[float] | None = None, by: list[str] | None = None) -> DataFrame:
    """threshold, tp, fp, fn, tn, precision, recall, f1 (for each ``by``): all thresholds from one pass over the scores.

    Scores are counted per label and step of the grid first; the sums over steps are tiny.
    """
    grid, by = sorted(thresholds or THRESHOLDS), by or []
    step = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= F.col("_p")))
    counted = scores.select(*by, F.col(label).alias("_y"), F.col(prob).alias("_p")).where("_y is not null and _p is not null").select(*by, "_y", step.alias("_s")).groupBy(*by, "_s").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg"))
    at = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("_k"), F.lit(t).alias("threshold")) for k, t in enumerate(grid)])).alias("g")
    spread = counted.select("*", at).select(*by, "_s", "pos", "neg", "g._k", "g.threshold")
    over = F.col("_s") >= F.col("_k")
    sums = spread.groupBy(*by, "threshold").agg(F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(over, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.when(over, 0).otherwise(F.col("neg"))).alias("tn"))
    return with_scores(sums)


def best_threshold(scores: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """threshold, f1: the largest F1, of several the lowest threshold."""
    swept = threshold_sweep(scores, label, prob).withColumn("_f", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return swept.orderBy(F.desc("_f"), "threshold").limit(1).select("threshold", "f1")


def global_predictions(truth: DataFrame, candidates: DataFrame, order: list[str]) -> DataFrame:
    """lo, hi, label, pred of every true pair; those that aren't candidates are predicted 0.

    Either order of a pair is the same pair. Of several rows of a pair the last by ``order`` counts.
    """
    last = F.struct(*order)
    t = truth.select(*pair_key(), "label", *order).where("lo is not null and hi is not null").groupBy("lo", "hi").agg(F.max_by("label", last).alias("label"))
    c = candidates.select(*pair_key(), "pred", *[x for x in order if x != "pred"]).where("lo is not null and hi is not null").groupBy("lo", "hi").agg(F.max_by("pred", last).alias("pred"))
    return t.join(c, ["lo", "hi"], "left").withColumn("pred", F.coalesce("pred", F.lit(0)))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
