"""Pruning of candidate pairs: two strategies, and the quality of what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler
from ..functions.text import compare_form, prefix3, year_form

MAKE_THRESHOLD, MODEL_THRESHOLD = 0.95, 0.85


def _side(df: DataFrame, name: str, s: str) -> Column:
    return F.col(f"{name}_{s}") if f"{name}_{s}" in df.columns else F.lit(None).cast("string")


def _forms(df: DataFrame, name: str, form) -> tuple[Column, Column]:
    return form(_side(df, name, "A")), form(_side(df, name, "B"))


def block_b1(pairs: DataFrame, make: float = MAKE_THRESHOLD) -> DataFrame:
    """Equal filled year, equal make prefix, similar make. Cheap terms filter before the Python function sees a row."""
    ya, yb = _forms(pairs, "year", year_form)
    ma, mb = _forms(pairs, "manufacturer", compare_form)
    cheap = pairs.where((ya != "") & (ya == yb) & (prefix3(ma) == prefix3(mb)))
    return cheap.where(jaro_winkler(ma, mb) >= make)


def block_b2(pairs: DataFrame, make: float = MAKE_THRESHOLD, model: float = MODEL_THRESHOLD) -> DataFrame:
    """As B1, and equal model prefix, similar model, equal fuel (both missing counts as equal)."""
    oa, ob = _forms(pairs, "model", compare_form)
    fa, fb = _forms(pairs, "fuel_type", compare_form)
    cheap = pairs.where((prefix3(oa) == prefix3(ob)) & (fa == fb))
    return block_b1(cheap, make).where(jaro_winkler(oa, ob) >= model)


STRATEGIES = {"B1": block_b1, "B2": block_b2}


def block(pairs: DataFrame, strategy: str) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known are {sorted(STRATEGIES)}")
    return STRATEGIES[strategy](pairs)


def block_records(records: DataFrame, make: float = MAKE_THRESHOLD) -> DataFrame:
    """id_A, id_B: pairs of records that B1 keeps, formed by a join on year and make prefix.

    The pairs of distinct (year, make) values are judged once; records join to them.
    """
    r = records.select("rec_id", year_form(F.col("year")).alias("y"), compare_form(F.col("manufacturer")).alias("m")).where("y <> ''").distinct()
    kinds = r.select("y", "m", prefix3(F.col("m")).alias("p")).distinct()
    a, b = kinds.select("y", "p", F.col("m").alias("ma")), kinds.select("y", "p", F.col("m").alias("mb"))
    similar = a.join(b, ["y", "p"]).where(jaro_winkler("ma", "mb") >= make).select("y", "ma", "mb")
    left = r.select(F.col("rec_id").alias("id_A"), "y", F.col("m").alias("ma"))
    right = r.select(F.col("rec_id").alias("id_B"), "y", F.col("m").alias("mb"))
    return left.join(similar, ["y", "ma"]).join(right, ["y", "mb"]).where("id_A < id_B").select("id_A", "id_B")


def blocking_stats(pairs: DataFrame, strategy: str) -> DataFrame:
    """One row: positives, captured positives, recall, pairs, candidates, reduction ratio; shares of nothing are 0."""
    kept = block(pairs, strategy).agg(F.sum("label").alias("c"), F.count("*").alias("k"))
    all_ = pairs.agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    one = all_.withColumn("_", F.lit(1)).join(kept.withColumn("_", F.lit(1)), "_")
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return one.select(
        F.lit(strategy).alias("strategy"), z("t").alias("positives_in_test"), z("c").alias("positives_captured"), F.round(share(z("c"), z("t")), 6).alias("blocking_recall"),
        F.col("n").alias("n_test_pairs"), F.col("k").alias("n_candidates"), F.round(F.when(F.col("n") > 0, 1 - F.col("k") / F.col("n")).otherwise(0.0), 6).alias("reduction_ratio_vs_test"),
    )
