"""Labelled pairs from a checked key: cleaning, leaders, positives, negatives, splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vin as V
from ..functions.text import strip
from ..functions.timestamps import with_utc_second
from ..sources.tables import MEDIATED, PAIR_ATTRIBUTES, rec_id
from .hash_order import stratified_split, take, with_rank
from .stage import Stage

#: Attributes that leaders are compared by.
COMPARED = [c for c in MEDIATED if c not in ("vin", "pubblication_date", "id_source_vehicles", "id_source_used_cars", "description")]


def legal_vins(df: DataFrame, vin: str = "vin") -> DataFrame:
    """Rows with a legal number that is no placeholder and has a right check digit; the number is normalised."""
    n = df.where(F.col(vin).isNotNull()).withColumn(vin, V.normalized(F.col(vin)))
    return n.where(V.is_legal(F.col(vin)) & ~V.is_placeholder(F.col(vin)) & V.check_digit_ok(F.col(vin)))


def _leaders(key: int, compared: list[int], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders, codes = None, np.empty((0, len(compared)), np.int64), {}
        count = 0
        for b in batches:
            keep = []
            columns = [b.column(i).to_pylist() for i in compared]
            for k, *values in zip(b.column(key).to_pylist(), *columns):
                if k != now:
                    now, count, codes = k, 0, {}
                row = np.fromiter((codes.setdefault(v, len(codes)) for v in enumerate(values)), np.int64, len(values))
                lead = not count or int((leaders[:count] != row).sum(axis=1).min()) > most
                if lead:
                    if count == len(leaders):
                        leaders = np.concatenate([leaders, np.empty((max(16, count), len(compared)), np.int64)])
                    leaders[count] = row
                    count += 1
                keep.append(lead)
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def leaders(df: DataFrame, key: str = "vin", moment: str = "utc_second", tie: str = "rec_id", compared: list[str] | None = None, most: int = 3) -> DataFrame:
    """Of each key the leaders, latest first (unknown moments last, ties by ``tie``).

    A row is a leader unless an earlier one differs from it in at most ``most`` of the
    compared attributes; null equals null only. Of rows that are equal in all of them only
    the first can be a leader, so the others go before the shuffle, in partial aggregates: a
    key with a third of all rows sends its different rows only. These stream through in
    order, and only the leaders of the current key are held.
    """
    names = compared or [c for c in COMPARED if c in df.columns]
    rest = [c for c in df.columns if c not in (key, *names)]
    first = F.struct(F.col(moment).isNull().alias("_none"), (-F.col(moment)).alias("_late"), F.col(tie).alias("_tie"), *[F.col(c) for c in rest])
    alike = df.groupBy(key, *names).agg(F.min(first).alias("_first"))
    different = alike.select(*[F.col(c) if c in (key, *names) else F.col(f"_first.{c}").alias(c) for c in df.columns])
    order = different.repartition(key).sortWithinPartitions(key, F.col(moment).desc_nulls_last(), tie)
    at = {c: i for i, c in enumerate(df.columns)}
    return order.mapInArrow(_leaders(at[key], [at[c] for c in names], most), df.schema)


def clean_by_vin(mediated: DataFrame, most: int = 3) -> DataFrame:
    """rec_id and the mediated columns of the leaders among the rows with legal numbers; repeated rows count once."""
    legal = legal_vins(mediated).distinct().withColumn("rec_id", rec_id()).where(F.col("rec_id").isNotNull())
    dated = with_utc_second(legal, "pubblication_date", None)
    return leaders(dated, most=most).drop("utc_second")


def positive_pairs(records: DataFrame, key: str = "vin", id_col: str = "rec_id") -> DataFrame:
    """id_A, id_B, label 1: all pairs of different records with one key, the smaller id first."""
    r = records.where(F.col(key).isNotNull()).select(F.col(id_col).alias("i"), F.col(key).alias("k")).distinct()
    a, b = r.alias("a"), r.alias("b")
    met = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.i") < F.col("b.i")))
    return met.select(F.col("a.i").alias("id_A"), F.col("b.i").alias("id_B"), F.lit(1).alias("label"))


def _grouped(records: DataFrame) -> DataFrame:
    """id, key and the group fields with their defaults."""
    low = lambda c: F.lower(strip(F.coalesce(F.col(c), F.lit("unknown"))))
    return records.select("rec_id", "vin", low("manufacturer").alias("mfr"), F.coalesce(F.col("year").try_cast("int"), F.lit(0)).alias("yr"), low("body_type").alias("body")).distinct()


def negative_candidates(records: DataFrame, fields: list[str], seed: int = 42, most: int = 50) -> DataFrame:
    """id_A, id_B: pairs with equal ``fields`` and different keys.

    Groups of up to ``most`` records give all their pairs. A larger group is sampled: its
    records stand in a circle in hash order, and each is paired with the ``most / 2`` that
    follow, so every record of it can be drawn and the pairs grow in proportion to it.
    """
    ranked = with_rank(_grouped(records).select("rec_id", "vin", *fields).distinct(), ["rec_id", "vin"], seed, fields)
    r = Stage(records.sparkSession).put(ranked.select("rec_id", "vin", *fields, (F.col("_rank") - 1).alias("p"), F.col("_n").alias("n")), "ranked")
    small, large = r.where(F.col("n") <= most), r.where(F.col("n") > most)
    other = lambda d: d.select(*fields, F.col("rec_id").alias("rec_2"), F.col("vin").alias("vin_2"), F.col("p").alias("q"))
    whole = small.join(other(small), fields).where("p < q")
    steps = F.explode(F.sequence(F.lit(1), F.lit(most // 2))).alias("k")
    drawn = large.select("rec_id", "vin", *fields, "p", "n", steps).withColumn("q", (F.col("p") + F.col("k")) % F.col("n")).join(other(large), [*fields, "q"])
    pairs = whole.select("rec_id", "vin", "rec_2", "vin_2").unionByName(drawn.select("rec_id", "vin", "rec_2", "vin_2"))
    pairs = pairs.where((F.col("vin") != F.col("vin_2")) & (F.col("rec_id") != F.col("rec_2")))
    return pairs.select(F.least("rec_id", "rec_2").alias("id_A"), F.greatest("rec_id", "rec_2").alias("id_B")).distinct()


def negative_pairs(records: DataFrame, positives: DataFrame, target: int, seed: int = 42, most: int = 50) -> DataFrame:
    """id_A, id_B, stratum, label 0: 70 % of ``target`` with equal make, year and body, 30 % with equal make and year."""
    hard = negative_candidates(records, ["mfr", "yr", "body"], seed, most).join(positives.select("id_A", "id_B"), ["id_A", "id_B"], "left_anti")
    hard = take(hard, target * 70 // 100, ["id_A", "id_B"], seed).withColumn("stratum", F.lit("hard"))
    medium = negative_candidates(records, ["mfr", "yr"], seed, most).join(positives.select("id_A", "id_B"), ["id_A", "id_B"], "left_anti")
    medium = medium.join(hard.select("id_A", "id_B"), ["id_A", "id_B"], "left_anti")
    medium = take(medium, target * 30 // 100, ["id_A", "id_B"], seed).withColumn("stratum", F.lit("medium"))
    return hard.unionByName(medium).withColumn("label", F.lit(0))


def stratum_shares(negatives: DataFrame) -> DataFrame:
    """stratum, n_pairs, pct; no rows for no negatives."""
    n = negatives.groupBy("stratum").agg(F.count("*").alias("n_pairs"))
    return n.withColumn("pct", F.round(F.try_divide(F.col("n_pairs") * 100.0, F.sum("n_pairs").over(Window.partitionBy(F.lit(1)))), 6))


def with_attributes(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The pairs with the attributes of both ends; a pair whose end is unknown goes. Of several rows of a record the smallest, field by field from the left, counts."""
    one = F.min(F.struct(*PAIR_ATTRIBUTES)).alias("_r")
    r = records.groupBy("rec_id").agg(one).select("rec_id", "_r.*")
    side = lambda s: r.select(F.col("rec_id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in PAIR_ATTRIBUTES])
    out = pairs.join(side("A"), "id_A").join(side("B"), "id_B")
    return out.select("id_A", *[f"{c}_A" for c in PAIR_ATTRIBUTES], "id_B", *[f"{c}_B" for c in PAIR_ATTRIBUTES], "label")


def ground_truth(records: DataFrame, negatives_per_positive: float = 2.0, seed: int = 42) -> DataFrame:
    """Labelled pairs with attributes of both ends: all positives and their quota of negatives."""
    pos = positive_pairs(records)
    target = int(pos.count() * negatives_per_positive)
    neg = negative_pairs(records, pos, target, seed)
    return with_attributes(pos.unionByName(neg.select("id_A", "id_B", "label")), records)


def split(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """``pairs`` with ``split``: 70, 10 and 20 % of each label."""
    return stratified_split(pairs, ["id_A", "id_B"], seed=seed)
