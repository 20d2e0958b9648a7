"""A deterministic order by hash, without a single task that sees all rows.

The order is that of ``md5(seed|key...)``. Its first four digits are a bucket: bucket counts
(at most 65,536 per group) give each bucket's offset, and rows are ranked inside buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def with_rank(df: DataFrame, keys: list[str], seed: int = 42, groups: list[str] | None = None) -> DataFrame:
    """``df`` with ``_rank``: 1, 2, ... in hash order within ``groups`` (null groups form one), and ``_n``, the group's size."""
    groups = groups or []
    marked = df.withColumn("_hash", hash_key(seed, *keys)).withColumn("_bucket", F.substring("_hash", 1, 4))
    sizes = marked.groupBy(*groups, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = sizes.withColumns({"_offset": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_n": F.sum("_size").over(whole)}).drop("_size")
    offsets = offsets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_b"), "_offset", "_n")
    on = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy("_hash", *keys)
    ranked = marked.withColumn("_in", F.row_number().over(inside)).join(offsets, on)
    return ranked.withColumn("_rank", F.col("_offset") + F.col("_in")).drop("_hash", "_bucket", "_in", "_b", "_offset", *[f"_g{i}" for i in range(len(groups))])


def take(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """The first ``n`` rows in hash order: a sample without replacement."""
    return with_rank(df, keys, seed).where(F.col("_rank") <= n).drop("_rank", "_n")


def stratified_split(df: DataFrame, keys: list[str], label: str = "label", train: float = 0.7, val: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: exact shares of each label, rounded down for train and for train + val."""
    r = with_rank(df, keys, seed, [label])
    cut = lambda share: F.floor(F.lit(round(share * 1000)) * F.col("_n") / 1000)
    split = F.when(F.col("_rank") <= cut(train), "train").when(F.col("_rank") <= cut(train + val), "val").otherwise("test")
    return r.withColumn("split", split).drop("_rank", "_n")
