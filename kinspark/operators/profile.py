"""Profiles of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _percent(hits, total):
    return F.coalesce(F.try_divide(hits * 100.0, total), F.lit(0.0))


def null_percents(df: DataFrame) -> DataFrame:
    """attribute, missing_pct: one row per column; 0 for an empty table."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns], F.count("*").alias("_n"))
    return one.select(F.expr("stack({}, {}) as (attribute, missing, n)".format(len(df.columns), ", ".join(f"'{c}', `{c}`, _n" for c in df.columns)))).select("attribute", F.round(_percent(F.col("missing"), F.col("n")), 6).alias("missing_pct"))


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """attribute, missing_pct, unique_pct (nulls not counted, of all rows), data_type.

    Each column is read and counted by itself: its values are grouped before the shuffle,
    and no row is copied for other columns. ``approximate`` counts all columns in one pass
    by sketches, in constant memory per column.
    """
    if approximate:
        aggs = [x for c in df.columns for x in (F.count_if(F.col(c).isNull()).alias(f"m_{c}"), F.approx_count_distinct(c).alias(f"d_{c}"))]
        one = df.agg(*aggs, F.count("*").alias("_n"))
        rows = ", ".join(f"'{c}', m_{c}, d_{c}, _n, '{t}'" for c, t in df.dtypes)
        long = one.select(F.expr(f"stack({len(df.columns)}, {rows}) as (attribute, m, d, n, data_type)"))
    else:
        parts = []
        for c, kind in df.dtypes:
            held = df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("k"))
            parts.append(held.agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("m"), F.count("v").alias("d"), F.coalesce(F.sum("k"), F.lit(0)).alias("n")).select(F.lit(c).alias("attribute"), "m", "d", "n", F.lit(kind).alias("data_type")))
        long = reduce(DataFrame.unionAll, parts)
    return long.select("attribute", F.round(_percent(F.col("m"), F.col("n")), 6).alias("missing_pct"), F.round(_percent(F.col("d"), F.col("n")), 6).alias("unique_pct"), "data_type")


QUARTERS = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """attribute, q25, q50, q75 of numeric columns, exact, with linear interpolation.

    Equal values are counted first. Counts per bucket (a step of the logarithm; some 100,000
    at most) tell in which buckets the wanted ranks lie, and only the values of those are put
    in order.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("double").alias("v")) for c in columns]))
    counts = df.select(pairs.alias("x")).select("x.*").where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("attribute", "v").agg(F.count("*").alias("k"))
    counts = counts.withColumn("b", F.signum("v") * F.floor(F.log2(F.abs("v") + 1) * 64))
    upto = Window.partitionBy("attribute").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = counts.groupBy("attribute", "b").agg(F.sum("k").alias("kb")).withColumns({"end": F.sum("kb").over(upto), "n": F.sum("kb").over(Window.partitionBy("attribute"))})
    spot = lambda q: F.lit(q) * (F.col("n") - 1)  # noqa: E731  rank from 0, with a fraction
    ranks = F.explode(F.array(*[f(spot(q)).cast("bigint") for q in QUARTERS.values() for f in (F.floor, F.ceil)])).alias("r")
    wanted = buckets.select("attribute", "b", "n", (F.col("end") - F.col("kb")).alias("begin"), "end", ranks).where("r >= begin and r < end").select("attribute", "b", "n", "begin", "r").distinct()
    inside = Window.partitionBy("attribute", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    near = counts.join(wanted.select("attribute", "b").distinct(), ["attribute", "b"], "left_semi").withColumn("upto", F.sum("k").over(inside))
    found = near.join(wanted, ["attribute", "b"]).where("r < begin + upto and r >= begin + upto - k").select("attribute", "n", "r", "v")
    at = lambda f, q: F.max(F.when(F.col("r") == f(spot(q)).cast("bigint"), F.col("v")))
    low_high = [x for name, q in QUARTERS.items() for x in (at(F.floor, q).alias(f"{name}_l"), at(F.ceil, q).alias(f"{name}_h"))]
    got = found.groupBy("attribute", "n").agg(*low_high)
    part = lambda q: spot(q) - F.floor(spot(q))
    return got.select("attribute", *[(F.col(f"{x}_l") + (F.col(f"{x}_h") - F.col(f"{x}_l")) * part(q)).alias(x) for x, q in QUARTERS.items()])


def describe(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """attribute, n, mean, std, min, q25, q50, q75, max of numeric columns; quartiles interpolate linearly unless approximate."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if approximate:
        stats |= {name: lambda c, q=q: F.percentile_approx(c, q) for name, q in QUARTERS.items()}
    one = df.agg(*[f(c).cast("double").alias(f"{s}_{c}") for c in columns for s, f in stats.items()])
    rows = ", ".join(f"'{c}', " + ", ".join(f"{s}_{c}" for s in stats) for c in columns)
    out = one.select(F.expr(f"stack({len(columns)}, {rows}) as (attribute, {', '.join(stats)})"))
    if not approximate:
        out = out.join(_quartiles(df, columns), "attribute", "left")
    return out.select("attribute", "n", "mean", "std", "min", *QUARTERS, "max")


def schema_info(df: DataFrame) -> DataFrame:
    """attribute, non_null, n_rows, data_type of each column."""
    one = df.agg(*[F.count(c).alias(c) for c in df.columns], F.count("*").alias("_n"))
    rows = ", ".join(f"'{c}', `{c}`, _n, '{t}'" for c, t in df.dtypes)
    return one.select(F.expr(f"stack({len(df.columns)}, {rows}) as (attribute, non_null, n_rows, data_type)"))


def missing_patterns(df: DataFrame) -> DataFrame:
    """The data behind a missingness plot: every combination of missing columns (as a text of 0 and 1) with its number of rows."""
    return df.select(F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in df.columns]).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n_rows"))


def drop_mostly_missing(df: DataFrame, most: float = 70.0) -> DataFrame:
    """Without the columns of which more than ``most`` per cent are null; exactly that share stays."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if (one[c] or 0.0) * 100 > most])


def drop_incomplete(df: DataFrame, critical: list[str]) -> DataFrame:
    """Without the rows that lack any critical value."""
    return df.na.drop(how="any", subset=critical)


def dropped_counts(before: DataFrame, critical: list[str]) -> DataFrame:
    """attribute, n_missing (rows that lack it), and for ``(any)`` those that ``drop_incomplete`` drops."""
    lacks = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in critical])
    one = before.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in critical], F.count_if(lacks).alias("_any"))
    rows = ", ".join([*(f"'{c}', `{c}`" for c in critical), "'(any)', _any"])
    return one.select(F.expr(f"stack({len(critical) + 1}, {rows}) as (attribute, n_missing)"))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n_rows"))
