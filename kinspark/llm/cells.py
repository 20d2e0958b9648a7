"""Hot keys: rows of a key that too many share are dealt to cells in which every pair still meets once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS_TO_DRIVER = 100_000


def spread(rows: DataFrame, key: str, by: str, most: int, keys: DataFrame | None = None, scale: int = 1) -> DataFrame:
    """``rows`` with ``key`` replaced by the number of a cell, and ``part``.

    A key with up to ``most`` rows is one cell, part 0. A larger one is cut into parts by the
    hash of ``by``; each pair of parts is a cell (parts -1 and 1: only rows of different parts
    are to meet) and each part one of its own (part 0). Every pair of rows with different
    ``by`` so meets in exactly one cell, and no cell has more than about twice ``most`` rows.
    The hot keys are sent along with the tasks up to ``KEYS_TO_DRIVER`` of them, else joined.
    ``keys`` (key, once for each row) may be given where they are cheaper to count than ``rows``,
    without keys that certainly aren't hot, or those of one row in ``scale``: sizes are then
    estimates, on which nothing depends but how large the cells are.
    """
    n = F.count("*") * scale
    hot = (rows if keys is None else keys).groupBy(key).agg(n.alias("_n")).where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    some = hot.limit(KEYS_TO_DRIVER + 1).collect()
    if not some:
        return rows.withColumn("part", F.lit(0))
    if len(some) <= KEYS_TO_DRIVER:
        hot = F.broadcast(rows.sparkSession.createDataFrame(some, hot.schema))
    parts, part, other = F.col("_parts"), F.col("_part"), F.col("_other")
    marked = rows.join(hot, key, "left").withColumn("_part", F.when(parts.isNotNull(), F.pmod(F.xxhash64(by), parts).cast("int")))
    dealt = marked.withColumn("_other", F.explode(F.when(parts.isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), parts - 1))))
    cell = F.when(parts.isNull(), F.col(key)).otherwise(F.xxhash64(F.col(key), F.least(part, other), F.greatest(part, other)))
    role = F.when(parts.isNull() | (part == other), 0).when(part < other, 1).otherwise(-1)
    return dealt.withColumns({key: cell, "part": role}).drop("_n", "_parts", "_part", "_other")


def across(rows: DataFrame, key: str, by: str, most: tuple[int, int], some: DataFrame, scale: int = 1) -> DataFrame:
    """``rows`` of two sides (``side`` 0 and 1) with ``key`` replaced by the number of a cell: each two rows of a key and different sides meet in exactly one.

    A key with more than ``most`` rows of a side is cut into parts on that side, by the hash of ``by``; each two
    parts of different sides are a cell. ``some`` (key, side): the rows' keys, those of one row in ``scale``.
    """
    parts = [F.greatest(F.ceil(F.count_if(F.col("side") == s) * scale / F.lit(m)), F.lit(1)).cast("int").alias(f"_parts{s}") for s, m in enumerate(most)]
    hot = some.groupBy(key).agg(*parts).where("_parts0 > 1 or _parts1 > 1")
    few = hot.limit(KEYS_TO_DRIVER + 1).collect()
    if not few:
        return rows
    if len(few) <= KEYS_TO_DRIVER:
        hot = F.broadcast(rows.sparkSession.createDataFrame(few, hot.schema))
    first, cold = F.col("side") == 0, F.col("_parts0").isNull()
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    marked = rows.join(hot, key, "left").withColumn("_own", F.pmod(F.xxhash64(by), pick("_parts0", "_parts1")).cast("int"))
    dealt = marked.withColumn("_other", F.explode(F.when(cold, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), pick("_parts1", "_parts0") - 1))))
    cell = F.when(cold, F.col(key)).otherwise(F.xxhash64(F.col(key), pick("_own", "_other"), pick("_other", "_own")))
    return dealt.withColumn(key, cell).drop("_parts0", "_parts1", "_own", "_other")
