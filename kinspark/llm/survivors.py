"""Problem 7: one surviving record per duplicate group, field by field.

One aggregation per key. For each attribute it takes the maximum of a composite struct
(value usable, source priority, moment, value, record); the fields of the winning structs
make the survivor, and their records tell how many fields each record gave. The record ids
that are latest and that are fullest come from the same aggregation, each with a second
maximum that prefers the opposite id, which differs exactly if the first place is shared.
Maxima are combined before the shuffle, so a key with a third of all rows sends one row per
task.

Nulls never win over values; ties go to the larger value, then the larger id, so repeated
rows change nothing; unreadable moments are the earliest; rows without key or id are left
out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEVER = -(1 << 62)


def survivors(records: DataFrame, key: str, rec_id: str, moment: str, usable: Mapping[str, Column], priority: Column) -> DataFrame:
    """key, ``several`` (more than one record), the surviving attributes, ``latest``/``fullest`` ids and whether each stands alone, ``n_latest`` and ``n_fullest`` (fields of the survivor that came from them) and ``n_full`` (fields that the fullest has).

    ``usable`` has, for each attribute, the condition under which its value counts;
    ``priority`` ranks the record's source (higher wins); fullness is the number of usable values.
    """
    full = sum((F.when(ok, 1).otherwise(0) for ok in usable.values()), F.lit(0))
    r = records.where(F.col(key).isNotNull() & F.col(rec_id).isNotNull()).withColumns({"_at": F.coalesce(F.col(moment), F.lit(NEVER)), "_rank": priority, "_full": full})
    best = [F.max(F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), "_rank", "_at", F.when(ok, F.col(a)).alias("v"), F.col(rec_id).alias("id"))).alias(f"_{a}") for a, ok in usable.items()]
    edge = []
    for what, by in (("latest", "_at"), ("fullest", "_full")):
        edge += [F.max(F.struct(by, F.col(rec_id).alias("id"))).alias(f"_{what}"), F.min(F.struct((-F.col(by)).alias("by"), F.col(rec_id).alias("id"))).alias(f"_{what}2")]
    out = r.groupBy(key).agg(F.min(rec_id).alias("_a"), F.max(rec_id).alias("_b"), *best, *edge)
    given = lambda w: sum((F.when(F.col(f"_{a}.ok") & (F.col(f"_{a}.id") == F.col(f"_{w}.id")), 1).otherwise(0) for a in usable), F.lit(0))
    return out.select(
        key, (F.col("_a") != F.col("_b")).alias("several"), *[F.col(f"_{a}.v").alias(a) for a in usable],
        *[c for w in ("latest", "fullest") for c in (F.col(f"_{w}.id").alias(w), (F.col(f"_{w}.id") == F.col(f"_{w}2.id")).alias(f"{w}_alone"), given(w).alias(f"n_{w}"))], F.col("_fullest._full").alias("n_full"),
    )
