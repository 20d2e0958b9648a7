"""Records and pairs as text for language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Order of the fields in a serialised record (fixed values).
FIELDS = [
    "manufacturer", "year", "model", "mileage", "price", "main_color", "transmission", "traction", "body_type", "fuel_type",
    "cylinders", "latitude", "longitude", "description", "location", "pubblication_date",
]


def _as_text(df: DataFrame, c: str) -> Column:
    """Numbers are written in full, never with an exponent: at least one and at most eight decimals."""
    kind = dict(df.dtypes)[c]
    if kind not in ("double", "float"):
        return F.col(c).cast("string")
    fixed = F.regexp_replace(F.format_string("%.8f", F.col(c).cast("double")), r"0+$", "")
    return F.when(F.col(c).isNotNull() & ~F.isnan(c), F.when(fixed.endswith("."), F.concat(fixed, F.lit("0"))).otherwise(fixed))


def serialized(df: DataFrame, suffix: str) -> Column:
    """``COL field VAL value`` of the filled fields, in order; tabs and line ends become blanks."""
    parts = []
    for f in FIELDS:
        c = f"{f}{suffix}"
        if c in df.columns:
            v = strip(_as_text(df, c))
            parts.append(F.when((v != "") & (F.lower(v) != "nan"), F.concat(F.lit(f"COL {f} VAL "), F.translate(v, "\t\n\r", "   "))))
    return F.concat_ws(" ", *parts)


def pair_lines(pairs: DataFrame, label: str = "label") -> DataFrame:
    """value: left, right and label between tabs; a label other than 0 and 1 is 0."""
    y = F.coalesce(F.col(label).cast("string"), F.lit("0")) if label in pairs.columns else F.lit("0")
    y = F.when(y.isin("0", "1"), y).otherwise("0")
    return pairs.select(F.concat_ws("\t", serialized(pairs, "_A"), serialized(pairs, "_B"), y).alias("value"))
