"""Two sources to one mediated schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import MEDIATED
from .profile import drop_incomplete, drop_mostly_missing

# Names of the columns of both sources in the mediated schema, and what is dropped or must be filled.
FIRST_NAMES = {
    "id": "id_source_vehicles", "region": "location", "fuel": "fuel_type", "odometer": "mileage", "VIN": "vin", "drive": "traction",
    "type": "body_type", "paint_color": "main_color", "title_status": "status", "lat": "latitude", "long": "longitude", "posting_date": "pubblication_date",
}
SECOND_NAMES = {
    "id": "id_source_used_cars", "city": "location", "make_name": "manufacturer", "model_name": "model", "engine_cylinders": "cylinders",
    "wheel_system": "traction", "listing_color": "main_color", "theft_title": "theft_status", "listed_date": "pubblication_date",
}
FIRST_DROPPED = ["url", "region_url", "image_url"]
SECOND_DROPPED = ["engine_type", "listing_id", "main_picture_url", "sp_id"]
FIRST_CRITICAL = ["manufacturer", "model", "year", "odometer", "fuel"]
SECOND_CRITICAL = ["make_name", "model_name", "year", "mileage", "fuel_type"]
FIRST_NUMBERS = ["price", "year", "odometer", "lat", "long"]
SECOND_NUMBERS = ["price", "year", "mileage", "latitude", "longitude"]
TEXT_COLUMNS = ["manufacturer", "model", "cylinders", "fuel_type", "transmission", "traction", "body_type", "main_color", "location"]
NUMBER_COLUMNS = ["year", "price", "mileage"]


def with_row_id(df: DataFrame, order: list[str], prefix: str = "S2_", name: str = "id") -> DataFrame:
    """Dense ids ``prefix0``, ``prefix1``, ... in the order of the given columns, without a single task that sees all rows.

    Rows are range-partitioned by the order; each partition's size gives the offset of the next.
    """
    spread = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    kept = spread.withColumns({"_at": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    sizes = kept.groupBy("_at").agg(F.count("*").alias("_size"), F.min("_id").alias("_first"))
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).select("_at", "_first", "_offset")
    return kept.join(F.broadcast(offsets), "_at").withColumn(name, F.concat(F.lit(prefix), F.col("_offset") + F.col("_id") - F.col("_first"))).drop("_at", "_id", "_size", "_first", "_offset")


def clean_first(df: DataFrame, most_missing: float = 70.0) -> DataFrame:
    """The first source without mostly missing columns and incomplete rows."""
    kept = drop_mostly_missing(df, most_missing)
    return drop_incomplete(kept, [c for c in FIRST_CRITICAL if c in kept.columns])


def clean_second(df: DataFrame, order: list[str], most_missing: float = 70.0) -> DataFrame:
    """The second source likewise; ids are given before any row goes."""
    kept = drop_mostly_missing(with_row_id(df.drop("sp_id"), order), most_missing)
    return drop_incomplete(kept, [c for c in SECOND_CRITICAL if c in kept.columns])


def whole_number_id(c: str) -> F.Column:
    """An id that went through a float as its whole number; null if it isn't one."""
    return text.to_number(F.col(c)).try_cast("bigint").cast("string")


def normalize(df: DataFrame) -> DataFrame:
    """Text, description and number columns in their cleaned forms; absent columns are skipped."""
    done = {c: text.clean_text(F.col(c)) for c in TEXT_COLUMNS if c in df.columns}
    if "description" in df.columns:
        done["description"] = text.clean_description(F.col("description"))
    done |= {c: text.to_number(F.col(c)) for c in NUMBER_COLUMNS if c in df.columns}
    return df.withColumns(done)


def unify_values(df: DataFrame) -> DataFrame:
    """One wording for gears and fuel."""
    maps = {"transmission": text.TRANSMISSION, "fuel_type": text.FUEL}
    return df.withColumns({c: text.mapped(F.col(c), m) for c, m in maps.items() if c in df.columns})


def mediate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sources under the mediated schema, normalised; columns that a source lacks are null."""
    a = first.drop(*FIRST_DROPPED).withColumnsRenamed(FIRST_NAMES)
    b = second.drop(*SECOND_DROPPED).withColumnsRenamed(SECOND_NAMES)
    if "id_source_vehicles" in a.columns:
        a = a.withColumn("id_source_vehicles", whole_number_id("id_source_vehicles"))
    both = a.unionByName(b, allowMissingColumns=True)
    return unify_values(normalize(both.select(*[c for c in MEDIATED if c in both.columns])))


def ordered_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of ``columns`` that ``df`` has, in that order."""
    return df.select(*[c for c in columns if c in df.columns])
