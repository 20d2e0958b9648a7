"""Catalog of the tables in one folder, and the projections that all queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 16 attributes that a labelled pair carries of each record (fixed order).
PAIR_ATTRIBUTES = [
    "location", "price", "year", "manufacturer", "model", "cylinders", "fuel_type", "mileage", "transmission",
    "traction", "body_type", "main_color", "description", "latitude", "longitude", "pubblication_date",
]

#: The mediated schema (fixed order).
MEDIATED = [
    "id_source_vehicles", "id_source_used_cars", "location", "price", "year", "manufacturer", "model", "cylinders",
    "fuel_type", "mileage", "transmission", "vin", "traction", "body_type", "main_color", "description", "latitude",
    "longitude", "pubblication_date",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rec_id() -> Column:
    """The one id of a mediated record; null only if both ids are."""
    return F.coalesce(F.col("id_source_vehicles"), F.col("id_source_used_cars"))


def records(spark: SparkSession, sf_dir: str, *columns: str, name: str = "mediated_schema_normalized") -> DataFrame:
    """``rec_id`` and the named columns of each listing; rows without an id are left out."""
    return table(spark, sf_dir, name).select(rec_id().alias("rec_id"), *columns).where(F.col("rec_id").isNotNull())
