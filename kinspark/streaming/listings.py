"""Listings as they arrive: the batch normalisation on a stream, each listing once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mediate import normalize, unify_values
from ..sources.tables import rec_id


def read_listings(spark: SparkSession, folder: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def arriving(listings: DataFrame, delay: str = "1 day") -> DataFrame:
    """rec_id, seen_at and the normalised listing; a listing that comes again within ``delay`` is dropped."""
    seen = listings.withColumns({"rec_id": rec_id(), "seen_at": F.current_timestamp()}).where(F.col("rec_id").isNotNull())
    return unify_values(normalize(seen)).withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["rec_id"])
