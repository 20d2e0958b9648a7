"""The pN_ queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import listing_instants
from ..sources.tables import PAIR_ATTRIBUTES, records, table
from .canonical import canonical_entries
from .components import connected_groups
from .entity_match import match_sources
from .leakage import leaked
from .line_labels import page_shares
from .near_duplicates import link_counts, linked_pairs, near_duplicates
from .packing import pack
from .split_overlap import overlapping_texts
from .survivors import survivors

#: Prices outside these bounds count as missing (fixed values).
PRICE_BOUNDS = (100, 1_000_000)
#: Source priority where both sources are trusted alike.
EQUAL_TRUST = 0


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every listing that stands in an accepted pair with another."""
    pairs = table(spark, sf_dir, "test_candidates").where("pred = 1").select("id_A", "id_B")
    return connected_groups(pairs, "id_A", "id_B")


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "description").select(F.col("rec_id").alias("id"), F.col("description").alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings whose descriptions share four fifths of their words."""
    found = near_duplicates(_descriptions(spark, sf_dir))
    return linked_pairs(found).select(F.col("id_a").alias("rec_id_a"), F.col("id_b").alias("rec_id_b"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per listing with a comparable description: its class and its number of links."""
    return link_counts(near_duplicates(_descriptions(spark, sf_dir))).select(F.col("id").alias("rec_id"), "class_id", "n_links")


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_sources(table(spark, sf_dir, "mediated_schema_normalized"), table(spark, sf_dir, "reference_values"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of listings of the two sources that offer one car, more likely than not."""
    return _matches(spark, sf_dir).where("probability >= 0.5").select("rec_id_a", "rec_id_b")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs with their marginal match probability."""
    return _matches(spark, sf_dir)


#: The fields that the reference list covers (fixed values).
REFERENCE_FIELDS = ["manufacturer", "model", "main_color"]


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_entries(records(spark, sf_dir, *REFERENCE_FIELDS), table(spark, sf_dir, "reference_values"), REFERENCE_FIELDS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference entry of each value that isn't literally canonical, 0 if none is meant."""
    return _entries(spark, sf_dir).select("rec_id", "field_name", "ref_id")


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values for which the reference list has no entry, with the number of listings."""
    return _entries(spark, sf_dir).where("ref_id = 0").groupBy("field_name", "value").agg(F.count("*").alias("n_listings"))


def _split_ends(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """id (trimmed) and text of both records of each pair of a split."""
    ends = [F.struct(F.regexp_replace(f"id_{x}", r"^\s+|\s+$", "").alias("id"), F.col(f"description_{x}").alias("text")) for x in "AB"]
    return table(spark, sf_dir, split).select(F.inline(F.array(*ends))).where("id <> ''")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split_name, source_name, rec_id, same_id, coverage (null without a similar text)."""
    train = _split_ends(spark, sf_dir, "train")
    held = _split_ends(spark, sf_dir, "val").withColumn("split_name", F.lit("val")).unionByName(_split_ends(spark, sf_dir, "test").withColumn("split_name", F.lit("test")))
    members, found = overlapping_texts(held.select("id", "text"), train)
    similar = members.join(found.groupBy(F.col("eval_cid").alias("cid")).agg(F.max("coverage").alias("coverage")), "cid").groupBy("id").agg(F.max("coverage").alias("coverage"))
    ids = held.select("split_name", "id").distinct()
    same = train.select("id").distinct().withColumn("same_id", F.lit(True))
    out = ids.join(same, "id", "left").join(similar, "id", "left").where("same_id or coverage is not null")
    source = F.when(F.col("id").startswith("S2_"), "used_cars").otherwise("vehicles")
    return out.select("split_name", source.alias("source_name"), F.col("id").alias("rec_id"), F.coalesce("same_id", F.lit(False)).alias("same_id"), "coverage")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of val and test that also stand in train, by id or by almost the same description."""
    return _overlaps(spark, sf_dir).select("split_name", "source_name", "rec_id")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: overlapping records, how many by id and by text."""
    by_text = F.col("coverage").isNotNull()
    return _overlaps(spark, sf_dir).groupBy("split_name", "source_name").agg(F.count("*").alias("n_records"), F.count_if("same_id").alias("n_same_id"), F.count_if(by_text).alias("n_similar_text"))


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each evaluation record that stands in matched intervals of one training text."""
    return _overlaps(spark, sf_dir).where("coverage is not null").select("split_name", "rec_id", F.round("coverage", 4).alias("coverage"))


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [a for a in PAIR_ATTRIBUTES if a != "location"]
    cleaned = records(spark, sf_dir, "vin", "location", *fields, name="cleaned_dataset")
    dated = listing_instants(cleaned, table(spark, sf_dir, "location_zones"), ["rec_id", "vin", "location", *fields])
    usable = {a: (F.trim(F.col(a)) != "") if kind == "string" else F.col(a).isNotNull() for a, kind in dated.dtypes if a in PAIR_ATTRIBUTES}
    usable["price"] = F.col("price").between(*PRICE_BOUNDS)
    return survivors(dated, "vin", "rec_id", "utc_second", usable, F.lit(EQUAL_TRUST)).where("several")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a VIN that is strictly the latest and strictly the fullest of several.

    As both sources are trusted alike, such a record gives the survivor every field that it has.
    """
    chosen = _survivors(spark, sf_dir).where("latest_alone and fullest_alone and latest = fullest")
    return chosen.where("n_latest = n_full").select("vin", F.col("latest").alias("rec_id"))


def p7_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per VIN with several, built field by field."""
    return _survivors(spark, sf_dir).drop("several")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which they hold 13 consecutive words or more."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked item the number of documents and the longest passage."""
    found = leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest_words"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "container_sizes").select("container_id", "capacity_tokens").distinct()


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, for each capacity."""
    return _packed(spark, sf_dir)


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: texts packed; texts whose pieces don't join up, texts cut though they fit, containers over capacity (none of these may be)."""
    packed = _packed(spark, sf_dir).join(_sizes(spark, sf_dir), "container_id")
    pieces = packed.groupBy("container_id", "capacity_tokens", "doc_id").agg(
        F.count("*").alias("n"), F.max("piece").alias("last"), F.count_distinct("piece").alias("kinds"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.min("start_token").alias("start")
    )
    torn = (F.col("n") != F.col("kinds")) | (F.col("last") + 1 != F.col("n")) | (F.col("tokens") != F.col("end")) | (F.col("start") != 0)
    texts = pieces.groupBy("container_id").agg(F.count("*").alias("n_texts"), F.count_if(torn).alias("n_torn"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("n_cut_that_fit"))
    bins = packed.groupBy("container_id", "capacity_tokens", "bin_id").agg(F.sum("n_tokens").alias("held")).groupBy("container_id").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("n_overfull"))
    return texts.join(bins, "container_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, tokens and the share of the space that is used."""
    bins = _packed(spark, sf_dir).groupBy("container_id").agg(F.count_distinct("bin_id").alias("n_bins"), F.sum("n_tokens").alias("n_tokens"))
    return bins.join(_sizes(spark, sf_dir), "container_id").withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly keyword lists, link lists or tags."""
    return page_shares(table(spark, sf_dir, "documents")).where("flagged").select("doc_id")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its words and those in lines that are not prose."""
    return page_shares(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_links": p2_links, "p3_found": p3_found, "p3_unmatched": p3_unmatched, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p5_report": p5_report, "p5_coverage": p5_coverage,
    "p7_found": p7_found, "p7_survivors": p7_survivors, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_checks": p8_checks, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_shares": p10_shares,
}
