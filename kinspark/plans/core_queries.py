"""The core's queries: one per operator of the inventory, and problem 6.

Each runs over its whole tables. ``ORACLE`` has the same in SQL where SQL can say it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vin as V
from ..functions.similarity import jaro_winkler
from ..functions.timestamps import listing_instants
from ..matching.features import LOGISTIC, RATIOS, STRINGS, VOCABULARIES, distance_features, logistic_features, matcher_record
from ..matching.models import fit_distance, fit_logistic, fit_text
from ..operators import blocking, evaluate, groundtruth, hash_order, mediate, profile, serialize
from ..sources.tables import MEDIATED, PAIR_ATTRIBUTES, rec_id, records, table

Spark = SparkSession
QUERIES = {}
FIELDS = [*STRINGS, *RATIOS, *VOCABULARIES]
NUMERIC = ["price", "year", "mileage", "latitude", "longitude"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _mediated(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "mediated_schema_normalized")


BLOCKED = ["year", "manufacturer", "model", "fuel_type"]
COMPARED = [c for c in PAIR_ATTRIBUTES if c not in ("description", "pubblication_date")]


def _distinct_pairs(spark: Spark, d: str, split: str, attributes: list[str] | None = None) -> DataFrame:
    """A split's pairs: trimmed ids, repeated rows once; of the attributes only those named, so that only they are read."""
    p = table(spark, d, split)
    if attributes is not None:
        p = p.select("id_A", *[f"{c}_A" for c in attributes], "id_B", *[f"{c}_B" for c in attributes], "label")
    return p.withColumns({c: text.strip(F.col(c)) for c in ("id_A", "id_B")}).distinct()


def _source(spark: Spark, d: str, first: bool) -> DataFrame:
    """The listings of one source under that source's own column names."""
    names = mediate.FIRST_NAMES if first else mediate.SECOND_NAMES
    mine, other = ("id_source_vehicles", "id_source_used_cars")[:: 1 if first else -1]
    back = {v: k for k, v in names.items()}
    rows = _mediated(spark, d).where(F.col(mine).isNotNull()).drop(other).distinct()
    return rows.withColumnsRenamed({c: back[c] for c in rows.columns if c in back})


@query
def p6_found(spark: Spark, d: str) -> DataFrame:
    """One row for each listing whose date denotes a moment."""
    listings = records(spark, d, "location", "pubblication_date").where(F.col("pubblication_date").isNotNull())
    found = listing_instants(listings, table(spark, d, "location_zones"), ["rec_id"])
    # An aggregate, not a filter before distinct: a pushed-down filter would repeat every date expression.
    return found.groupBy("rec_id").agg(F.min("utc_second").alias("utc_second")).where(F.col("utc_second").isNotNull())


@query
def profile_missing_unique(spark: Spark, d: str) -> DataFrame:
    return profile.profile(_mediated(spark, d)).drop("data_type")


@query
def profile_missing(spark: Spark, d: str) -> DataFrame:
    return profile.null_percents(_mediated(spark, d))


@query
def describe_numeric(spark: Spark, d: str) -> DataFrame:
    out = profile.describe(_mediated(spark, d), NUMERIC)
    return out.select("attribute", F.col("n").cast("bigint").alias("n"), *[F.round(c, 3).alias(c) for c in out.columns[2:]])


@query
def schema_counts(spark: Spark, d: str) -> DataFrame:
    return profile.schema_info(_mediated(spark, d)).drop("data_type")


@query
def missing_patterns(spark: Spark, d: str) -> DataFrame:
    return profile.missing_patterns(_mediated(spark, d))


@query
def drop_high_missing(spark: Spark, d: str) -> DataFrame:
    """Both sources with an empty column: the number of columns left when those with more than 70 % nulls are gone."""
    out = []
    for first in (True, False):
        kept = profile.drop_mostly_missing(_source(spark, d, first).withColumn("theft", F.lit(None).cast("string")), 70.0)
        out.append(kept.select(F.col("id").alias("rec_id"), F.lit(len(kept.columns)).cast("bigint").alias("n_columns")))
    return out[0].unionAll(out[1])


@query
def drop_null_critical(spark: Spark, d: str) -> DataFrame:
    """The rows of both sources that lack no critical value."""
    sides = ((True, mediate.FIRST_CRITICAL), (False, mediate.SECOND_CRITICAL))
    a, b = (profile.drop_incomplete(_source(spark, d, first), critical).select(F.col("id").alias("rec_id")) for first, critical in sides)
    return a.unionAll(b)


@query
def dropped_rows(spark: Spark, d: str) -> DataFrame:
    """How many rows of each source lack each critical value, and how many are dropped for it."""
    sides = (("vehicles", True, mediate.FIRST_CRITICAL), ("used_cars", False, mediate.SECOND_CRITICAL))
    a, b = (profile.dropped_counts(_source(spark, d, first), critical).select(F.lit(name).alias("source_name"), "*") for name, first, critical in sides)
    return a.unionAll(b)


@query
def second_source_cleaned(spark: Spark, d: str) -> DataFrame:
    """The second source with ids of its own, given before incomplete rows go."""
    out = mediate.clean_second(_source(spark, d, False).withColumnRenamed("id", "listing"), ["listing"])
    return out.select("listing", "id")


@query
def row_id_prefix(spark: Spark, d: str) -> DataFrame:
    """Dense ids in the order of customer keys."""
    out = mediate.with_row_id(table(spark, d, "customer"), ["c_custkey"])
    return out.select("c_custkey", "id")


@query
def unified_id(spark: Spark, d: str) -> DataFrame:
    return _mediated(spark, d).groupBy(rec_id().alias("rec_id")).agg(F.count("*").alias("n_rows"))


@query
def whole_number_ids(spark: Spark, d: str) -> DataFrame:
    raw = _mediated(spark, d).select(F.concat("id_source_vehicles", F.lit(".0")).alias("raw")).distinct()
    return raw.where("raw is not null").select("raw", mediate.whole_number_id("raw").alias("id"))


@query
def mediated_union(spark: Spark, d: str) -> DataFrame:
    """Both sources under their own names, brought back to the mediated schema."""
    out = mediate.mediate(_source(spark, d, True), _source(spark, d, False))
    return out.select(rec_id().alias("rec_id"), *[c for c in MEDIATED if not c.startswith("id_")])


@query
def value_map(spark: Spark, d: str) -> DataFrame:
    short = F.when(F.col("transmission").isin("automatic", "manual"), F.upper(F.substring("transmission", 1, 1))).otherwise(F.col("transmission"))
    long = F.when(F.col("fuel_type") == "gas", "Gasoline").otherwise(F.col("fuel_type"))
    rows = _mediated(spark, d).select(short.alias("transmission"), long.alias("fuel_type"))
    return mediate.unify_values(rows).groupBy("transmission", "fuel_type").agg(F.count("*").alias("n_rows"))


@query
def clean_text(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("source")).alias("cleaned"), text.clean_text(F.col("lang")).alias("lang"))


@query
def clean_description(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_description(F.col("text")).cast("binary")).alias("cleaned_md5"))


@query
def to_number(spark: Spark, d: str) -> DataFrame:
    """Numbers in the text columns of listings."""
    words = F.explode(F.array(F.struct(F.lit("model").alias("field"), F.element_at(F.split("model", " "), -1).alias("word")), F.struct(F.lit("cylinders").alias("field"), F.element_at(F.split("cylinders", " "), 1).alias("word"))))
    w = _mediated(spark, d).select(words.alias("x")).select("x.*").where("word is not null")
    return w.groupBy("field", text.to_number(F.col("word")).alias("number")).agg(F.count("*").alias("n_rows"))


@query
def year_forms(spark: Spark, d: str) -> DataFrame:
    return _mediated(spark, d).groupBy(text.year_form(F.col("year")).alias("year_text"), text.prefix3(text.compare_form(F.col("manufacturer"))).alias("make_prefix")).agg(F.count("*").alias("n_rows"))


@query
def matcher_forms(spark: Spark, d: str) -> DataFrame:
    m = _mediated(spark, d)
    return m.groupBy(text.matcher_form(F.col("year")).alias("year_text"), text.null_if_token(F.col("main_color"), ["", "nan", "none", "unknown"]).alias("color")).agg(F.count("*").alias("n_rows"))


@query
def vin_normalize(spark: Spark, d: str) -> DataFrame:
    return _mediated(spark, d).groupBy(V.normalized(F.col("vin")).alias("vin")).agg(F.count("*").alias("n_rows"))


@query
def vin_checks(spark: Spark, d: str) -> DataFrame:
    v = _mediated(spark, d).select(V.normalized(F.col("vin")).alias("vin")).where("vin is not null").distinct()
    return v.select("vin", *[f(F.col("vin")).cast("int").alias(n) for n, f in (("legal", V.is_legal), ("placeholder", V.is_placeholder), ("check_digit", V.check_digit_ok))])


@query
def vin_cleaned(spark: Spark, d: str) -> DataFrame:
    """Listings with a legal number that is no placeholder and has a right check digit."""
    return groundtruth.legal_vins(_mediated(spark, d)).select(rec_id().alias("rec_id"), "vin").distinct()


@query
def leader_dedup(spark: Spark, d: str) -> DataFrame:
    """The leaders among the listings of each legal number."""
    return groundtruth.clean_by_vin(_mediated(spark, d)).select("rec_id", "vin")


def _records(spark: Spark, d: str) -> DataFrame:
    return records(spark, d, "vin", *PAIR_ATTRIBUTES, name="cleaned_dataset")


@query
def positives_self_join(spark: Spark, d: str) -> DataFrame:
    return groundtruth.positive_pairs(_records(spark, d))


def _negatives(spark: Spark, d: str) -> DataFrame:
    """Twice as many as there are positives, as far as there are enough."""
    positives = groundtruth.positive_pairs(_records(spark, d))
    return groundtruth.negative_pairs(_records(spark, d), positives, 2 * positives.count())


@query
def negatives_hard_candidates(spark: Spark, d: str) -> DataFrame:
    return groundtruth.negative_candidates(_records(spark, d), ["mfr", "yr", "body"])


@query
def negatives_medium_candidates(spark: Spark, d: str) -> DataFrame:
    return groundtruth.negative_candidates(_records(spark, d), ["mfr", "yr"])


@query
def negatives_quota(spark: Spark, d: str) -> DataFrame:
    return _negatives(spark, d).select("id_A", "id_B", "stratum", "label")


@query
def negatives_shares(spark: Spark, d: str) -> DataFrame:
    return groundtruth.stratum_shares(_negatives(spark, d))


@query
def ground_truth(spark: Spark, d: str) -> DataFrame:
    """Labelled pairs with their split; negatives are twice the positives as far as there are enough."""
    pairs = groundtruth.ground_truth(_records(spark, d).distinct())
    return groundtruth.split(pairs).select("id_A", "manufacturer_A", "price_A", "id_B", "manufacturer_B", "price_B", "label", "split")


def _all_pairs(spark: Spark, d: str) -> DataFrame:
    return _distinct_pairs(spark, d, "train", [])


@query
def split_stratified(spark: Spark, d: str) -> DataFrame:
    return groundtruth.split(_all_pairs(spark, d))


@query
def sample_without_replacement(spark: Spark, d: str) -> DataFrame:
    return hash_order.take(_all_pairs(spark, d), 500, ["id_A", "id_B"])


@query
def shuffled_order(spark: Spark, d: str) -> DataFrame:
    ranked = hash_order.with_rank(_all_pairs(spark, d), ["id_A", "id_B"])
    return ranked.select("id_A", "id_B", F.col("_rank").alias("position"))


@query
def label_distribution(spark: Spark, d: str) -> DataFrame:
    return profile.label_counts(table(spark, d, "train"))


@query
def latest_first(spark: Spark, d: str) -> DataFrame:
    """The latest record of each number, unreadable dates last."""
    dated = listing_instants(_records(spark, d), table(spark, d, "location_zones"), ["rec_id", "vin"])
    return evaluate.first_of(dated, ["vin"], [F.col("utc_second").desc_nulls_last(), "rec_id"]).select("vin", "rec_id")


@query
def first_per_id(spark: Spark, d: str) -> DataFrame:
    ends = table(spark, d, "test_candidates").select(text.strip(F.col("id_A")).alias("id"), "id_B", "prob").where("id is not null")
    return evaluate.first_of(ends, ["id"], [F.col("prob").desc_nulls_last(), F.col("id_B").asc_nulls_last()]).select("id", "prob")


@query
def block_b1(spark: Spark, d: str) -> DataFrame:
    return blocking.block(_distinct_pairs(spark, d, "test", BLOCKED), "B1").select("id_A", "id_B", "label")


@query
def block_b2(spark: Spark, d: str) -> DataFrame:
    return blocking.block(_distinct_pairs(spark, d, "test", BLOCKED), "B2").select("id_A", "id_B", "label")


@query
def block_stats(spark: Spark, d: str) -> DataFrame:
    p = _distinct_pairs(spark, d, "test", BLOCKED)
    return blocking.blocking_stats(p, "B1").unionByName(blocking.blocking_stats(p, "B2"))


@query
def block_value_pairs(spark: Spark, d: str) -> DataFrame:
    """The similar spellings of makes within a year and prefix, as the record-level block join uses them."""
    r = records(spark, d, "year", "manufacturer").select(text.year_form(F.col("year")).alias("y"), text.compare_form(F.col("manufacturer")).alias("m")).where("y <> ''").distinct()
    k = r.withColumn("p", text.prefix3(F.col("m")))
    both = k.select("y", "p", F.col("m").alias("ma")).join(k.select("y", "p", F.col("m").alias("mb")), ["y", "p"]).where("ma < mb")
    return both.where(jaro_winkler("ma", "mb") >= 0.95).select("y", "ma", "mb")


@query
def jaro_winkler_values(spark: Spark, d: str) -> DataFrame:
    v = table(spark, d, "train").select("model_A", "model_B").distinct().where("model_A is not null and model_B is not null")
    return v.select("model_A", "model_B", F.round(jaro_winkler("model_A", "model_B"), 6).alias("similarity"))


@query
def features_lr(spark: Spark, d: str) -> DataFrame:
    p = logistic_features(_distinct_pairs(spark, d, "train", COMPARED))
    return p.select("id_A", "id_B", "label", *[F.round(c, 6).alias(c) for c in LOGISTIC])


@query
def features_distance(spark: Spark, d: str) -> DataFrame:
    p, names = distance_features(_distinct_pairs(spark, d, "train", COMPARED))
    return p.select("id_A", "id_B", "label", *[F.round(c, 6).alias(c) for c in names])


@query
def features_from_records(spark: Spark, d: str) -> DataFrame:
    """The same features where pairs have ids only and both records are looked up."""
    p = logistic_features(groundtruth.with_attributes(_all_pairs(spark, d), _records(spark, d)))
    return p.select("id_A", "id_B", "label", *[F.round(c, 6).alias(c) for c in LOGISTIC])


@query
def matcher_records(spark: Spark, d: str) -> DataFrame:
    """The listings of the training pairs as the distance matcher takes them."""
    ids = _all_pairs(spark, d).select(F.explode(F.array("id_A", "id_B")).alias("rec_id")).distinct()
    rows = records(spark, d, *FIELDS).distinct().join(ids, "rec_id", "left_semi")
    return rows.select("rec_id", *[matcher_record(c).alias(c) for c in FIELDS])


def _scores(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "test_candidates").where("label is not null and prob is not null").select("label", "prob")


@query
def threshold_sweep(spark: Spark, d: str) -> DataFrame:
    return evaluate.threshold_sweep(_scores(spark, d))


@query
def best_threshold(spark: Spark, d: str) -> DataFrame:
    return evaluate.best_threshold(_scores(spark, d))


@query
def score_classes(spark: Spark, d: str) -> DataFrame:
    s = table(spark, d, "test_candidates").where("prob is not null").select((F.col("prob") >= 0.6).cast("int").alias("pred"), "label")
    return s.groupBy("pred", "label").agg(F.count("*").alias("n_pairs"))


def _trimmed(spark: Spark, d: str) -> DataFrame:
    return table(spark, d, "test_candidates").withColumns({c: text.strip(F.col(c)) for c in ("id_A", "id_B")})


@query
def global_predictions(spark: Spark, d: str) -> DataFrame:
    """Whole-test predictions; of several candidates of a pair the most probable counts (then the higher decision)."""
    truth = _distinct_pairs(spark, d, "test", []).withColumns({"prob": F.lit(0.0), "pred": F.lit(0)})
    c = _trimmed(spark, d).where("pred is not null and prob is not null")
    return evaluate.global_predictions(truth, c, ["prob", "pred"]).select("lo", "hi", "label", "pred")


@query
def confusion(spark: Spark, d: str) -> DataFrame:
    return evaluate.confusion(global_predictions(spark, d))


@query
def candidate_metrics(spark: Spark, d: str) -> DataFrame:
    return evaluate.confusion(table(spark, d, "test_candidates").where("label is not null and pred is not null"))


def _serialised_sets(spark: Spark, d: str) -> dict[str, DataFrame]:
    """All splits and the candidates of both strategies."""
    sets = {name: _distinct_pairs(spark, d, name) for name in ("train", "val", "test")}
    return sets | {name: blocking.block(sets["test"], name) for name in ("B1", "B2")}


@query
def serialize_record(spark: Spark, d: str) -> DataFrame:
    parts = []
    for name in ("train", "val", "test"):
        p = _distinct_pairs(spark, d, name)
        parts.append(p.select(F.lit(name).alias("part"), "id_A", "id_B", F.md5(serialize.serialized(p, "_A").cast("binary")).alias("a_md5"), F.md5(serialize.serialized(p, "_B").cast("binary")).alias("b_md5")))
    return reduce(DataFrame.unionAll, parts)


@query
def pair_lines(spark: Spark, d: str) -> DataFrame:
    parts = [serialize.pair_lines(p).select(F.lit(name).alias("part"), F.md5(F.col("value").cast("binary")).alias("line_md5")) for name, p in _serialised_sets(spark, d).items()]
    return reduce(DataFrame.unionAll, parts)


@query
def semi_ids(spark: Spark, d: str) -> DataFrame:
    ids = table(spark, d, "test").select(text.strip(F.col("id_A")).alias("rec_id"))
    return records(spark, d).distinct().join(ids, "rec_id", "left_semi")


@query
def anti_ids(spark: Spark, d: str) -> DataFrame:
    ids = id_union(spark, d).select("rec_id")
    return records(spark, d).distinct().join(ids, "rec_id", "left_anti")


@query
def id_union(spark: Spark, d: str) -> DataFrame:
    ends = [F.array(*[text.strip(F.col(c)) for c in ("id_A", "id_B")])]
    a, b = (table(spark, d, s).select(F.explode(*ends).alias("rec_id")) for s in ("train", "val"))
    return a.union(b).where("rec_id is not null").distinct()


@query
def pair_lookup(spark: Spark, d: str) -> DataFrame:
    """Candidate pairs with the prices of both ends; unknown ends go."""
    pairs = _trimmed(spark, d).select("id_A", "id_B").distinct()
    r = records(spark, d, "price").distinct()
    return pairs.join(r.select(F.col("rec_id").alias("id_A"), F.col("price").alias("price_A")), "id_A").join(r.select(F.col("rec_id").alias("id_B"), F.col("price").alias("price_B")), "id_B")


@query
def extra_ids(spark: Spark, d: str) -> DataFrame:
    """A sample of the cleaned records that stand in no pair of train or val."""
    rest = _records(spark, d).select("rec_id").distinct().join(id_union(spark, d), "rec_id", "left_anti")
    return hash_order.take(rest, 300, ["rec_id"])


@query
def match_lists(spark: Spark, d: str) -> DataFrame:
    """Training pairs, as matches and distinct ones, of which both records are known."""
    known = _records(spark, d).select("rec_id").distinct()
    p = _all_pairs(spark, d)
    for end in ("id_A", "id_B"):
        p = p.join(known.withColumnRenamed("rec_id", end), end, "left_semi")
    return p.select("id_A", "id_B", F.when(F.col("label") == 1, "match").otherwise("distinct").alias("kind"))


@query
def default_scores(spark: Spark, d: str) -> DataFrame:
    """The best score of every test pair among the candidates; pairs that were never scored have 0."""
    best = _trimmed(spark, d).select(*evaluate.pair_key(), "prob").groupBy("lo", "hi").agg(F.max("prob").alias("prob"))
    truth = _distinct_pairs(spark, d, "test", []).select(*evaluate.pair_key()).distinct()
    return truth.join(best, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("prob", F.lit(0.0)).alias("prob"))


def _splits(spark: Spark, d: str, attributes: list[str] | None = None) -> list[DataFrame]:
    return [_distinct_pairs(spark, d, s, attributes) for s in ("train", "val", "test")]


@query
def lr_fit_predict(spark: Spark, d: str) -> DataFrame:
    train, val, test = _splits(spark, d, COMPARED)
    return fit_logistic(train, val).score(test)


@query
def distance_matcher(spark: Spark, d: str) -> DataFrame:
    train, val, test = _splits(spark, d, COMPARED)
    return fit_distance(train, val).score(test)


@query
def text_matcher(spark: Spark, d: str) -> DataFrame:
    train, val, test = _splits(spark, d)
    return fit_text(train, val).score(test)


@query
def compare_report(spark: Spark, d: str) -> DataFrame:
    from ..matching.models import compare

    rows = compare(*_splits(spark, d))
    return spark.createDataFrame(rows).select(*rows[0])


from .core_oracle import ORACLE  # noqa: E402, F401
