"""The core's queries in SQL (names of tables as in the test data)."""

from __future__ import annotations

from ..functions.vin import LETTERS, NUMBERS, WEIGHTS
from ..matching.features import EXACT, GAUSS, RATIOS, SIMILAR, STRINGS, VOCABULARIES
from ..operators import mediate
from ..operators.groundtruth import COMPARED
from ..operators.serialize import FIELDS
from ..sources.tables import MEDIATED

NUMERIC = ["price", "year", "mileage", "latitude", "longitude"]
M = "mediated_schema_normalized"
REC = "coalesce(id_source_vehicles, id_source_used_cars)"
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


def trim(c: str) -> str:
    return TRIM.format(c)


def pairs(split: str, columns: str = "*") -> str:
    """A split's pairs: trimmed ids, repeated rows once."""
    if columns == "*":
        return f"(SELECT DISTINCT * REPLACE ({trim('id_A')} AS id_A, {trim('id_B')} AS id_B) FROM {split})"
    return f"(SELECT DISTINCT {trim('id_A')} AS id_A, {trim('id_B')} AS id_B, {columns} FROM {split})"


def clean(c: str) -> str:
    low = trim(f"lower({c})")
    kept = rf"CASE WHEN {low} NOT IN ('nan', 'none', '', '<na>') THEN regexp_replace({low}, '[^a-z0-9\s]', '', 'g') END"
    return rf"nullif({trim(rf'''regexp_replace({kept}, '\s+', ' ', 'g')''')}, '')"


def clean_desc(c: str) -> str:
    # Unicode blanks count as blanks in the engine; here every other character becomes a blank anyway.
    low = f"lower({c})"
    kept = rf"CASE WHEN {low} NOT IN ('nan', 'none', '', '<na>') THEN regexp_replace(regexp_replace({low}, 'http\S+|www\S+', '', 'g'), '[^a-z0-9\s]', ' ', 'g') END"
    return rf"nullif({trim(rf'''regexp_replace({kept}, '\s+', ' ', 'g')''')}, '')"


VIN = "regexp_replace(upper(vin), '[^A-Z0-9]', '', 'g')"
LEGAL = "regexp_matches(v, '^[A-HJ-NPR-Z0-9]{17}$')"
PLACEHOLDER = "((length(v) = 17 AND repeat(substr(v, 1, 1), 17) = v) OR contains(v, '12345678') OR contains(v, 'ABCDEFGH'))"
SUM = " + ".join(f"coalesce(try_cast(substr(translate(v, '{LETTERS}', '{NUMBERS}'), {i + 1}, 1) AS INT), 0) * {w}" for i, w in enumerate(WEIGHTS) if w)
CHECK = f"({LEGAL} AND substr(v, 9, 1) = CASE WHEN ({SUM}) % 11 = 10 THEN 'X' ELSE cast(({SUM}) % 11 AS VARCHAR) END)"
YEAR = "coalesce(cast(try_cast({0} AS BIGINT) AS VARCHAR), '')"
FORM = "lower(" + TRIM.format("coalesce({}, '')") + ")"


def b1(a: str = "A", b: str = "B") -> str:
    ya, yb, ma, mb = YEAR.format(f"year_{a}"), YEAR.format(f"year_{b}"), FORM.format(f"manufacturer_{a}"), FORM.format(f"manufacturer_{b}")
    return f"({ya} <> '' AND {ya} = {yb} AND substr({ma}, 1, 3) = substr({mb}, 1, 3) AND jaro_winkler_similarity({ma}, {mb}) >= 0.95)"


def b2() -> str:
    oa, ob, fa, fb = FORM.format("model_A"), FORM.format("model_B"), FORM.format("fuel_type_A"), FORM.format("fuel_type_B")
    return f"({b1()} AND substr({oa}, 1, 3) = substr({ob}, 1, 3) AND jaro_winkler_similarity({oa}, {ob}) >= 0.85 AND {fa} = {fb})"


def stats(name: str, cond: str) -> str:
    return f"""SELECT '{name}' AS strategy, coalesce(sum(label), 0)::BIGINT AS positives_in_test, coalesce(sum(label) FILTER (WHERE {cond}), 0)::BIGINT AS positives_captured,
      round(coalesce(sum(label) FILTER (WHERE {cond}), 0) / nullif(sum(label), 0)::DOUBLE, 6) AS blocking_recall, count(*) AS n_test_pairs, count(*) FILTER (WHERE {cond}) AS n_candidates,
      round(1 - count(*) FILTER (WHERE {cond}) / count(*)::DOUBLE, 6) AS reduction_ratio_vs_test FROM {pairs('test')}"""


SCORES = """round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"""
COUNTS = """count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND pred <> 1) AS fn, count(*) FILTER (WHERE label = 0 AND pred <> 1) AS tn"""
SWEEP = f"""SELECT threshold, tp, fp, fn, tn, {SCORES} FROM (SELECT t.threshold, count(*) FILTER (WHERE label = 1 AND prob >= t.threshold) AS tp, count(*) FILTER (WHERE label = 0 AND prob >= t.threshold) AS fp,
  count(*) FILTER (WHERE label = 1 AND prob < t.threshold) AS fn, count(*) FILTER (WHERE label = 0 AND prob < t.threshold) AS tn
  FROM test_candidates, (SELECT (k * 5 / 100.0)::DOUBLE AS threshold FROM range(2, 20) r(k)) t WHERE label IS NOT NULL AND prob IS NOT NULL GROUP BY 1)"""
GLOBAL = f"""SELECT t.lo, t.hi, t.label, coalesce(c.pred, 0) AS pred FROM (SELECT DISTINCT least(id_A, id_B) AS lo, greatest(id_A, id_B) AS hi, label FROM {pairs('test', 'label')}) t
  LEFT JOIN (SELECT lo, hi, pred FROM (SELECT least({trim('id_A')}, {trim('id_B')}) AS lo, greatest({trim('id_A')}, {trim('id_B')}) AS hi, pred,
  row_number() OVER (PARTITION BY least({trim('id_A')}, {trim('id_B')}), greatest({trim('id_A')}, {trim('id_B')}) ORDER BY prob DESC, pred DESC) AS n
  FROM test_candidates WHERE pred IS NOT NULL AND prob IS NOT NULL AND id_A IS NOT NULL AND id_B IS NOT NULL) WHERE n = 1) c ON t.lo = c.lo AND t.hi = c.hi"""
CLEANED = f"(SELECT DISTINCT {REC} AS rec_id, * FROM cleaned_dataset)"
GROUPED = f"""(SELECT DISTINCT rec_id, vin, lower({trim("coalesce(manufacturer, 'unknown')")}) AS mfr, coalesce(try_cast(year AS INT), 0) AS yr, lower({trim("coalesce(body_type, 'unknown')")}) AS body FROM {CLEANED})"""


def neg(fields: list[str]) -> str:
    by = ", ".join(fields)
    return f"""SELECT DISTINCT least(a.rec_id, b.rec_id) AS id_A, greatest(a.rec_id, b.rec_id) AS id_B FROM {{0}} a JOIN {{0}} b ON {' AND '.join(f'a.{f} = b.{f}' for f in fields)} AND a.vin <> b.vin AND a.rec_id <> b.rec_id
      AND ((a.n <= 50 AND a.p < b.p) OR (a.n > 50 AND (b.p - a.p + a.n) % a.n BETWEEN 1 AND 25))""".replace(
        "{0}", f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(concat_ws('|', '42', rec_id, vin)), rec_id, vin) - 1 AS p, count(*) OVER (PARTITION BY {by}) AS n FROM (SELECT DISTINCT rec_id, vin, {by} FROM {GROUPED}))"
    )


POSITIVE = f"SELECT DISTINCT a.rec_id AS id_A, b.rec_id AS id_B, 1 AS label FROM (SELECT DISTINCT rec_id, vin FROM {CLEANED}) a JOIN (SELECT DISTINCT rec_id, vin FROM {CLEANED}) b ON a.vin = b.vin AND a.rec_id < b.rec_id"
ORDER = "md5('42|' || id_A || '|' || id_B), id_A, id_B"


def quota(hard: str, medium: str) -> str:
    """Common tables p, h and m: positives, chosen hard and chosen medium negatives."""
    return f"""WITH p AS ({POSITIVE}), hc AS ({neg(['mfr', 'yr', 'body'])}), mc AS ({neg(['mfr', 'yr'])}),
      h AS (SELECT id_A, id_B FROM (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS n FROM hc WHERE (id_A, id_B) NOT IN (SELECT (id_A, id_B) FROM p)) WHERE n <= {hard}),
      m AS (SELECT id_A, id_B FROM (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS n FROM mc WHERE (id_A, id_B) NOT IN (SELECT (id_A, id_B) FROM p) AND (id_A, id_B) NOT IN (SELECT (id_A, id_B) FROM h)) WHERE n <= {medium})"""


TWICE = "(SELECT 2 * count(*) * 70 // 100 FROM p)", "(SELECT 2 * count(*) * 30 // 100 FROM p)"


def split_of(inner: str, columns: str) -> str:
    return f"""SELECT {columns}, CASE WHEN r <= n * 7 // 10 THEN 'train' WHEN r <= n * 8 // 10 THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORDER}) AS r, count(*) OVER (PARTITION BY label) AS n FROM ({inner}))"""


ALL = f"(SELECT DISTINCT id_A, id_B, label FROM {pairs('train', 'label')})"


def number_text(c: str, kind: str) -> str:
    if kind == "text":
        return c
    fixed = f"regexp_replace(printf('%.8f', {c}), '0+$', '')"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {fixed} LIKE '%.' THEN {fixed} || '0' ELSE {fixed} END"


def serialized(s: str) -> str:
    parts = []
    for f in FIELDS:
        v = trim(number_text(f"{f}_{s}", "number" if f in NUMERIC else "text"))
        parts.append(f"CASE WHEN {v} <> '' AND lower({v}) <> 'nan' THEN 'COL {f} VAL ' || translate({v}, chr(9) || chr(10) || chr(13), '   ') END")
    return f"concat_ws(' ', {', '.join(parts)})"


def matcher(c: str, number: bool) -> str:
    text = f"CAST({c} AS VARCHAR)"
    plain = trim(f"coalesce({text}, '')")
    x = f"try_cast({c} AS DOUBLE)"
    return f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN cast(cast({x} AS BIGINT) AS VARCHAR) ELSE {plain} END)"


def sim(c: str, t: float) -> str:
    return f"coalesce((jaro_winkler_similarity({c}_A, {c}_B) >= {t})::INT::DOUBLE, 0.0) AS sim_{c}"


def gauss(c: str, o: float, s: float) -> str:
    d = f"abs({c}_A - {c}_B)"
    return f"round(coalesce(CASE WHEN {d} <= {o} THEN 1.0 ELSE pow(2.0, -pow(({d} - {o}) / {s}, 2)) END, 0.0), 6)::DOUBLE AS near_{c}"


LOGISTIC_SQL = ", ".join([sim(c, t) for c, t in SIMILAR.items()] + [f"coalesce(({c}_A = {c}_B)::INT::DOUBLE, 0.0) AS same_{c}" for c in EXACT] + [gauss(c, *p) for c, p in GAUSS.items()])


def record_form(c: str) -> str:
    if c in RATIOS:
        return c
    form, nothing = (matcher(c, c in NUMERIC), "'', 'nan', 'none'") if c in STRINGS else (c, "'nan'")
    return f"CASE WHEN lower({form}) NOT IN ({nothing}) THEN {form} END AS {c}"


def distances() -> str:
    out = []
    for c in STRINGS:
        a, b = (f"lower({matcher(f'{c}_{s}', c in NUMERIC)})" for s in "AB")
        d = f"CASE WHEN length({a}) > 0 AND length({b}) > 0 THEN levenshtein({a}, {b}) / greatest(length({a}), length({b}))::DOUBLE END"
        out += [f"round(coalesce({d}, 0.0), 6)::DOUBLE AS d_{c}", f"(({d}) IS NULL)::INT::DOUBLE AS miss_{c}"]
    for c in RATIOS:
        d = f"CASE WHEN {c}_A > 0 AND {c}_B > 0 THEN abs(log10({c}_A) - log10({c}_B)) END"
        out += [f"round(coalesce({d}, 0.0), 6)::DOUBLE AS d_{c}", f"(({d}) IS NULL)::INT::DOUBLE AS miss_{c}"]
    for c, words in VOCABULARIES.items():
        inside = ", ".join(f"'{w}'" for w in words)
        known = f"lower({c}_A) IN ({inside}) AND lower({c}_B) IN ({inside})"
        out += [f"coalesce(({known} AND lower({c}_A) = lower({c}_B))::INT::DOUBLE, 0.0) AS same_{c}", f"coalesce(({known} AND lower({c}_A) <> lower({c}_B))::INT::DOUBLE, 0.0) AS other_{c}"]
    return ", ".join(out)


CRITICAL_COLUMNS = ["manufacturer", "model", "year", "mileage", "fuel_type"]
CRITICAL = " AND ".join(f"{c} IS NOT NULL" for c in CRITICAL_COLUMNS)
TEXTS = [c for c in ("location", "manufacturer", "model", "cylinders", "fuel_type", "transmission", "traction", "body_type", "main_color")]


def mediated_column(c: str) -> str:
    if c == "transmission":
        return f"CASE {clean(c)} WHEN 'a' THEN 'automatic' WHEN 'm' THEN 'manual' ELSE {clean(c)} END AS {c}"
    if c == "fuel_type":
        return f"CASE {clean(c)} WHEN 'gasoline' THEN 'gas' ELSE {clean(c)} END AS {c}"
    return f"{clean(c)} AS {c}" if c in TEXTS else f"{clean_desc(c)} AS {c}" if c == "description" else c


ENDS = f"SELECT {trim('id_A')} AS rec_id FROM {{0}} UNION SELECT {trim('id_B')} FROM {{0}}"
UNION_IDS = f"SELECT rec_id FROM ({ENDS.format('train')} UNION {ENDS.format('val')}) WHERE rec_id IS NOT NULL"

ORACLE: dict[str, str] = {
    "profile_missing_unique": _union(f"SELECT '{c}' AS attribute, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS missing_pct, round(count(DISTINCT {c}) * 100.0::DOUBLE / count(*), 6) AS unique_pct FROM {M}" for c in MEDIATED),
    "profile_missing": _union(f"SELECT '{c}' AS attribute, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM {M}" for c in MEDIATED),
    "describe_numeric": _union(
        f"SELECT '{c}' AS attribute, count({c}) AS n, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min, round(quantile_cont({c}, 0.25), 3) AS q25, round(quantile_cont({c}, 0.5), 3) AS q50, round(quantile_cont({c}, 0.75), 3) AS q75, round(max({c}), 3) AS max FROM {M}"
        for c in NUMERIC
    ),
    "schema_counts": _union(f"SELECT '{c}' AS attribute, count({c}) AS non_null, count(*) AS n_rows FROM {M}" for c in MEDIATED),
    "missing_patterns": f"SELECT {' || '.join(f'({c} IS NULL)::INT::VARCHAR' for c in MEDIATED)} AS pattern, count(*) AS n_rows FROM {M} GROUP BY 1",
    "drop_high_missing": _union(
        f"SELECT {i} AS rec_id, (SELECT 1 + {' + '.join(f'(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*) <= 70)::INT' for c in MEDIATED[2:])} FROM (SELECT DISTINCT * FROM {M} WHERE {i} IS NOT NULL))::BIGINT AS n_columns FROM (SELECT DISTINCT * FROM {M} WHERE {i} IS NOT NULL)"
        for i in MEDIATED[:2]
    ),
    "drop_null_critical": f"SELECT {REC} AS rec_id FROM (SELECT DISTINCT * FROM {M} WHERE {REC} IS NOT NULL) WHERE {CRITICAL}",
    "dropped_rows": _union(
        f"SELECT '{n}' AS source_name, '{a}' AS attribute, count(*) FILTER (WHERE {cond}) AS n_missing FROM (SELECT DISTINCT * FROM {M} WHERE {i} IS NOT NULL)"
        for n, i, names in (("vehicles", MEDIATED[0], mediate.FIRST_CRITICAL), ("used_cars", MEDIATED[1], mediate.SECOND_CRITICAL))
        for a, cond in [*zip(names, (f"{c} IS NULL" for c in CRITICAL_COLUMNS)), ("(any)", f"NOT ({CRITICAL})")]
    ),
    "second_source_cleaned": f"SELECT listing, id FROM (SELECT *, id_source_used_cars AS listing, 'S2_' || (row_number() OVER (ORDER BY id_source_used_cars) - 1) AS id FROM (SELECT DISTINCT * FROM {M} WHERE id_source_used_cars IS NOT NULL)) WHERE {CRITICAL}",
    "row_id_prefix": "SELECT c_custkey, 'S2_' || (row_number() OVER (ORDER BY c_custkey) - 1) AS id FROM customer",
    "unified_id": f"SELECT {REC} AS rec_id, count(*) AS n_rows FROM {M} GROUP BY 1",
    "whole_number_ids": f"SELECT DISTINCT id_source_vehicles || '.0' AS raw, id_source_vehicles AS id FROM {M} WHERE id_source_vehicles IS NOT NULL",
    "mediated_union": f"SELECT {REC} AS rec_id, {', '.join(mediated_column(c) for c in MEDIATED[2:])} FROM (SELECT DISTINCT * FROM {M})",
    "value_map": f"SELECT transmission, fuel_type, count(*) AS n_rows FROM {M} GROUP BY 1, 2",
    "clean_text": f"SELECT doc_id, {clean('source')} AS cleaned, {clean('lang')} AS lang FROM documents",
    "clean_description": f"SELECT doc_id, md5({clean_desc('text')}) AS cleaned_md5 FROM documents",
    "to_number": f"SELECT field, try_cast(word AS DOUBLE) AS number, count(*) AS n_rows FROM (SELECT 'model' AS field, string_split(model, ' ')[-1] AS word FROM {M} UNION ALL SELECT 'cylinders', string_split(cylinders, ' ')[1] FROM {M}) WHERE word IS NOT NULL GROUP BY 1, 2",
    "year_forms": f"SELECT {YEAR.format('year')} AS year_text, substr({FORM.format('manufacturer')}, 1, 3) AS make_prefix, count(*) AS n_rows FROM {M} GROUP BY 1, 2",
    "matcher_forms": f"SELECT {matcher('year', True)} AS year_text, CASE WHEN lower({trim('main_color')}) NOT IN ('', 'nan', 'none', 'unknown') THEN main_color END AS color, count(*) AS n_rows FROM {M} GROUP BY 1, 2",
    "vin_normalize": f"SELECT {VIN} AS vin, count(*) AS n_rows FROM {M} GROUP BY 1",
    "vin_checks": f"SELECT v AS vin, ({LEGAL})::INT AS legal, ({PLACEHOLDER})::INT AS placeholder, ({CHECK})::INT AS check_digit FROM (SELECT DISTINCT {VIN} AS v FROM {M} WHERE vin IS NOT NULL)",
    "vin_cleaned": f"SELECT DISTINCT rec_id, v AS vin FROM (SELECT {REC} AS rec_id, {VIN} AS v FROM {M} WHERE vin IS NOT NULL) WHERE {LEGAL} AND NOT {PLACEHOLDER} AND {CHECK}",
    "positives_self_join": POSITIVE,
    "negatives_hard_candidates": neg(["mfr", "yr", "body"]),
    "negatives_medium_candidates": neg(["mfr", "yr"]),
    "extra_ids": f"SELECT rec_id FROM (SELECT rec_id, row_number() OVER (ORDER BY md5('42|' || rec_id), rec_id) AS n FROM (SELECT DISTINCT rec_id FROM {CLEANED}) WHERE rec_id NOT IN ({UNION_IDS})) WHERE n <= 300",
    "match_lists": f"SELECT id_A, id_B, CASE WHEN label = 1 THEN 'match' ELSE 'distinct' END AS kind FROM {ALL} WHERE id_A IN (SELECT rec_id FROM {CLEANED}) AND id_B IN (SELECT rec_id FROM {CLEANED})",
    "default_scores": f"SELECT t.lo, t.hi, coalesce(max(c.prob), 0.0::DOUBLE) AS prob FROM (SELECT DISTINCT least(id_A, id_B) AS lo, greatest(id_A, id_B) AS hi FROM {pairs('test', 'label')}) t LEFT JOIN (SELECT least({trim('id_A')}, {trim('id_B')}) AS lo, greatest({trim('id_A')}, {trim('id_B')}) AS hi, prob FROM test_candidates WHERE id_A IS NOT NULL AND id_B IS NOT NULL) c ON t.lo = c.lo AND t.hi = c.hi GROUP BY 1, 2",
    "negatives_quota": f"{quota(*TWICE)} SELECT id_A, id_B, 'hard' AS stratum, 0 AS label FROM h UNION ALL SELECT id_A, id_B, 'medium', 0 FROM m",
    "negatives_shares": f"{quota(*TWICE)} SELECT stratum, count(*) AS n_pairs, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM (SELECT 'hard' AS stratum FROM h UNION ALL SELECT 'medium' FROM m) GROUP BY 1",
    "ground_truth": f"""{quota(*TWICE)} {split_of(
        f"SELECT x.id_A, x.id_B, x.label, a.manufacturer AS manufacturer_A, a.price AS price_A, b.manufacturer AS manufacturer_B, b.price AS price_B FROM (SELECT id_A, id_B, 1 AS label FROM p UNION ALL SELECT id_A, id_B, 0 FROM h UNION ALL SELECT id_A, id_B, 0 FROM m) x JOIN {CLEANED} a ON x.id_A = a.rec_id JOIN {CLEANED} b ON x.id_B = b.rec_id",
        'id_A, manufacturer_A, price_A, id_B, manufacturer_B, price_B, label')}""",
    "split_stratified": split_of(f"SELECT * FROM {ALL}", "id_A, id_B, label"),
    "sample_without_replacement": f"SELECT id_A, id_B, label FROM (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS n FROM {ALL}) WHERE n <= 500",
    "shuffled_order": f"SELECT id_A, id_B, row_number() OVER (ORDER BY {ORDER}) AS position FROM {ALL}",
    "label_distribution": "SELECT label, count(*) AS n_rows FROM train GROUP BY 1",
    "first_per_id": f"SELECT id, prob FROM (SELECT {trim('id_A')} AS id, prob, row_number() OVER (PARTITION BY {trim('id_A')} ORDER BY prob DESC NULLS LAST, id_B NULLS LAST) AS n FROM test_candidates WHERE id_A IS NOT NULL) WHERE n = 1",
    "block_b1": f"SELECT id_A, id_B, label FROM {pairs('test')} WHERE {b1()}",
    "block_b2": f"SELECT id_A, id_B, label FROM {pairs('test')} WHERE {b2()}",
    "block_stats": _union([stats("B1", b1()), stats("B2", b2())]),
    "block_value_pairs": f"WITH k AS (SELECT DISTINCT {YEAR.format('year')} AS y, {FORM.format('manufacturer')} AS m FROM {M} WHERE {YEAR.format('year')} <> '') SELECT a.y, a.m AS ma, b.m AS mb FROM k a JOIN k b ON a.y = b.y AND substr(a.m, 1, 3) = substr(b.m, 1, 3) AND a.m < b.m WHERE jaro_winkler_similarity(a.m, b.m) >= 0.95",
    "jaro_winkler_values": "SELECT model_A, model_B, round(jaro_winkler_similarity(model_A, model_B), 6) AS similarity FROM (SELECT DISTINCT model_A, model_B FROM train WHERE model_A IS NOT NULL AND model_B IS NOT NULL)",
    "features_lr": f"SELECT id_A, id_B, label, {LOGISTIC_SQL} FROM {pairs('train')}",
    "features_from_records": f"SELECT id_A, id_B, label, {LOGISTIC_SQL} FROM (SELECT p.id_A, p.id_B, p.label, {', '.join(f'a.{c} AS {c}_A, b.{c} AS {c}_B' for c in [*SIMILAR, *EXACT, *GAUSS])} FROM {ALL} p JOIN {CLEANED} a ON p.id_A = a.rec_id JOIN {CLEANED} b ON p.id_B = b.rec_id)",
    "matcher_records": f"SELECT rec_id, {', '.join(record_form(c) for c in [*STRINGS, *RATIOS, *VOCABULARIES])} FROM (SELECT DISTINCT {REC} AS rec_id, {', '.join([*STRINGS, *RATIOS, *VOCABULARIES])} FROM {M}) WHERE rec_id IN (SELECT id_A FROM {ALL} UNION SELECT id_B FROM {ALL})",
    "features_distance": f"SELECT id_A, id_B, label, {distances()} FROM {pairs('train')}",
    "threshold_sweep": SWEEP,
    "best_threshold": f"SELECT threshold, f1 FROM ({SWEEP}) ORDER BY coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) DESC, threshold LIMIT 1",
    "score_classes": "SELECT (prob >= 0.6)::INT AS pred, label, count(*) AS n_pairs FROM test_candidates WHERE prob IS NOT NULL GROUP BY 1, 2",
    "global_predictions": GLOBAL,
    "confusion": f"SELECT *, {SCORES} FROM (SELECT {COUNTS} FROM ({GLOBAL}))",
    "candidate_metrics": f"SELECT *, {SCORES} FROM (SELECT {COUNTS} FROM test_candidates WHERE label IS NOT NULL AND pred IS NOT NULL)",
    "serialize_record": _union(f"SELECT '{s}' AS part, id_A, id_B, md5({serialized('A')}) AS a_md5, md5({serialized('B')}) AS b_md5 FROM {pairs(s)}" for s in ("train", "val", "test")),
    "pair_lines": _union(
        f"SELECT '{n}' AS part, md5(concat_ws(chr(9), {serialized('A')}, {serialized('B')}, CASE WHEN label IN (0, 1) THEN label::VARCHAR ELSE '0' END)) AS line_md5 FROM {pairs(s)} WHERE {cond}"
        for n, s, cond in (("train", "train", "TRUE"), ("val", "val", "TRUE"), ("test", "test", "TRUE"), ("B1", "test", b1()), ("B2", "test", b2()))
    ),
    "semi_ids": f"SELECT DISTINCT {REC} AS rec_id FROM {M} WHERE {REC} IN (SELECT {trim('id_A')} FROM test)",
    "anti_ids": f"SELECT DISTINCT {REC} AS rec_id FROM {M} WHERE {REC} NOT IN ({UNION_IDS})",
    "id_union": UNION_IDS,
    "pair_lookup": f"SELECT x.id_A, x.id_B, a.price AS price_A, b.price AS price_B FROM (SELECT DISTINCT {trim('id_A')} AS id_A, {trim('id_B')} AS id_B FROM test_candidates) x JOIN (SELECT DISTINCT {REC} AS r, price FROM {M}) a ON x.id_A = a.r JOIN (SELECT DISTINCT {REC} AS r, price FROM {M}) b ON x.id_B = b.r",
}

_OFFSETS = "CASE upper(z) WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'EST' THEN -5 WHEN 'EDT' THEN -4 WHEN 'CST' THEN -6 WHEN 'CDT' THEN -5 WHEN 'MST' THEN -7 WHEN 'MDT' THEN -6 WHEN 'PST' THEN -8 WHEN 'PDT' THEN -7 END * 3600"
_FORMATS = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y %I:%M %p", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%y %H:%M", "%d.%m.%Y %H:%M", "%a, %d %b %Y %H:%M:%S", "%d %b %Y %H:%M", "%Y%m%dT%H%M%S", "%B %d, %Y %I:%M:%S %p"]
_TAIL = r"(?:\s*)(Z|UTC|[A-Z][DS]T|[+-][0-9]{2}:?[0-9]{2}|America/[A-Za-z_]+)$"
#: raw, loc, utc_second of every date and place of a table: the zone is cut off, the rest is tried in all formats.
INSTANTS = rf"""SELECT DISTINCT raw, loc, CASE WHEN regexp_matches(v, '^[0-9]{{{{10}}}}$') THEN v::BIGINT WHEN regexp_matches(v, '^[0-9]{{{{13}}}}$') THEN v::BIGINT // 1000
    WHEN z LIKE '+%' OR z LIKE '-%' THEN s - (CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (substr(replace(z, ':', ''), 2, 2)::INT * 3600 + substr(replace(z, ':', ''), 4, 2)::INT * 60)
    WHEN z <> '' AND z NOT LIKE '%/%' THEN s - {_OFFSETS}
    WHEN timezone(zone, timezone(zone, l) - INTERVAL 1 HOUR) = l THEN epoch_us(timezone(zone, l)) // 1000000 - 3600
    WHEN timezone(zone, timezone(zone, l)) = l THEN epoch_us(timezone(zone, l)) // 1000000 END AS utc_second
  FROM (SELECT *, epoch_us(l) // 1000000 AS s, CASE WHEN z LIKE '%/%' THEN z ELSE zone_name END AS zone FROM (
    SELECT *, coalesce({', '.join(f"try_strptime(body, '{f}')" for f in _FORMATS)}) AS l FROM (
      SELECT *, CASE WHEN z = '' THEN v ELSE trim(left(v, length(v) - length(z))) END AS body FROM (
        SELECT raw, loc, v, CASE WHEN regexp_matches(v, '^[0-9]{{{{4}}}}-[0-9]{{{{2}}}}-[0-9]{{{{2}}}}$') THEN '' ELSE regexp_extract(v, '{_TAIL.replace('{', '{{').replace('}', '}}')}', 1) END AS z, zone_name FROM (
          SELECT DISTINCT pubblication_date AS raw, location AS loc, regexp_replace(trim(pubblication_date), '(:[0-9]{{{{2}}}})\.[0-9]+', '\1') AS v FROM {{0}} WHERE pubblication_date IS NOT NULL)
        LEFT JOIN location_zones ON loc = location))))"""
ORACLE["p6_found"] = f"SELECT DISTINCT {REC} AS rec_id, utc_second FROM {M} m JOIN ({INSTANTS.format(M)}) i ON m.pubblication_date = i.raw AND m.location IS NOT DISTINCT FROM i.loc WHERE utc_second IS NOT NULL"
ORACLE["latest_first"] = f"""SELECT vin, rec_id FROM (SELECT vin, rec_id, row_number() OVER (PARTITION BY vin ORDER BY utc_second DESC NULLS LAST, rec_id) AS n
  FROM (SELECT c.vin, c.rec_id, i.utc_second FROM {CLEANED} c LEFT JOIN ({INSTANTS.format('cleaned_dataset')}) i ON c.pubblication_date = i.raw AND c.location IS NOT DISTINCT FROM i.loc)) WHERE n = 1"""
_DIFFER = "list_sum(list_transform(range(1, " + str(len(COMPARED) + 1) + "), lambda k: (r.w[k] IS DISTINCT FROM y[k])::INT))"
ORACLE["leader_dedup"] = f"""WITH RECURSIVE i AS MATERIALIZED ({INSTANTS.format(M).replace("LEFT JOIN location_zones ON loc = location", "CROSS JOIN (SELECT 'UTC' AS zone_name)")}),
  c AS (SELECT *, vin AS v FROM (SELECT DISTINCT * REPLACE ({VIN} AS vin) FROM {M} WHERE vin IS NOT NULL)),
  r AS MATERIALIZED (SELECT {REC} AS rec_id, vin, [{', '.join(f'{c}::VARCHAR' for c in COMPARED)}] AS w, row_number() OVER (PARTITION BY vin ORDER BY utc_second DESC NULLS LAST, {REC}) AS n
    FROM c LEFT JOIN i ON pubblication_date = raw AND location IS NOT DISTINCT FROM loc WHERE {LEGAL} AND NOT {PLACEHOLDER} AND {CHECK}),
  s AS (SELECT vin, n, rec_id, [w] AS leaders, TRUE AS lead FROM r WHERE n = 1
    UNION ALL SELECT vin, n, rec_id, CASE WHEN lead THEN list_append(leaders, w) ELSE leaders END, lead
    FROM (SELECT r.vin, r.n, r.rec_id, r.w, s.leaders, len(list_filter(s.leaders, lambda y: {_DIFFER} <= 3)) = 0 AS lead FROM s JOIN r ON r.vin = s.vin AND r.n = s.n + 1))
  SELECT rec_id, vin FROM s WHERE lead"""
