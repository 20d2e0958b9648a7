"""SQL for those queries of this subpackage that SQL can express.

Left out, and tested against brute force instead: p3 and p4 (similarities, belief
propagation), p8 (packing; ``p8_checks`` has what must hold of any), p5_coverage, p10 (line labels).
"""

from __future__ import annotations

from ..plans.core_oracle import INSTANTS, M, REC, trim
from ..sources.tables import PAIR_ATTRIBUTES

ACCEPTED = f"SELECT {trim('id_A')} AS a, {trim('id_B')} AS b FROM test_candidates WHERE pred = 1"
LINKS = f"SELECT a, b FROM ({ACCEPTED}) WHERE a <> b UNION SELECT b, a FROM ({ACCEPTED}) WHERE a <> b"

#: Elements (word and how often it came before) of texts with 20 words or more, as sorted lists.
ELEMENTS = """SELECT id, list(hash(w || '#' || k)) AS e, count(*) AS n FROM (
    SELECT id, w, row_number() OVER (PARTITION BY id, w) AS k FROM (SELECT id, unnest(string_split_regex(trim(text), ' +')) AS w FROM {0}) WHERE w <> '') GROUP BY id HAVING count(*) >= 20"""
SHARED = "least(a.n, b.n) * 5 >= greatest(a.n, b.n) * 4 AND len(list_intersect(a.e, b.e)) * 5 >= greatest(a.n, b.n) * 4"
LISTINGS = f"(SELECT DISTINCT {REC} AS id, description AS text FROM {M} WHERE description IS NOT NULL)"
PAIRS = f"WITH d AS MATERIALIZED ({ELEMENTS.format(LISTINGS)}) SELECT a.id AS rec_id_a, b.id AS rec_id_b FROM d a JOIN d b ON a.id < b.id AND {SHARED}"


def ends(split: str) -> str:
    return f"SELECT {trim('id_A')} AS id, description_A AS text FROM {split} UNION SELECT {trim('id_B')}, description_B FROM {split}"


OVERLAPS = f"""WITH t AS MATERIALIZED ({ends('train')}), e AS MATERIALIZED (SELECT 'val' AS split_name, * FROM ({ends('val')}) UNION ALL SELECT 'test', * FROM ({ends('test')})),
  te AS MATERIALIZED ({ELEMENTS.format('(SELECT DISTINCT id, text FROM t WHERE text IS NOT NULL)')}),
  ee AS MATERIALIZED ({ELEMENTS.format('(SELECT DISTINCT id, text FROM e WHERE text IS NOT NULL)')}),
  near AS (SELECT DISTINCT a.id FROM ee a JOIN te b ON {SHARED})
  SELECT DISTINCT split_name, CASE WHEN id LIKE 'S2\\_%' ESCAPE '\\' THEN 'used_cars' ELSE 'vehicles' END AS source_name, id AS rec_id FROM e
  WHERE id <> '' AND (id IN (SELECT id FROM t) OR id IN (SELECT id FROM near))"""

FULL = " + ".join(
    "(coalesce(price BETWEEN 100 AND 1000000, FALSE))::INT" if a == "price" else f"coalesce(({a}::VARCHAR IS NOT NULL AND trim({a}::VARCHAR) <> ''), FALSE)::INT" for a in PAIR_ATTRIBUTES
)
RECORDS = f"SELECT DISTINCT c.vin, c.{{0}} AS rec_id, coalesce(i.utc_second, -1e15::BIGINT) AS t, {FULL} AS f FROM (SELECT DISTINCT *, {REC} AS rec FROM cleaned_dataset) c LEFT JOIN i ON c.pubblication_date IS NOT DISTINCT FROM i.raw AND c.location IS NOT DISTINCT FROM i.loc"
LATEST = f"""WITH i AS MATERIALIZED ({INSTANTS.format('cleaned_dataset')}), r AS MATERIALIZED ({RECORDS.format('rec')})
  SELECT a.vin, a.rec_id FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.vin = a.vin AND b.rec_id <> a.rec_id)
  AND NOT EXISTS (SELECT 1 FROM r b WHERE b.vin = a.vin AND b.rec_id <> a.rec_id AND (b.t >= a.t OR b.f >= a.f))"""

GRAMS = "SELECT id, list_aggregate(w[p : p + 12], 'string_agg', ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 11)) AS p FROM (SELECT {0} AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {1} WHERE text IS NOT NULL))"
LEAKS = f"SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM ({GRAMS.format('doc_id', 'documents')}) a JOIN ({GRAMS.format('item_id', 'eval_items')}) b ON a.g = b.g"

CLASSES = f"""WITH d AS MATERIALIZED ({ELEMENTS.format(LISTINGS)}),
  p AS MATERIALIZED (SELECT a.id AS i, b.id AS j, a.n = b.n AND len(list_intersect(a.e, b.e)) = a.n AS same FROM d a JOIN d b ON a.id < b.id AND {SHARED}),
  l AS (SELECT i, j, same FROM p UNION ALL SELECT j, i, same FROM p)
  SELECT d.id AS rec_id, least(d.id, coalesce(min(j) FILTER (WHERE same), d.id)) AS class_id, count(j) AS n_links FROM d LEFT JOIN l ON d.id = l.i GROUP BY d.id"""
SIMILAR = OVERLAPS.split("SELECT DISTINCT split_name")[0] + """SELECT split_name, CASE WHEN id LIKE 'S2\\_%' ESCAPE '\\' THEN 'used_cars' ELSE 'vehicles' END AS source_name, count(*) AS n_records,
  count(*) FILTER (WHERE known) AS n_same_id, count(*) FILTER (WHERE close) AS n_similar_text
  FROM (SELECT DISTINCT split_name, id, id IN (SELECT id FROM t) AS known, id IN (SELECT id FROM near) AS close FROM e WHERE id <> '') WHERE known OR close GROUP BY 1, 2"""

USABLE = {a: f"coalesce({a} BETWEEN 100 AND 1000000, FALSE)" if a == "price" else f"coalesce({a}::VARCHAR IS NOT NULL AND trim({a}::VARCHAR) <> '', FALSE)" for a in PAIR_ATTRIBUTES}
BEST = ", ".join(f"max({{'ok': {ok}, 't': tm, 'v': CASE WHEN {ok} THEN {a} END, 'id': id}}) AS b_{a}" for a, ok in USABLE.items())
GIVEN = " + ".join(f"(b_{a}.ok AND b_{a}.id = {{0}})::INT" for a in PAIR_ATTRIBUTES)
CARRIED = [a for a in PAIR_ATTRIBUTES if a != "location"]
SURVIVORS = f"""WITH i AS MATERIALIZED ({INSTANTS.format('cleaned_dataset')}),
  r AS MATERIALIZED (SELECT DISTINCT c.vin, c.rec AS id, coalesce(i.utc_second, -(1::BIGINT << 62)) AS tm, {FULL} AS f, {', '.join(f'c.{a}' for a in PAIR_ATTRIBUTES)}
    FROM (SELECT DISTINCT *, {REC} AS rec FROM cleaned_dataset) c LEFT JOIN i ON c.pubblication_date IS NOT DISTINCT FROM i.raw AND c.location IS NOT DISTINCT FROM i.loc),
  g AS (SELECT vin, {BEST}, max({{'by': tm, 'id': id}}) AS l1, min({{'by': -tm, 'id': id}}) AS l2, max({{'by': f, 'id': id}}) AS f1, min({{'by': -f, 'id': id}}) AS f2 FROM r WHERE vin IS NOT NULL AND id IS NOT NULL GROUP BY vin HAVING min(id) <> max(id))
  SELECT vin, {', '.join(f'b_{a}.v AS {a}' for a in PAIR_ATTRIBUTES)}, l1.id AS latest, l1.id = l2.id AS latest_alone, {GIVEN.format('l1.id')} AS n_latest,
  f1.id AS fullest, f1.id = f2.id AS fullest_alone, {GIVEN.format('f1.id')} AS n_fullest, f1.by AS n_full FROM g"""

PLACES = GRAMS.replace("SELECT id, list_aggregate", "SELECT id, p, list_aggregate", 1)
LEAKED_ITEMS = f"""WITH m AS MATERIALIZED (SELECT a.id AS doc_id, b.id AS item_id, a.p, a.p - b.p AS d FROM ({PLACES.format('doc_id', 'documents')}) a JOIN ({PLACES.format('item_id', 'eval_items')}) b ON a.g = b.g),
  r AS (SELECT doc_id, item_id, count(DISTINCT p) + 12 AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY p) AS island FROM m) GROUP BY doc_id, item_id, d, island)
  SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(n)::INT AS longest_words FROM r GROUP BY 1"""

ORACLE: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE l AS MATERIALIZED ({LINKS}), reach(a, b) AS (SELECT a, a FROM l UNION SELECT b, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
      SELECT a AS rec_id, min(b) AS group_id FROM reach GROUP BY 1""",
    "p2_found": PAIRS,
    "p5_found": OVERLAPS,
    "p7_found": LATEST,
    "p9_found": LEAKS,
    "p2_links": CLASSES,
    "p5_report": SIMILAR,
    "p7_survivors": SURVIVORS,
    "p8_checks": "SELECT DISTINCT container_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL) AS n_texts, 0 AS n_torn, 0 AS n_cut_that_fit, 0 AS n_overfull FROM container_sizes WHERE capacity_tokens > 0",
    "p9_items": LEAKED_ITEMS,
}
