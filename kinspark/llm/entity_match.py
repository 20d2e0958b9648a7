"""Problem 4: one car in two sources without a key, by loopy belief propagation.

1. Fields become comparable: names and colours are resolved against the reference list (see
   ``canonical``), wordings of both sources are brought together.
2. Records meet in blocks of two or three agreeing fields (place, model, mileage, position,
   price, VIN), so that no missing or mistyped field hides a pair; pairs that contradict each
   other in more than ``WRONG`` fields go where the block is read. Blocks of more than
   ``most`` rows are split into cells.
3. Each field of a pair has a level: unknown, or how far both agree. What a level says is
   learned by expectation maximisation over all pairs of records: candidates by how alike they are,
   the others, which are no matches, through the counts of each level among all pairs, which follow
   from the counts of the values. How matches agree in the other fields is learned from those of
   equal VIN, if there are ``SURE`` or more: chance pairs, whose fields agree together, grow as the
   square of the records and would pass for matches. For equal places, models and makes the rarity of the value takes
   the place of its chance among the others. A pair's log-odds in bits are the sum and
   what the share of matches among all pairs is worth.
4. Listings of one source that match each other with near certainty are one unit; units
   are what the one-to-one factors hold for, so a car may have several listings.
5. Belief propagation over the candidate pairs of units: each pair is a yes/no variable with
   its log-odds, each unit a factor that allows at most one yes. Messages are exchanged
   through aggregations and joins until they settle; the marginal of each pair is its
   confidence. Pairs that nobody contests keep their own odds and take no part.

Null fields say nothing either way; of several rows with one id the smallest code of each
field counts; an empty table gives an empty result; other columns are ignored. Messages that have
not settled after ``rounds`` exchanges raise an error.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vin import usable
from ..operators.stage import Stage
from .canonical import MAX_REFERENCE, Resolver
from .cells import spread
from .components import connected_groups

# Wordings of one source that the other writes differently.
BODIES = {"suv crossover": "suv", "minivan": "van", "pickup truck": "pickup"}
NAMES = ["manufacturer", "model", "main_color"]
# Steps between the levels of numbers; what a level is worth is learned.
DEGREES = (0.003, 0.009, 0.03, 0.2)
MILES = ((0, 0.0), (100, 0.002), (600, 0.018), (2000, 0.05))  # and a share of the larger one
PRICES = (0.02, 0.05, 0.1, 0.25)  # shares of the larger one
YEARS = 2
WRONG = 1
EVERY = 8  # block sizes are estimated from one record in so many
ROUNDS_EM = 15
SURE = 1000  # expected matches of equal VIN from which the levels of a field are learned; with fewer, from all
HEAVY = 0.0005


def _resolved(fields: dict[str, list], make_of: dict[int, int]):
    """Names to their references; a make that is missing is that of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolvers = [Resolver(fields.get(f, [])) for f in NAMES]
        literal: list[dict[str | None, int]] = [{None: 0} | {c: ref for ref, c, _ in fields.get(f, [])} for f in NAMES]
        known = [dict(x) for x in literal]
        for b in batches:
            out = []
            for k, resolver in enumerate(resolvers):
                memo, col = known[k], []
                if len(memo) > 300_000:
                    memo.clear()
                    memo.update(literal[k])
                for v in b.column(k).to_pylist():
                    ref = memo.get(v)
                    if ref is None:
                        ref = memo[v] = resolver.resolve(v)
                    col.append(ref)
                out.append(col)
            out[0] = [make or make_of.get(model, 0) for make, model in zip(out[0], out[1])]
            out = [pa.array(col, pa.int64()) for col in out]
            yield pa.RecordBatch.from_arrays([*out, *b.columns[len(NAMES) :]], names=[*NAMES, *b.schema.names[len(NAMES) :]])

    return run


def _comparable(records: DataFrame, reference: DataFrame) -> DataFrame:
    """The fields to compare, small and coded; 0 or null where there is nothing to compare."""
    parent = F.col("parent_name") if "parent_name" in reference.columns else F.lit(None).cast("string")
    rows = reference.where(F.col("canonical").isNotNull()).select("field_name", "ref_id", "canonical", "aliases", parent.alias("parent")).limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} rows")
    fields = defaultdict(list)
    for r in rows:
        fields[r["field_name"]].append((r["ref_id"], r["canonical"], [a.strip() for a in (r["aliases"] or "").split(";") if a.strip()]))
    makes = {r["canonical"]: r["ref_id"] for r in rows if r["field_name"] == "manufacturer"}
    make_of = {r["ref_id"]: makes[r["parent"]] for r in rows if r["field_name"] == "model" and r["parent"] in makes}
    code = lambda c: F.when(F.trim(c) != "", F.xxhash64(c))
    small = lambda c: F.when(F.trim(c) != "", F.hash(c))
    body = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BODIES.items() for x in kv]), F.col("body_type")), F.col("body_type"))
    r = records.withColumn("_vin", usable(F.col("vin"))).select(
        *NAMES, F.coalesce("id_source_vehicles", "id_source_used_cars").alias("rec"), F.col("id_source_vehicles").isNull().alias("second"),
        code(F.col("location")).alias("loc"), F.col("year").try_cast("int").alias("year"), F.when(F.col("mileage") >= 0, F.col("mileage").try_cast("int")).alias("miles"),
        F.when(F.col("price").between(100, 1_000_000), F.col("price").cast("float")).alias("price"),
        F.when(F.col("longitude").isNotNull(), F.col("latitude").cast("float")).alias("lat"), F.when(F.col("latitude").isNotNull(), F.col("longitude").cast("float")).alias("lon"),
        F.regexp_extract("cylinders", r"(\d+)", 1).try_cast("int").alias("cyl"), small(body).alias("body"), small(F.col("transmission")).alias("gear"),
        small(F.col("traction")).alias("drive"), small(F.col("fuel_type")).alias("fuel"), F.when(F.col("_vin").isNotNull(), F.xxhash64("_vin")).alias("vin"),
    ).where(F.col("rec").isNotNull())
    schema = "manufacturer long, model long, main_color long, " + ", ".join(f"{c} {t}" for c, t in r.dtypes[len(NAMES) :])
    small = ["cast(manufacturer as int) as make", "cast(model as int) as model", "cast(main_color as int) as color"]
    coded = r.mapInArrow(_resolved(dict(fields), make_of), schema).selectExpr(*small, *r.columns[len(NAMES) :])
    return coded.groupBy("rec").agg(*[F.min(c).alias(c) for c in coded.columns if c != "rec"])


def _rarity(stage: Stage, r: DataFrame) -> DataFrame:
    """``r`` with the bits of its place, model and make: their shares among all records, down to HEAVY."""
    n = max(r.count(), 1)
    for c, bits in (("loc", "loc_bits"), ("model", "model_bits"), ("make", "make_bits")):
        share = r.where(F.col(c).isNotNull()).groupBy(c).agg((F.count("*") / F.lit(n)).alias("share")).where(F.col("share") >= HEAVY)  # at most 1 / HEAVY rows
        known = share.select(c, (-F.log2("share")).cast("float").alias(bits))
        r = r.join(F.broadcast(known), c, "left").withColumn(bits, F.coalesce(bits, F.lit(-math.log2(HEAVY)).cast("float")))
    return r


def _cells(x: Column, tolerance: float, width: float) -> Column:
    """The one or two cells that the interval of ``tolerance`` around x touches; null gives null."""
    low, high = F.floor((x - tolerance / 2) / width), F.floor((x + tolerance / 2) / width)
    return F.when(x.isNotNull(), F.array_distinct(F.array(low, high)))


#: Bits of the codes that a block compares at once: a field's code, 0 if unknown, and its width.
PACKED = {"loc": 14, "make": 8, "model": 12, "color": 6, "cyl": 4, "body": 6, "gear": 5, "drive": 5}


def _packed(r: DataFrame) -> DataFrame:
    """``r`` with ``codes`` (all PACKED fields side by side) and ``known`` (ones where a field is known)."""
    codes, known, at = F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), 0
    for c, width in PACKED.items():
        there = F.col(c).isNotNull() & (F.col(c) != 0)
        code = F.pmod(F.col(c).cast("bigint"), F.lit(1 << width))
        codes = codes.bitwiseOR(F.when(there, F.shiftleft(code, at)).otherwise(F.lit(0).cast("bigint")))
        known = known.bitwiseOR(F.when(there, F.lit(((1 << width) - 1) << at)).otherwise(F.lit(0)).cast("bigint"))
        at += width
    return r.withColumns({"codes": codes, "known": known})


def _blocks(r: DataFrame) -> DataFrame:
    """key, id, codes, known, year, miles: each record once per block that it stands in; 0 and -1 for an unknown year and mileage."""
    miles = F.log(F.col("miles") + F.lit(30_000))
    r = _packed(r).withColumns({"_m": _cells(miles, 0.0205, 0.08), "_x": _cells(F.col("lat"), DEGREES[1], 0.05), "_y": _cells(F.col("lon"), DEGREES[1], 0.05), "_p": _cells(F.log("price"), 0.085, 0.25)})
    key = lambda tag, *parts: F.xxhash64(F.lit(tag), *parts)
    named, placed = F.col("model") > 0, F.col("loc").isNotNull()
    r = r.withColumn("_g", F.flatten(F.transform("_x", lambda x: F.transform("_y", lambda y: F.xxhash64(x, y)))))
    made = F.col("make") > 0
    by = [
        F.when(made & placed, F.transform("_m", lambda m: key(1, F.col("make"), F.col("loc"), m))),
        F.flatten(F.transform("_m", lambda m: F.transform("_g", lambda g: key(2, m, g)))),
        F.when(made, F.transform("_g", lambda g: key(3, F.col("make"), g))),
        F.when(named & F.col("miles").isNotNull(), F.array(key(4, F.col("model"), F.col("miles")))),
        F.when(F.col("vin").isNotNull(), F.array(key(5, F.col("vin")))),
        F.when(made & placed, F.transform("_p", lambda p: key(6, F.col("make"), F.col("loc"), p))),
        F.when(named & F.col("year").isNotNull(), F.flatten(F.transform("_m", lambda m: F.array(*[key(7, F.col("model"), F.col("year") + d, m) for d in (0, 1)])))),
    ]
    none = F.array().cast("array<bigint>")
    year, seen = F.coalesce(F.col("year"), F.lit(0)).alias("year"), F.coalesce(F.col("miles"), F.lit(-1)).alias("miles")
    return r.select(F.explode(F.flatten(F.array(*[F.coalesce(b, none) for b in by]))).alias("key"), "id", "codes", "known", year, seen)


def _cells_of(blocks: DataFrame, some: DataFrame, most: int, scale: int) -> DataFrame:
    """``blocks`` in cells of at most about twice ``most`` rows, ready for ``_meet``; ``some``: one in ``scale`` of their rows."""
    return spread(blocks, "key", "id", most, some.select("key"), scale).select("key", "id", "codes", "known", "year", "miles", "part").repartition("key").sortWithinPartitions("key")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the pairs of each block that contradict each other in at most ``WRONG`` of the codes, the year and the mileage."""
    held: list[np.ndarray] | None = None
    ends = np.cumsum([0, *PACKED.values()]).tolist()
    masks = [(1 << e) - (1 << s) for s, e in zip(ends, ends[1:])]
    miles_most, miles_share = MILES[2]
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(7)]
        if not len(cols[0]):
            continue
        old = 0
        if held is not None and held[0][-1] == cols[0][0]:
            old = len(held[0])
            cols = [np.concatenate(x) for x in zip(held, cols)]
        key, ids, codes, known, year, miles, part = cols
        i = np.arange(len(key) - 1)
        d = 1
        while True:
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            if not len(i):
                break
            a = i[i + d >= old]
            b = a + d
            ok = ((part[a] == 0) | (part[a] != part[b])) & (ids[a] != ids[b])
            a, b = a[ok], b[ok]
            wrong = ((np.abs(year[a] - year[b]) > YEARS) & (year[a] != 0) & (year[b] != 0)).astype(np.int64)
            far = np.abs(miles[a] - miles[b]) > miles_most + miles_share * np.maximum(miles[a], miles[b])
            wrong += far & (miles[a] >= 0) & (miles[b] >= 0)
            ok = wrong <= WRONG
            a, b, wrong = a[ok], b[ok], wrong[ok]
            differ = (codes[a] ^ codes[b]) & known[a] & known[b]
            for mask in masks:
                wrong += differ & mask != 0
            a, b = ids[a[wrong <= WRONG]], ids[b[wrong <= WRONG]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["i", "j"])
            d += 1
        start = np.searchsorted(key, key[-1])
        held = [c[start:].copy() for c in cols]


def _steps(x: Column, limits: list) -> Column:
    """1 up to the first limit, 2 up to the second, ..., one more beyond the last; 0 for null."""
    out = F.when(x.isNull(), 0)
    for k, limit in enumerate(limits, 1):
        out = out.when(x <= limit, k)
    return out.otherwise(len(limits) + 1)


def _levels() -> dict[str, Column]:
    """The level of each field in the rows a and b: 0 if either lacks it."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    there = lambda c: F.when(a(c) != 0, a(c) == b(c)) if c in ("make", "model", "color") else a(c) == b(c)  # noqa: E731  a reference of 0 is unknown
    both = lambda c: F.when((b(c) != 0) if c in ("make", "model", "color") else F.lit(True), there(c))
    same = lambda c: F.when(both(c).isNull(), 0).when(both(c), 1).otherwise(2)
    of_larger = lambda c: F.abs(a(c) - b(c)) / F.greatest(a(c), b(c))
    miles, larger = F.abs(a("miles") - b("miles")), F.greatest(a("miles"), b("miles"))
    degrees = F.when(a("lat").isNotNull() & b("lat").isNotNull(), F.greatest(F.abs(a("lat") - b("lat")), F.abs(a("lon") - b("lon"))))
    near = F.when(a("miles").isNull() | b("miles").isNull(), 0)
    for k, (most, share) in enumerate(MILES, 1):
        near = near.when(miles <= most + share * larger, k)
    out = {c: same(c) for c in ("loc", "cyl", "body", "gear", "drive", "fuel", "color", "vin")}
    out["name"] = F.when(same("model") > 0, same("model")).when(same("make") > 0, same("make") + 2).otherwise(0)
    out |= {"year": _steps(F.abs(a("year") - b("year")), [0, 1, YEARS]), "miles": near.otherwise(len(MILES) + 1), "price": _steps(F.when(a("price").isNotNull() & b("price").isNotNull(), of_larger("price")), PRICES), "place": _steps(degrees, DEGREES)}
    return out


#: The fields that ``_levels`` compares.
COMPARED = ("loc", "cyl", "body", "gear", "drive", "fuel", "color", "vin", "name", "year", "miles", "price", "place")
#: Levels of a field that share out what is known of it; a model or, without one, a make.
GROUPS = {"name": [(1, 2), (3, 4)]}
#: Levels whose frequency among random pairs is that of the value at hand.
RARE = {("loc", 1): "loc_bits", ("name", 1): "model_bits", ("name", 3): "make_bits"}
LEVELS = 6


def _shares(counts: np.ndarray, field: str, little: float) -> np.ndarray:
    """Counts of levels to shares of what is known; levels that never come get a ``little``."""
    out = np.ones(LEVELS)
    for group in GROUPS.get(field, [tuple(range(1, LEVELS))]):
        of = counts[list(group)] + little
        out[list(group)] = of / of.sum()
    return out


def _surest(field: str, same_vin: np.ndarray, matched: np.ndarray) -> np.ndarray:
    """Counts of levels among the matches of equal VIN where there are enough, else among all."""
    out = matched.copy()
    for group in GROUPS.get(field, [tuple(range(1, LEVELS))]):
        of = list(group)
        if same_vin[of].sum() >= SURE:
            out[of] = same_vin[of]
    return out


def _patterns(compared: DataFrame) -> DataFrame:
    """code, n: how many of the compared pairs are so alike; a code has 3 bits for each level and 4 for each rarity in whole bits."""
    code = F.lit(0).cast("bigint")
    for at, f in enumerate(COMPARED):
        code = code.bitwiseOR(F.shiftleft(F.col(f"l_{f}").cast("bigint"), 3 * at))
    for at, ((f, k), c) in enumerate(RARE.items()):
        code = code.bitwiseOR(F.shiftleft(F.when(F.col(f"l_{f}") == k, F.round(c)).otherwise(0).cast("bigint"), 3 * len(COMPARED) + 4 * at))
    return compared.groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def _matches_at(worth: dict[str, np.ndarray], prior: float):
    """Patterns (code, n) to a row: how many matches are expected among their pairs at each level of each field, and of these how many with equal VINs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(COMPARED), LEVELS))
        for b in batches:
            code, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            levels = [code >> 3 * at & 7 for at in range(len(COMPARED))]
            bits = np.full(len(code), prior)
            for f, level in zip(COMPARED, levels):
                bits += worth[f][level]
            for at in range(len(RARE)):
                bits += code >> 3 * len(COMPARED) + 4 * at & 15
            likely = n / (1 + 2.0 ** -np.clip(bits, -60, 60))
            same_vin = np.where(levels[COMPARED.index("vin")] == 1, likely, 0)
            for at, level in enumerate(levels):
                total[0, at] += np.bincount(level, likely, LEVELS)
                total[1, at] += np.bincount(level, same_vin, LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["total"])

    return run


def _learn(patterns: DataFrame, chance: dict[str, np.ndarray], n: int) -> tuple[dict[str, np.ndarray], float]:
    """Bits that each level of each field is worth, for RARE levels without the rarity, and those of a pair of which nothing is known.

    Expectation maximisation over all pairs of the ``n`` records: ``patterns`` are those of the candidates, ``chance`` counts
    the levels of all pairs; pairs that are no candidates aren't matches.
    """
    pairs, prior = max(n * (n - 1) / 2, 1), -math.log2(max(n, 2))
    match = {f: _shares(np.array([0, 0.9, 0.1, 0.05, 0.02, 0.02]), f, 0) for f in COMPARED}
    matched = {f: np.zeros(LEVELS) for f in COMPARED}

    def worth() -> dict[str, np.ndarray]:
        out = {}
        for f in COMPARED:
            random = _shares(np.maximum(chance[f] - matched[f], 0), f, 0.5)
            for g, k in RARE:
                if g == f:
                    random[k] = 1.0  # the rarity comes on top
            out[f] = np.log2(match[f] / random)
            out[f][0] = 0
        return out

    for _ in range(ROUNDS_EM):
        rows = patterns.mapInArrow(_matches_at(worth(), prior), "total array<double>").collect()
        total = np.sum([r["total"] for r in rows], axis=0).reshape(2, len(COMPARED), LEVELS) if rows else np.zeros((2, len(COMPARED), LEVELS))
        matched, same_vin = (dict(zip(COMPARED, x)) for x in total)
        match = {f: _shares(matched[f] if f == "vin" else _surest(f, same_vin[f], matched[f]), f, 0.1) for f in COMPARED}
        prior = math.log2((matched[COMPARED[0]].sum() + 0.5) / pairs)
    return worth(), prior


def _near(x: np.ndarray, y: np.ndarray, n: np.ndarray, own: np.ndarray, reach: float) -> float:
    """Points (x, y), ``n`` of each, within ``reach`` of the points that are ``own``: the sum over these, themselves included."""
    order = np.argsort(x, kind="stable")
    x, y, n, own = x[order], y[order], n[order], own[order]
    ys = np.sort(y)
    code, weight, times = np.searchsorted(ys, y), n, n[own]
    total = 0.0
    left, right = np.searchsorted(x, x[own] - reach), np.searchsorted(x, x[own] + reach, side="right")
    below = [np.searchsorted(ys, y[own] + reach, side="right"), np.searchsorted(ys, y[own] - reach)]
    ends = [(left, right), (left, right)]
    for bit in range(len(x).bit_length() - 1, -1, -1):  # a wavelet matrix over the ranks of y, of which only one level is held
        one = code >> bit & 1 == 1
        zeros, held = np.r_[0, np.cumsum(~one)], np.r_[0, np.cumsum(np.where(one, 0, weight))]
        for k, (rank, (s, e)) in enumerate(zip(below, ends)):
            up = rank >> bit & 1 == 1
            total += (1 - 2 * k) * float((times * (held[e] - held[s]))[up].sum())
            ends[k] = tuple(np.where(up, zeros[-1] + z - zeros[z], zeros[z]) for z in (s, e))
        code, weight = np.r_[code[~one], code[one]], np.r_[weight[~one], weight[one]]
    return total


#: For the numbers: what is added before the logarithm and the base (else the width) of ranges of which one and the next hold all values near a value.
RANGES = {"year": (None, YEARS), "miles": (MILES[-1][0] / MILES[-1][1], 1 - MILES[-1][1]), "price": (0, 1 - PRICES[-1])}


def _reach(field: str, x: np.ndarray) -> list[np.ndarray]:
    """How far below x a value may be for each level."""
    if field == "year":
        return [np.full(len(x), d) for d in range(YEARS + 1)]
    return [most + share * x for most, share in MILES] if field == "miles" else [share * x for share in PRICES]


def _near_values(key: tuple, rows: pa.Table) -> pa.Table:
    """field, level, n: pairs up to each level that have their larger value in this range."""
    x, n, own = (rows.column(c).to_numpy() for c in ("x", "n", "own"))
    order = np.argsort(x, kind="stable")
    x, n, own = x[order], n[order], own[order]
    up_to, mine, times = np.r_[0, np.cumsum(n)], x[own], n[own].astype(float)
    first = up_to[np.searchsorted(x, mine)]
    field = key[0].as_py()
    pairs = [float((times * (first - up_to[np.searchsorted(x, mine - reach)]) + times * (times - 1) / 2).sum()) for reach in _reach(field, mine)]
    return pa.table({"field": [field] * len(pairs), "level": pa.array(range(1, len(pairs) + 1), pa.int32()), "n": pairs})


def _near_places(key: tuple, rows: pa.Table) -> pa.Table:
    x, y, n, own = (rows.column(c).to_numpy() for c in ("lat", "lon", "n", "own"))
    pairs = [(_near(x, y, n, own, d) - float(n[own].sum())) / 2 for d in DEGREES]
    return pa.table({"field": ["place"] * len(pairs), "level": pa.array(range(1, len(pairs) + 1), pa.int32()), "n": pairs})


def _by_chance(coded: DataFrame) -> dict[str, np.ndarray]:
    """How many of all pairs of records stand at each level of each field, counted from the values of all records."""
    two = lambda n: n * (n - 1) / 2
    named = F.col("model") != 0
    codes = {c: F.col(c) for c in ("loc", "cyl", "body", "gear", "drive", "fuel", "vin")} | {c: F.when(F.col(c) != 0, F.col(c)) for c in ("color", "model", "make")}
    codes["made"] = F.when(named, codes["make"])  # of records that have a model too
    values = coded.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), c.cast("bigint").alias("v")) for f, c in codes.items()]))).where("v is not null")
    n = F.col("n").cast("double")
    each = values.groupBy("field", "v").agg(F.count("*").alias("n")).groupBy("field").agg(F.sum(n * (n - 1) / 2).alias("same"), F.sum("n").alias("known"))
    found = {r["field"]: (r["same"], two(r["known"])) for r in each.collect()}
    get = lambda f: np.array(found.get(f, (0.0, 0.0)))
    out = {f: np.zeros(LEVELS) for f in COMPARED}
    for f in COMPARED:
        if f in codes:
            same, known = get(f)
            out[f][1:3] = same, known - same
    (same, known), (alike, made) = get("model"), get("make") - get("made")
    out["name"][1:5] = same, known - same, alike, made - alike

    numbers = coded.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in RANGES]))).where("x is not null")
    counts = numbers.groupBy("field", "x").agg(F.count("*").alias("n"))
    at = F.lit(None).cast("bigint")
    for f, (more, step) in RANGES.items():
        at = F.when(F.col("field") == f, F.floor(F.col("x") / step) if more is None else F.floor(F.log(F.col("x") + more) / -math.log(step))).otherwise(at)
    ranges = F.inline(F.array(F.struct(at.alias("range"), F.lit(True).alias("own")), F.struct((at + 1).alias("range"), F.lit(False).alias("own"))))
    lines = counts.select("field", "x", "n", ranges).groupBy("field", "range").applyInArrow(_near_values, "field string, level int, n double")
    cell = lambda c: F.explode(_cells(F.col(c).cast("double"), 2.01 * DEGREES[-1], 1.0))
    places = coded.where("lat is not null").groupBy("lat", "lon").agg(F.count("*").alias("n")).select("*", cell("lat").alias("i")).select("*", cell("lon").alias("j"))
    places = places.withColumn("own", (F.floor(F.col("lat").cast("double")) == F.col("i")) & (F.floor(F.col("lon").cast("double")) == F.col("j")))
    places = places.select(F.col("lat").cast("double"), F.col("lon").cast("double"), "n", "own", "i", "j").groupBy("i", "j").applyInArrow(_near_places, "field string, level int, n double")
    known = coded.select(*[F.count(c).alias(c) for c in ("year", "miles", "price", "lat")]).first()
    last = {"year": YEARS + 2, "miles": len(MILES) + 1, "price": len(PRICES) + 1, "place": len(DEGREES) + 1}
    for f, k in last.items():
        out[f][k] = two(known["lat" if f == "place" else f])
    for r in lines.unionByName(places).groupBy("field", "level").agg(F.sum("n").alias("n")).collect():
        out[r["field"]][r["level"]] = r["n"]
    for f, k in last.items():
        out[f][1 : k + 1] = np.diff(np.r_[0, out[f][1 : k + 1]])
    return out


def _propagate(stage: Stage, edges: DataFrame, rounds: int, settle: float) -> DataFrame:
    """u, v, p: marginals of the edges (u, v, w), w natural log-odds, with at most one yes per u and per v."""
    du = edges.groupBy("u").agg(F.count("*").alias("nu"))
    dv = edges.groupBy("v").agg(F.count("*").alias("nv"))
    edges = stage.put(edges.join(du, "u").join(dv, "v"), "edges")
    odds = lambda x: 1 / (1 + F.exp(-x))
    alone = edges.where("nu = 1 and nv = 1").select("u", "v", odds(F.col("w")).alias("p"))
    state = stage.put(edges.where("nu > 1 or nv > 1").select("u", "v", "w", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(1.0).alias("moved")), "state")
    others = lambda total, own: -F.log(1 + F.greatest(total - own, F.lit(0.0)))
    for turn in range(rounds):
        step = 1.0 if turn < 8 else 0.5 if turn < 30 else 0.25  # without loops they settle by whole steps; those that swing, by smaller ones
        to_u, to_v = F.exp(F.least(F.col("w") + F.col("b"), F.lit(30.0))), F.exp(F.least(F.col("w") + F.col("a"), F.lit(30.0)))
        at_u, at_v = state.groupBy("u").agg(F.sum(to_u).alias("su")), state.groupBy("v").agg(F.sum(to_v).alias("sv"))
        to_a, to_b = others(F.col("su"), to_u) - F.col("a"), others(F.col("sv"), to_v) - F.col("b")
        heard = state.join(at_u, "u").join(at_v, "v").select("u", "v", "w", (F.col("a") + step * to_a).alias("a"), (F.col("b") + step * to_b).alias("b"), F.greatest(F.abs(to_a), F.abs(to_b)).alias("moved"))
        after = stage.put(heard, "state")
        stage.drop(state)
        state = after
        if (state.agg(F.max("moved")).first()[0] or 0) < settle:
            return alone.unionByName(state.select("u", "v", odds(F.col("w") + F.col("a") + F.col("b")).alias("p")))
    raise RuntimeError(f"messages have not settled after {rounds} rounds")


def match_sources(
    records: DataFrame, reference: DataFrame, *, same_source: float = 0.95, least: float = 0.02, rounds: int = 100, settle: float = 0.05, most: int = 4000
) -> DataFrame:
    """rec_id_a (first source), rec_id_b (second source), probability of each pair above ``least``."""
    stage = Stage(records.sparkSession)
    coded = stage.put(_comparable(records, reference).withColumn("id", F.monotonically_increasing_id()), "coded")
    n = coded.count()
    some = coded.where(F.pmod(F.xxhash64("id"), F.lit(EVERY)) == 0)
    cells = _cells_of(_blocks(coded), _blocks(some), most, EVERY)
    met = stage.put(cells.mapInArrow(_meet, "i long, j long").distinct(), "met")
    rated = _rarity(stage, coded)
    pairs = met.join(rated.alias("a"), F.col("i") == F.col("a.id")).join(rated.alias("b"), F.col("j") == F.col("b.id"))
    low = F.col("a.rec") < F.col("b.rec")
    ends = [F.when(low, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(x) for c, x in (("rec", "i"), ("second", "si"))] + [F.when(low, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(x) for c, x in (("rec", "j"), ("second", "sj"))]
    levels = [c.cast("byte").alias(f"l_{f}") for f, c in _levels().items()]
    compared = stage.put(pairs.select(*ends, *levels, *[F.col(f"a.{c}").alias(c) for c in RARE.values()]), "compared")
    stage.drop(met)

    patterns = stage.put(_patterns(compared), "patterns")
    worth, prior = _learn(patterns, _by_chance(coded), n)
    stage.drop(patterns)
    bits = F.lit(prior)
    for f, by_level in worth.items():
        bits = bits + F.element_at(F.array(*[F.lit(float(x)) for x in by_level]), F.col(f"l_{f}").cast("int") + 1)
    for (f, k), c in RARE.items():
        bits = bits + F.when(F.col(f"l_{f}") == k, F.col(c)).otherwise(0.0)
    scored = compared.select("i", "si", "j", "sj", bits.cast("float").alias("bits")).where("bits > -6")

    sure = math.log2(same_source / (1 - same_source))
    units = connected_groups(scored.where((F.col("si") == F.col("sj")) & (F.col("bits") >= sure)).select("i", "j"), "i", "j")
    units = stage.put(units, "units")
    cross = scored.where("si <> sj").select(F.when(F.col("sj"), F.col("i")).otherwise(F.col("j")).alias("x"), F.when(F.col("sj"), F.col("j")).otherwise(F.col("i")).alias("y"), "bits")
    unit_of = lambda end, name: units.select(F.col("rec_id").alias(end), F.col("group_id").alias(name))
    by_unit = cross.join(unit_of("x", "u"), "x", "left").join(unit_of("y", "v"), "y", "left").select(F.coalesce("u", "x").alias("u"), F.coalesce("v", "y").alias("v"), "bits")
    edges = by_unit.groupBy("u", "v").agg((F.max("bits") * math.log(2)).alias("w")).select("u", "v", F.greatest(F.least("w", F.lit(30.0)), F.lit(-30.0)).alias("w"))
    edges = stage.put(edges, "by_unit")  # read three times
    marginals = stage.put(_propagate(stage, edges, rounds, settle).where(F.col("p") >= least), "marginals")
    stage.drop(coded, compared)
    first, second = units.select(F.col("group_id").alias("u"), F.col("rec_id").alias("x")), units.select(F.col("group_id").alias("v"), F.col("rec_id").alias("y"))
    pairs = marginals.join(first, "u", "left").join(second, "v", "left")
    return pairs.select(F.coalesce("x", "u").alias("rec_id_a"), F.coalesce("y", "v").alias("rec_id_b"), F.round("p", 6).alias("probability"))
