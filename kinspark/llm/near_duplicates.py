"""Problem 2: near-duplicate texts, all of them, by bottom-k sketches.

A text is the multiset of its blank-separated words; element (word, i) is the i-th
occurrence of a word, so multisets are sets of elements. Two texts match when both have at
least ``min_words`` words and share at least ``share`` of the longer one's.

1. One hash function gives every element a value; elements whose word is common get values
   in higher bands, the commoner the higher. Any order does for the result; this one keeps the
   lists of step 2 short. Texts with equal multisets (128 bits of a digest) are one class;
   all later steps work on one text per class, so copies cost nothing however many.
2. The sketch of a class with n elements holds its k smallest values, where k is one more
   than the number of elements that a match may lack. Of two texts that match, the smallest
   common value is in both sketches: inverted lists of the retained values miss no pair,
   whatever the words, the size of the corpus or of a family of texts.
3. Lists of more than ``most`` classes are dealt to cells (``cells.spread``). In the list of
   the smallest common value, all values before it are differences; for those behind it each
   row has ``BITS`` parity bits of the same hash: two texts that differ in d elements differ
   in at most d of them. Pairs of fitting lengths for which both together exceed what a match
   may have are dropped.
4. Union sketch: below the smaller of their largest retained values the union of two
   sketches holds all elements of both texts. The elements it shows in only one of them are
   differences; a pair that has more than a match may have is dropped.
5. In pairs that remain, the words of both texts are counted with repeats.

Nulls and texts under ``min_words`` match nothing; repeated rows count once; an empty table
gives an empty result; other columns are ignored. Of texts over about 200 words the parity
bits tell little; the sketches and the count decide there.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stage import Stage
from .batches import slices
from .cells import spread

WORDS, BITS = 3, 192
HEAVY = 0.0005
#: A value is the band of its word (7 bits), the word (32 bits of its hash) and the occurrence (24 bits).
BAND, WORD = 56, 24
SHORT, TILE, WIDE, BROAD = 64, 64, 4096, 0.1
MEMO = 500_000
EVERY = 8  # list sizes are estimated from one class in so many


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        x = self[word] = self.make(word)
        return x


def hash_of(word: str) -> int:
    """63 bits."""
    return xxhash.xxh3_64_intdigest(word) >> 1


class Values:
    """Values and digests of texts, given as lists of words; remembers the words seen, up to a bound.

    Words that share 32 bits of their hash count as one, which lets pairs through but loses none.
    """

    def __init__(self, bands: dict[int, int]):
        self.number = _Memo(xxhash.xxh3_128_intdigest)
        self.value = _Memo(lambda w: bands.get(h := hash_of(w), 0) << BAND | h >> 31 << WORD)

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts, and the values of all their elements, ascending in each text."""
        if len(self.value) > MEMO:
            self.value.clear()
        ends = np.cumsum([0, *map(len, texts)])
        get = self.value.__getitem__
        flat = np.fromiter(itertools.chain.from_iterable(sorted(map(get, t)) for t in texts), np.int64, int(ends[-1]))
        fresh = np.ones(len(flat) + 1, bool)
        fresh[1:-1] = flat[1:] != flat[:-1]
        fresh[ends] = True
        at = np.flatnonzero(fresh)
        return ends, flat + np.arange(len(flat)) - np.repeat(at[:-1], np.diff(at))

    def digest(self, text: list[str]) -> bytes:
        """128 bits for a multiset of words: the sum of their hashes."""
        if len(self.number) > MEMO:
            self.number.clear()
        return (sum(map(self.number.__getitem__, text)) & (1 << 128) - 1).to_bytes(16)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: Counter = Counter()

    def put() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(map(hash_of, count), pa.int64()), pa.array(count.values(), pa.int64())], names=["h", "n"])

    for b in batches:
        words = pc.utf8_split_whitespace(b.column(0).cast(pa.large_string())).flatten().value_counts()
        count.update(dict(zip(words.field(0).to_pylist(), words.field(1).to_pylist())))
        if len(count) > MEMO:
            yield put()
            count.clear()
    yield put()


def word_bands(texts: DataFrame, rare: int = 0) -> tuple[dict[int, int], int]:
    """The bands of the words that come at least ``HEAVY`` times as often as there are ``texts`` (text): hash -> 1 to 127; the band of those that come ``rare`` times.

    At most (mean length / HEAVY) words, whatever the number of texts; all others have band 0.
    """
    least = max(2.0, HEAVY * texts.count())
    counts = texts.select("text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    steps = 126 / math.log2(1 / HEAVY)
    band = lambda n: 1 + min(126, int(steps * math.log2(n / least)))
    return {r["h"]: band(r["n"]) for r in counts.where(F.col("n") >= least).collect()}, band(rare) if rare >= least else 0


def _bits(flat: np.ndarray) -> np.ndarray:
    """The parity bit of each value, 0 to BITS - 1."""
    return (((flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64)


def parity(ends: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """``WORDS`` columns of parity bits, one row for each text: each value flips one bit."""
    n = len(ends) - 1
    odd = np.bincount(np.repeat(np.arange(n), np.diff(ends)) * BITS + _bits(flat), minlength=n * BITS) & 1
    return np.packbits(odd.reshape(n, BITS).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, size, sketch, parity bits) to a row for each retained value: key, cid, size, place, and the parity bits of the elements behind it."""
    for b in batches:
        sketch = b.column(2)
        ends, flat = sketch.offsets.to_numpy().astype(np.int64), sketch.values.to_numpy()
        flat, ends = flat[ends[0] : ends[-1]], ends - ends[0]
        n = np.diff(ends)
        bit, at = _bits(flat), np.repeat(np.arange(len(n)), n)
        columns = []
        for k in range(WORDS):
            own = np.where(bit >> 6 == k, np.uint64(1) << (bit & 63).astype(np.uint64), np.uint64(0))
            so_far = np.bitwise_xor.accumulate(np.r_[np.uint64(0), own])
            before = so_far[1:] ^ so_far[ends[:-1]][at]  # of the text's values up to this one
            columns.append(pa.array((b.column(3 + k).to_numpy().view(np.uint64)[at] ^ before).view(np.int64)))
        place = np.arange(len(flat)) - np.repeat(ends[:-1], n)
        yield pa.RecordBatch.from_arrays([pa.array(flat), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(place.astype(np.int32)), *columns], names=["key", "cid", "size", "place", *PARITY])


def _sketch(min_words: int, top: int, bottom: int, bands: dict[int, int]):
    """(id, text) to digest, id, size, sketch and parity bits of each text with enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Values(bands)
        for b in batches:
            for part in slices(b, 1):
                words = [t.split() for t in part.column(1).to_pylist()]
                enough = pa.array([len(w) >= min_words for w in words], pa.bool_())
                words = [w for w in words if len(w) >= min_words]
                ends, flat = values.of(words)
                size = np.diff(ends)
                kept = size + (-size * top // bottom) + 1
                place = np.arange(len(flat)) - np.repeat(ends[:-1], size)
                sketch = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)].astype(np.int32)), pa.array(flat[place < np.repeat(kept, size)]))
                bits = parity(ends, flat)
                columns = [pa.array(map(values.digest, words), pa.binary()), part.column(0).filter(enough), pa.array(size.astype(np.int32)), sketch]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(WORDS)]], names=["digest", "id", "size", "sketch", *PARITY])

    return run


PARITY = [f"p{k}" for k in range(WORDS)]


class Classes:
    """``members`` (cid, id) of the usable texts; ``classes``: cid, digest, rep (an id that holds the text) and ``columns``. Both written.

    ``make`` turns batches (id, text) into digest, id and ``columns``, which depend on the multiset of words alone.
    """

    def __init__(self, texts: DataFrame, stage: Stage, make, columns: dict[str, str]):
        self.texts = texts
        schema = ", ".join(["digest binary", f"id {dict(texts.dtypes)['id']}", *(f"{c} {kind}" for c, kind in columns.items())])
        rows = stage.put(texts.mapInArrow(make, schema), "rows")
        one = rows.groupBy("digest").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in columns])
        self.classes = stage.put(one.withColumn("cid", F.monotonically_increasing_id()), "classes")
        self.members = stage.put(rows.select("digest", "id").distinct().join(self.classes.select("digest", "cid"), "digest").select("cid", "id"), "members")
        stage.drop(rows)

    def texts_of(self, cids: DataFrame, *columns: str) -> DataFrame:
        """cid, ``columns`` and text of the classes in ``cids`` (cid)."""
        wanted = self.classes.join(cids, "cid", "left_semi").select("cid", F.col("rep").alias("id"), "digest", *columns)
        held = self.texts.join(wanted, "id").select("digest", "text", "cid", *columns)
        kinds = ", ".join(f"{c} {k}" for c, k in held.dtypes[1:])
        return held.mapInArrow(_with_digest, kinds).dropDuplicates(["cid"])


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, text, ...) whose text has the digest, which goes: an id may hold other texts too."""
    values = Values({})
    for b in batches:
        same = [values.digest(t.split()) == d for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield b.select(range(1, b.num_columns)).filter(pa.array(same, pa.bool_()))


def usable(texts: DataFrame) -> DataFrame:
    return texts.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", "text")


class Lists:
    """Rows of inverted lists, sorted by key: pairs of positions that may match.

    Columns: key, cid, parity bits, and size, place (of the common value in the sketch) and part in one number.
    """

    def __init__(self, top: int, bottom: int):
        self.top, self.bottom = top, bottom

    @functools.cached_property
    def room(self) -> tuple[np.ndarray, ...]:
        """Room for the numbers of a tile, used again for each."""
        return tuple(np.empty(TILE * WIDE, t) for t in (np.uint64, np.uint8, np.uint8, np.bool_))

    def fit(self, rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) may match, by lengths, what is left from their places on, parts and parity bits."""
        _, cid, size, place, part = rows[:5]
        need = -(-np.maximum(size[i], size[j]) * self.top // self.bottom)
        most = size[i] + size[j] - 2 * need
        differ = sum(np.bitwise_count((b[i] ^ b[j]).view(np.uint64)).astype(np.int64) for b in rows[5:])
        return (np.minimum(size[i] - place[i], size[j] - place[j]) >= need) & (differ + place[i] + place[j] <= most) & ((part[i] == 0) | (part[i] != part[j])) & (cid[i] != cid[j])

    def short(self, rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All lists at once, by the distance of two rows in their list."""
        key = rows[0]
        i = np.arange(len(key) - 1)
        d = 1
        while True:
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            if not len(i):
                return
            ok = self.fit(rows, i, i + d)
            yield i[ok], i[ok] + d
            d += 1

    def long(self, rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One list, in order of length."""
        every = np.arange(len(rows[0]))
        yield from self.tiles(rows, every, every)

    def tiles(self, rows: list[np.ndarray], mine: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of one list, in order of length: tiles of the rows ``mine`` against those of ``others`` behind that are no longer than what they have left allows.

        A tile has rows of about one length and place, as rows that come late in their sketch fit few lengths.
        """
        size, place, bits = rows[2], rows[3], [b.view(np.uint64) for b in rows[5:]]  # bits of signed numbers would be counted without their sign
        spare = size - 2 * -(-size * self.top // self.bottom) - place  # plus the shorter length, less its place: elements behind in which a match may differ
        reach = (size - place) * self.bottom // self.top
        order = mine[np.lexsort((reach[mine], (np.log(size[mine]) / BROAD).astype(np.int64)))]
        length, spare, theirs = size[others], spare[others], [b[others] for b in bits[:2]]
        for i in range(0, len(order), TILE):
            tile = order[i : i + TILE]
            largest = int(size[tile].max())
            ahead = np.minimum(place[tile] + largest - size[tile], 255 - 128).astype(np.uint8)[:, None]
            first, second = bits[0][tile, None], bits[1][tile, None]
            last = int(np.searchsorted(length, reach[tile].max(), side="right"))
            for start in range(int(np.searchsorted(others, tile.min())), last, WIDE):
                stop = min(start + WIDE, last)
                shape, cells = (len(tile), stop - start), len(tile) * (stop - start)
                mixed, count, differ, near = (x[:cells].reshape(shape) for x in self.room)
                np.bitwise_xor(first, theirs[0][None, start:stop], out=mixed)
                np.add(np.bitwise_count(mixed, out=count), ahead, out=differ)
                np.bitwise_xor(second, theirs[1][None, start:stop], out=mixed)
                np.add(differ, np.bitwise_count(mixed, out=count), out=differ)
                np.less_equal(differ, np.clip(spare[start:stop] + largest, 0, 255).astype(np.uint8), out=near)
                at = np.flatnonzero(near)
                if len(at):
                    x, y = np.divmod(at, stop - start)
                    x, y = tile[x], others[y + start]
                    x, y = x[x < y], y[x < y]
                    ok = self.fit(rows, x, y)
                    yield x[ok], y[ok]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, cid = rows[0], rows[1]
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            length = np.diff(bounds)
            few = np.repeat(length <= SHORT, length)
            found = [self.short([c[few] for c in rows])] if few.any() else []
            names = [cid[few]] * len(found)
            for s, e in zip(bounds[:-1][length > SHORT], bounds[1:][length > SHORT]):
                order = s + np.argsort(rows[2][s:e], kind="stable")
                one = [c[order] for c in rows]
                found.append(self.long(one))
                names.append(one[1])
            for met, ids in zip(found, names):
                for i, j in met:
                    if len(i):
                        a, b = ids[i], ids[j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            key, cid, *bits, packed = (c.to_numpy() for c in b.columns)
            rows = [key, cid, packed >> 32, packed >> 2 & (1 << 30) - 1, (packed & 3) - 1, *bits]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last list may go on in the next batch
            held = [c[cut:].copy() for c in rows]
            if cut:
                yield from pairs([c[:cut] for c in rows])
        if held is not None:
            yield from pairs(held)


def may_match(top: int, bottom: int) -> Column:
    """Union sketch of the columns sketch_a, sketch_b (with size_a, size_b): no more differences than a match may have."""
    reach = F.least(F.element_at("sketch_a", -1), F.element_at("sketch_b", -1))
    known = [F.filter(c, lambda x: x <= reach) for c in ("sketch_a", "sketch_b")]
    differ = F.size(known[0]) + F.size(known[1]) - 2 * F.size(F.array_intersect(*known))
    need = -F.floor(-F.greatest("size_a", "size_b") * F.lit(top) / F.lit(bottom))
    return differ <= F.col("size_a") + F.col("size_b") - 2 * need


def _verify(top: int, bottom: int):
    """Keeps the pairs (a, b, x, y) that match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, m, v = None, 0, Counter()
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                if y != last:  # rows come in the order of their second text
                    words = y.split()
                    last, m, v = y, len(words), Counter(words)
                words = x.split()
                common = sum(min(n, v[w]) for w, n in Counter(words).items() if w in v)
                keep.append(common * bottom >= top * max(len(words), m))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class NearDuplicates:
    """``members`` (cid, id), one row per text, and ``links`` (a, b), one row per pair of classes, a < b as cids."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links


def near_duplicates(texts: DataFrame, *, min_words: int = 20, share: tuple[int, int] = (4, 5), most: int = 20_000) -> NearDuplicates:
    """Classes and links of ``texts`` (id, text); ids need not be unique, rows may repeat.

    ``share`` is a fraction of integers, so that the boundary is exact. No link is missed.
    Lists of more than ``most`` classes are split.
    """
    stage, rows = Stage(texts.sparkSession), usable(texts)
    bands, common = word_bands(rows, most)
    of = Classes(rows, stage, _sketch(min_words, *share, bands), {"size": "int", "sketch": "array<bigint>"} | dict.fromkeys(PARITY, "bigint"))
    schema = ", ".join(["key long", "cid long", "size int", "place int", *(f"{p} long" for p in PARITY)])
    lists = of.classes.select("cid", "size", "sketch", *PARITY).mapInArrow(_listed, schema)
    some = of.classes.where(F.pmod(F.xxhash64("cid"), F.lit(EVERY)) == 0)
    common_keys = some.select(F.explode("sketch").alias("key")).where(F.col("key") >= common << BAND)
    lists = spread(lists, "key", "cid", most, common_keys, EVERY)
    packed = F.shiftleft(F.col("size").cast("bigint"), 32) + F.col("place") * 4 + F.col("part") + 1
    lists = lists.select("key", "cid", *PARITY, packed.alias("packed"))
    met = lists.repartition("key").sortWithinPartitions("key").mapInArrow(Lists(*share), "a long, b long").distinct()
    met = stage.put(met, "met")

    found = stage.put(of.texts_of(met.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "size", "sketch"), "texts")
    end = lambda x: found.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "sketch", "text")])
    both = met.join(end("a"), "a").join(end("b"), "b").where(may_match(*share)).select("a", "b", "text_a", "text_b")
    links = stage.put(both.mapInArrow(_verify(*share), "a long, b long"), "links")
    stage.drop(met, found, of.classes)
    return NearDuplicates(of.members, links)


def linked_pairs(found: NearDuplicates) -> DataFrame:
    """All pairs (id_a, id_b), id_a < id_b, of different ids whose texts match; copies included."""
    m = found.members
    a, b = m.select(F.col("cid").alias("a"), F.col("id").alias("i")), m.select(F.col("cid").alias("b"), F.col("id").alias("j"))
    across = found.links.join(a, "a").join(b, "b").select("i", "j")
    copies = m.alias("l").join(m.alias("r"), (F.col("l.cid") == F.col("r.cid")) & (F.col("l.id") < F.col("r.id"))).select(F.col("l.id").alias("i"), F.col("r.id").alias("j"))
    pairs = across.unionByName(copies).where(F.col("i") != F.col("j"))
    return pairs.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def link_counts(found: NearDuplicates) -> DataFrame:
    """One row per text: id, its class (smallest id with the same words) and the number of texts linked to it."""
    size = found.members.groupBy("cid").agg(F.count("*").alias("n"), F.min("id").alias("class_id"))
    ends = found.links.select(F.col("a").alias("cid"), F.col("b").alias("other")).unionByName(found.links.select(F.col("b").alias("cid"), F.col("a").alias("other")))
    other = ends.join(size.select(F.col("cid").alias("other"), "n"), "other").groupBy("cid").agg(F.sum("n").alias("far"))
    by_class = size.join(other, "cid", "left").select("cid", "class_id", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return found.members.join(by_class, "cid").select("id", "class_id", "n_links")
