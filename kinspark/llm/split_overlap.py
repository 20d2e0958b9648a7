"""Problem 5: evaluation records that also stand in the training split, exactly or almost.

Two texts are almost the same if both have ``min_words`` words or more and share at least
``share`` of the longer one's, counted with repeats (as in ``near_duplicates``).

1. Texts with equal words are one class. A class is normalised to its elements (word, how
   often it came before) in order of their values, rare ones first: so texts with their
   words rearranged have the same form. Its sketch holds the first elements of the form, one
   more than a match may lack (see ``near_duplicates``).
2. The smallest common element of a match is in both sketches. So evaluation and training
   classes meet in the inverted lists of the elements that their sketches hold, and no match
   is missed; there, lengths, places and parity bits of the elements behind rule most out. No
   training class is compared with evaluation classes that share none of these elements.
3. Long lists are cut on either side, into parts of evaluation classes with about ``shard``
   elements and parts of training classes with about ``split``; each two are a cell.
4. Candidates are compared word by word. Matched intervals (two elements or more that follow
   each other in both forms), merged, give the coverage of the evaluation record. A word that
   a match lacks, or one that it has besides, breaks at most one of the passages of two
   elements; a match of n words differs in at most 2 * floor(n / 5) elements, and n // 2
   passages are more: so no match has a coverage of 0.

Null and short texts match nothing; repeated rows count once; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import Stage
from .cells import across
from .near_duplicates import EVERY, PARITY, Classes, Lists, Values, _listed, _sketch, may_match, usable, word_bands

PASSAGE = 2


def merged_length(intervals: list[tuple[int, int]]) -> int:
    """Words covered by intervals that may overlap."""
    total, reach = 0, -1
    for s, e in sorted(intervals):
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


class Sides(Lists):
    """Inverted lists in which rows of part 1 meet rows of part -1 only."""

    def long(self, rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        one, other = (np.flatnonzero(rows[4] == part) for part in (1, -1))
        yield from self.tiles(rows, one, other)
        yield from self.tiles(rows, other, one)


def _covered(top: int, bottom: int, bands: dict[int, int]):
    """(eval_cid, train_cid, x, y) to the pairs that match, with their coverage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = Values(bands)
        for b in batches:
            keep, coverage = [], []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                mine, theirs = x.split(), y.split()
                ok = (Counter(mine) & Counter(theirs)).total() * bottom >= top * max(len(mine), len(theirs))
                keep.append(ok)
                if ok:
                    form = values.of([mine])[1].tolist()
                    place = {v: i for i, v in enumerate(values.of([theirs])[1].tolist())}
                    at = [place.get(v, -2 * len(place)) for v in form]
                    coverage.append(merged_length([(i, i + 2) for i, (s, t) in enumerate(zip(at, at[1:])) if t == s + 1]) / len(form))
            kept = b.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(coverage, pa.float64())], names=["eval_cid", "train_cid", "coverage"])

    return run


def overlapping_texts(evaluation: DataFrame, training: DataFrame, *, min_words: int = 20, share: tuple[int, int] = (4, 5), shard: int = 600_000, split: int = 1_250_000) -> tuple[DataFrame, DataFrame]:
    """(members, found): cid, id of each evaluation text; eval_cid, train_cid, coverage of each pair of classes.

    Both inputs have id and text; ids need not be unique. A ``share`` or ``min_words`` for
    which two-element passages don't do (three quarters or less) is refused.
    """
    top, bottom = share
    if any(n // PASSAGE <= 2 * (n - -(-n * top // bottom)) for n in range(min_words, min_words + 4 * bottom)):
        raise ValueError("passages of two elements need a larger share or more words")
    stage = Stage(evaluation.sparkSession)
    held, corpus = (usable(t).distinct() for t in (evaluation, training))
    bands, _ = word_bands(held.select("text").unionAll(corpus.select("text")))
    columns = {"size": "int", "sketch": "array<bigint>"} | dict.fromkeys(PARITY, "bigint")
    ev, tr = (Classes(t, stage, _sketch(min_words, top, bottom, bands), columns) for t in (held, corpus))
    classes = ev.classes.withColumn("side", F.lit(0)).unionByName(tr.classes.withColumn("side", F.lit(1)))
    schema = ", ".join(["key long", "cid long", "size int", "place int", *(f"{p} long" for p in PARITY)])
    sided = classes.select((F.shiftleft("cid", 1) + F.col("side")).alias("cid"), "size", "sketch", *PARITY)  # the last bit is the side
    side = (F.col("cid") % 2).cast("int")
    lists = sided.mapInArrow(_listed, schema).withColumn("side", side)
    some = sided.where(F.pmod(F.xxhash64("cid"), F.lit(EVERY)) == 0).select(F.explode("sketch").alias("key"), side.alias("side"))
    mean = {r["side"]: r["mean"] for r in classes.groupBy("side").agg(F.avg("size").alias("mean")).collect()}
    most = max(1, int(shard / mean.get(0, 1))), max(1, int(split / mean.get(1, 1)))
    packed = F.shiftleft(F.col("size").cast("bigint"), 32) + F.col("place") * 4 + (1 - F.col("side")) * 2
    lists = across(lists, "key", "cid", most, some, EVERY).select("key", "cid", *PARITY, packed.alias("packed"))
    met = lists.repartition("key").sortWithinPartitions("key").mapInArrow(Sides(top, bottom), "a long, b long").distinct()
    end = lambda s: F.shiftright(F.when(F.col("a") % 2 == s, F.col("a")).otherwise(F.col("b")), 1)
    met = stage.put(met.select(end(0).alias("a"), end(1).alias("b")), "met")

    texts = [stage.put(c.texts_of(met.select(F.col(x).alias("cid")).distinct(), "size", "sketch"), "texts") for c, x in ((ev, "a"), (tr, "b"))]
    with_text = [t.select(F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("size", "sketch", "text")]) for t, x in zip(texts, "ab")]
    pairs = met.join(with_text[0], "a").join(with_text[1], "b").where(may_match(top, bottom)).select("a", "b", "text_a", "text_b")
    found = stage.put(pairs.mapInArrow(_covered(top, bottom, bands), "eval_cid long, train_cid long, coverage double"), "found")
    stage.drop(met, *texts, ev.classes, tr.classes, tr.members)
    return ev.members, found
