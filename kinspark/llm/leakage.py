"""Problem 9: evaluation passages inside a corpus, by winnowing.

Words are runs of a-z and digits after lower-casing. Of the hashes of all ``k``-word grams,
winnowing keeps the smallest in every window of ``window`` grams (the rightmost of equal
ones), so that any run of k + window - 1 common words leaves a common fingerprint. Corpus
and evaluation fingerprints are joined on the hash; each hit is extended word by word to
both sides, and counts if the run has at least ``k + window - 1`` words. Nothing is missed:
a common run of that length always has a common fingerprint inside it. All texts of a
document and of an item count.

Evaluation fingerprints are broadcast only up to ``BROADCAST_ROWS`` of them (their number is
counted first); beyond that the join is shuffled.

Null and short texts leak nothing; repeated rows count once; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import Stage

BROADCAST_ROWS = 200_000
WORDS = re.compile("[a-z0-9]+")


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def winnow(ws: list[str], k: int, window: int) -> dict[int, int]:
    """Position -> hash of the kept grams of a text; every run of ``k + window - 1`` words has one inside it."""
    n = len(ws) - k + 1
    if n < window:
        return {}
    joined, digest = " ".join(ws), xxhash.xxh64_intdigest
    starts, at = [], 0
    for w in ws:
        starts.append(at)
        at += len(w) + 1
    starts.append(at)
    raw = joined.encode("ascii")
    grams = [digest(raw[starts[i] : starts[i + k] - 1]) >> 1 for i in range(n)]
    kept: dict[int, int] = {}
    best = -1
    for end in range(window - 1, n):
        start = end - window + 1
        if best < start:
            best = start
            for j in range(start + 1, end + 1):
                if grams[j] <= grams[best]:
                    best = j
        elif grams[end] <= grams[best]:
            best = end
        kept[best] = grams[best]
    return kept


def _fingerprints(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, at = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for p, h in winnow(words(t), k, window).items():
                    ids.append(i)
                    hashes.append(h)
                    at.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(at, pa.int32())], names=["id", "h", "at"])

    return run


def run_around(a: list[str], b: list[str], i: int, j: int) -> tuple[int, int]:
    """Start and end in ``a`` of the run of equal words around a[i] and b[j]; an empty one if they differ."""
    if a[i] != b[j]:
        return i, i
    s = 0
    while s < min(i, j) and a[i - s - 1] == b[j - s - 1]:
        s += 1
    e = 1
    while i + e < len(a) and j + e < len(b) and a[i + e] == b[j + e]:
        e += 1
    return i - s, i + e


def _extend(k: int, window: int):
    """(doc_id, item_id, hits, text, passage) to doc_id, item_id, n_words of the pairs with a run that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[str, tuple[list[str], dict[int, list[int]]]] = {}
        for b in batches:
            doc_out, item_out, len_out = [], [], []
            last, ws = None, []
            for doc, item, hits, text, passage in zip(*(b.column(i).to_pylist() for i in range(5))):
                if text != last:
                    last, ws = text, words(text)
                if passage not in items:
                    if len(items) > 10_000:
                        items.clear()
                    mine, places = words(passage), defaultdict(list)
                    for q, h in winnow(mine, k, window).items():
                        places[h].append(q)
                    items[passage] = mine, places
                mine, places = items[passage]
                best, done = 0, {}
                for h in sorted(hits, key=lambda h: h["p"]):
                    for q in places.get(h["h"], ()):
                        if done.get(h["p"] - q, -1) <= h["p"]:  # else inside a run that is known
                            s, e = run_around(ws, mine, h["p"], q)
                            done[h["p"] - q] = e
                            best = max(best, e - s)
                if best >= k + window - 1:
                    doc_out.append(doc)
                    item_out.append(item)
                    len_out.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(doc_out, pa.int64()), pa.array(item_out, pa.int64()), pa.array(len_out, pa.int32())], names=["doc_id", "item_id", "n_words"])

    return run


def leaked(documents: DataFrame, items: DataFrame, *, k: int = 8, window: int = 6) -> DataFrame:
    """doc_id, item_id, n_words: the longest run (of 13 words or more by default) found around a common fingerprint.

    ``documents`` (doc_id, text) and ``items`` (item_id, text); an id may have several texts, all of them are searched.
    """
    stage = Stage(documents.sparkSession)
    schema = "id long, h long, at int"
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text").withColumn("doc", F.xxhash64("doc_id", "text"))
    its = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", F.col("text").alias("passage")).distinct().withColumn("item", F.xxhash64("item_id", "passage"))
    of_items = stage.put(its.select("item", "passage").mapInArrow(_fingerprints(k, window), schema).select(F.col("id").alias("item"), "h").distinct(), "items")
    if of_items.count() <= BROADCAST_ROWS:
        of_items = F.broadcast(of_items)
    of_docs = docs.select("doc", "text").mapInArrow(_fingerprints(k, window), schema).select(F.col("id").alias("doc"), "h", F.col("at").alias("p"))
    hits = of_docs.join(of_items, "h").groupBy("doc", "item").agg(F.collect_set(F.struct("p", "h")).alias("hits"))  # no more than the text has words
    hits = stage.put(hits, "hits")
    full = hits.join(docs, "doc").join(its, "item").select("doc_id", "item_id", "hits", "text", "passage")
    return full.mapInArrow(_extend(k, window), "doc_id long, item_id long, n_words int").groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
