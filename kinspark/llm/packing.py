"""Problem 8: whole texts into containers of fixed capacity, by best-two-fit.

Sizes are tokens of a public tokenizer (its file is a parameter). A text longer than the
capacity is cut into full pieces and a rest; no other text is cut. A container is filled
greedily, always with the largest item that fits. Then its smallest item is replaced by two
unpacked ones if they fill the expanded gap more tightly; this is repeated while it gains.

Texts are hashed to shards of about ``shard`` texts, each packed in one task of its own, so
that the work is spread however many texts there are; a shard leaves at most about one
container part-filled. Full pieces never wait for others.

Null texts and rows without id are left out; an empty text takes 0 tokens in its shard's
first container; equal sizes go by id; repeated rows are packed once; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import Stage

MAX_CONTAINERS = 1000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = pa.schema([("container_id", pa.int64()), ("bin_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start_token", pa.int64()), ("n_tokens", pa.int32())])
#: One packed tokenizer per Python worker and file.
_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _LOADED[path] = t
    return _LOADED[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of each text, all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            sizes = [len(e.ids) for s in range(0, len(texts), 256) for e in t.encode_batch(texts[s : s + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    some = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text")
    return some.mapInArrow(run, "doc_id long, n_tokens long")


class Unpacked:
    """Sizes that are still to be packed, with their items."""

    def __init__(self, sizes: list[int]):
        self.items: dict[int, list[int]] = {}
        for i in range(len(sizes) - 1, -1, -1):
            self.items.setdefault(sizes[i], []).append(i)
        self.sizes = sorted(self.items)

    def largest(self, most: int) -> int:
        """The largest size up to ``most``, 0 if there is none."""
        k = bisect.bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int) -> int:
        left = self.items[size]
        i = left.pop()
        if not left:
            del self.items[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]
        return i

    def put_back(self, size: int, i: int) -> None:
        if size not in self.items:
            self.items[size] = []
            bisect.insort(self.sizes, size)
        self.items[size].append(i)

    def best_two(self, most: int, over: int) -> tuple[int, int] | None:
        """Two sizes with the largest sum up to ``most`` that is above ``over``."""
        best, pair = over, None
        for k in range(bisect.bisect_right(self.sizes, most - 1) - 1, -1, -1):
            x = self.sizes[k]
            if 2 * x <= best:
                break
            y = self.largest(min(x, most - x))
            if y == x and len(self.items[x]) < 2:
                y = self.sizes[k - 1] if k else 0
            if y and x + y > best:
                best, pair = x + y, (x, y)
                if best == most:
                    break
        return pair


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in ``sizes`` (each 1 to ``capacity``)."""
    todo, bins = Unpacked(sizes), []
    while todo.sizes:
        held: list[tuple[int, int]] = []
        gap = capacity
        while size := todo.largest(gap):
            held.append((size, todo.take(size)))
            gap -= size
        while gap:
            small = min(held)
            pair = todo.best_two(gap + small[0], small[0])
            if not pair:
                break
            held.remove(small)
            held += [(s, todo.take(s)) for s in pair]
            todo.put_back(*small)
            gap += small[0] - sum(pair)
        bins.append([i for _, i in held])
    return bins


def _pack(table: pa.Table) -> pa.Table:
    """All rows of one container size and shard."""
    order = sorted(zip(table.column("doc_id").to_pylist(), table.column("n_tokens").to_pylist()))
    container, shard, capacity = (table.column(c)[0].as_py() for c in ("container_id", "shard", "capacity"))
    rows, rest, empty = [], [], []
    number = 0
    for doc, n in order:
        full, left = divmod(n, capacity)
        for p in range(full):
            rows.append((number, doc, p, p * capacity, capacity))
            number += 1
        if left:
            rest.append((doc, full, full * capacity, left))
        elif not full:
            empty.append(doc)
    for held in best_two_fit([r[3] for r in rest], capacity):
        rows += [(number, *rest[i]) for i in held]
        number += 1
    rows += [(0, doc, 0, 0, 0) for doc in empty]
    cols = list(zip(*rows))
    base = shard << 32
    return pa.table([pa.array([container] * len(rows), pa.int64()), pa.array([base + b for b in cols[0]], pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols[1:], list(SCHEMA)[2:])]], schema=SCHEMA)


def pack(documents: DataFrame, containers: DataFrame, *, tokenizer: str = TOKENIZER, shard: int = 20_000) -> DataFrame:
    """container_id, bin_id, doc_id, piece, start_token, n_tokens: where each text, or piece of a long one, goes.

    ``containers`` (container_id, capacity_tokens) is a short fixed list; rows without a positive capacity are left out.
    """
    stage = Stage(documents.sparkSession)
    counts = stage.put(token_counts(documents, tokenizer).dropDuplicates(["doc_id"]), "tokens")
    shards = max(1, -(-counts.count() // shard))
    sizes = {(r[0], r[1]) for r in containers.where("capacity_tokens > 0 and container_id is not null").select("container_id", "capacity_tokens").limit(MAX_CONTAINERS + 1).collect()}
    if len(sizes) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} container sizes")
    kinds = F.array(*[F.struct(F.lit(c).cast("long").alias("container_id"), F.lit(n).cast("long").alias("capacity")) for c, n in sorted(sizes)])
    if not sizes:
        kinds = F.array().cast("array<struct<container_id:bigint,capacity:bigint>>")
    placed = counts.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).select(F.inline(kinds), "shard", "doc_id", "n_tokens")
    return placed.groupBy("container_id", "shard").applyInArrow(_pack, "container_id long, bin_id long, doc_id long, piece int, start_token long, n_tokens int")
