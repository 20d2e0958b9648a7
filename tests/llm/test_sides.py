"""Problem 5 compares an evaluation text only with the training texts that share an element of its sketch."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from kinspark.llm.cells import across
from kinspark.llm.split_overlap import Sides


def test_rows_of_different_sides_meet_once_and_cold_keys_stay_whole(spark):
    r = random.Random(1)
    rows = [(7 if i < 120 else r.randrange(100, 130), i, i % 3 == 0) for i in range(240)]
    df = spark.createDataFrame([(k, i, int(s)) for k, i, s in rows], "key long, cid long, side int")
    got = across(df, "key", "cid", (20, 30), df.select("key", "side")).collect()
    cells = {}
    for x in got:
        cells.setdefault(x.key, ([], []))[x.side].append(x.cid)
    met = Counter((a, b) for zero, one in cells.values() for a in zero for b in one)
    want = {(i, j) for k, i, s in rows for m, j, t in rows if k == m and not s and t}
    assert set(met) == want and set(met.values()) == {1}
    assert all(len(zero) < 60 and len(one) < 60 for zero, one in cells.values())
    assert Counter(x.cid for x in got if x.cid >= 120) == dict.fromkeys(range(120, 240), 1)  # not once for each part of the other side


def test_only_different_sides_are_compared():
    r = np.random.default_rng(1)
    n = 500
    key = np.sort(np.r_[np.zeros(300), r.integers(1, 30, 200)]).astype(np.int64)
    base = r.integers(0, 1 << 62, (20, 3))
    rows = [key, np.arange(n), r.integers(80, 110, n), r.integers(0, 12, n), r.choice([-1, 1], n), *(base[r.integers(0, 20, n), k] for k in range(3))]
    sides = Sides(4, 5)
    i, j = np.triu_indices(n, 1)
    same = key[i] == key[j]
    ok = sides.fit(rows, i[same], j[same])
    want = sorted(zip(i[same][ok].tolist(), j[same][ok].tolist()))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (key, rows[1], *rows[5:], rows[2] * (1 << 32) + rows[3] * 4 + rows[4] + 1)], names=list("abcdef"))
    got = sorted(p for b in sides(iter([batch])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert len(want) > 5 and got == want and all(rows[4][a] != rows[4][b] for a, b in got)
