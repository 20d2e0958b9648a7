"""Problems 1, 2, 5: groups, near-duplicates and split overlaps against brute force, with edge cases and skew."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinspark.llm.components import connected_groups
from kinspark.llm.near_duplicates import Lists, link_counts, linked_pairs, near_duplicates
from kinspark.llm.split_overlap import merged_length, overlapping_texts


def _groups(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a.strip() and b.strip() and a.strip() != b.strip():
            x, y = find(a.strip()), find(b.strip())
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


def _check_groups(spark, edges):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in edges], "id_a string, id_b string, u string, group_id string")
    got = [(r.rec_id, r.group_id) for r in connected_groups(df).collect()]
    assert len(got) == len(set(got)) and dict(got) == _groups(edges)


def test_groups_of_odd_pairs(spark):
    _check_groups(spark, [("b", "a"), ("a", "b"), ("a", "b"), (" b ", "c"), ("d", "d"), (None, "e"), ("f", ""), ("g", "h"), ("zz", "h")])


def test_groups_of_nothing(spark):
    _check_groups(spark, [("a", "a"), (None, None)])
    assert connected_groups(spark.createDataFrame([], "id_a string, id_b string")).count() == 0


def test_groups_of_a_long_chain_and_a_hub(spark):
    ids = [f"{i:04d}" for i in range(300)]
    random.Random(1).shuffle(ids)
    _check_groups(spark, list(zip(ids, ids[1:])) + [("hub", f"s{i}") for i in range(300)])


def test_groups_of_random_pairs(spark):
    r = random.Random(2)
    _check_groups(spark, [(str(r.randrange(200)), str(r.randrange(200))) for _ in range(150)])


def _share(x, y):
    u, v = x.split(), y.split()
    return min(len(u), len(v)) >= 20 and 5 * sum((Counter(u) & Counter(v)).values()) >= 4 * max(len(u), len(v))


def _texts(n, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "a", "of"] * 40
    out = []
    for i in range(n):
        if i % 3 or not out:
            t = [r.choice(words) for _ in range(r.randrange(15, 60))]
        else:
            t = list(r.choice(out)[1].split())
            for _ in range(r.randrange(0, max(1, len(t) // 6))):
                t[r.randrange(len(t))] = r.choice(words)
            r.shuffle(t)
        out.append((str(i), " ".join(t)))
    return out


def _pairs(texts):
    return {tuple(sorted((a, b))) for i, (a, x) in enumerate(texts) for b, y in texts[:i] if a != b and _share(x, y)}


def test_near_duplicates_match_brute_force(spark):
    texts = _texts(300)
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in texts], "id string, text string, cid int, key string")
    found = near_duplicates(df)
    got = {(r.id_a, r.id_b) for r in linked_pairs(found).collect()}
    want = _pairs(texts)
    assert len(want) > 5 and got == want
    degree = Counter(x for p in got for x in p)
    assert {r.id: r.n_links for r in link_counts(found).collect()} == {i: degree[i] for i, t in texts if len(t.split()) >= 20}


def test_near_duplicates_edge_cases(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [
        ("a", " ".join(base)), ("b", " ".join(reversed(base))), ("b", " ".join(reversed(base))), ("c", "  ".join(base) + " "), ("d", " ".join(base[:16] + ["p", "q", "r", "s"])),
        ("e", " ".join(base[:15] + ["p", "q", "r", "s", "t"])), ("f", " ".join(base[:19])), ("g", None), ("h", ""), (None, " ".join(base)), ("i", " ".join(["same"] * 30)), ("j", " ".join(["same"] * 25)), ("k", " ".join(["same"] * 23)),
    ]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {(r.id_a, r.id_b) for r in linked_pairs(near_duplicates(df)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d"), ("d", "e"), ("i", "j"), ("j", "k")}
    assert linked_pairs(near_duplicates(df.limit(0))).count() == 0


def test_long_texts_and_many_copies(spark):
    long = " ".join(f"z{i % 3000}" for i in range(9000))
    short = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([("l1", long), ("l2", long + " end"), *[(f"c{i}", short) for i in range(200)]], "id string, text string")
    found = near_duplicates(df)
    assert found.links.count() == 1  # copies are one class
    counts = {r.id: (r.class_id, r.n_links) for r in link_counts(found).collect()}
    assert counts["c7"] == ("c0", 199) and counts["l1"][1] == 1


def test_hot_lists_are_split_without_losing_pairs(spark):
    texts = _texts(300)
    df = spark.createDataFrame(texts, "id string, text string")
    whole = {tuple(r) for r in linked_pairs(near_duplicates(df)).collect()}
    assert whole and {tuple(r) for r in linked_pairs(near_duplicates(df, most=5)).collect()} == whole


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_lists_across_batches(step):
    """Short and long lists in batches of any size give the pairs of a plain loop."""
    r = np.random.default_rng(1)
    n = 400
    key = np.sort(np.r_[np.zeros(200), r.integers(1, 40, 200)]).astype(np.int64)
    base = r.integers(0, 1 << 62, (20, 3))
    rows = [key, np.arange(n), r.integers(80, 110, n), r.integers(0, 12, n), r.integers(-1, 2, n), *(base[r.integers(0, 20, n), k] for k in range(3))]
    lists = Lists(4, 5)
    i, j = np.triu_indices(n, 1)
    same = key[i] == key[j]
    ok = lists.fit(rows, i[same], j[same])
    want = sorted(zip(i[same][ok].tolist(), j[same][ok].tolist()))
    columns = [key, rows[1], *rows[5:], rows[2] * (1 << 32) + rows[3] * 4 + rows[4] + 1]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[k : k + step]) for c in columns], names=list("abcdef")) for k in range(0, n, step)]
    got = sorted(p for b in lists(iter(batches)) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    assert len(want) > 5 and got == want


def test_merged_length():
    assert merged_length([(0, 3), (1, 4), (10, 12), (10, 11)]) == 6 and merged_length([]) == 0


@pytest.mark.parametrize("shard", [100_000, 700])
def test_split_overlaps_match_brute_force(spark, shard):
    texts = _texts(240, 5)
    ev, tr = texts[::2], texts[1::2]
    schema = "id string, text string, s int"
    e = spark.createDataFrame([(i, t, 0) for i, t in [*ev, ev[0], ("n", None), (None, "x")]], schema)
    t = spark.createDataFrame([(i, t, 0) for i, t in tr], schema)
    members, found = overlapping_texts(e, t, shard=shard, split=4 * shard)
    got = {r.id for r in members.join(found, members.cid == found.eval_cid, "left_semi").collect()}
    want = {i for i, x in ev if any(_share(x, y) for _, y in tr)}
    assert len(want) > 15 and got == want
    assert all(0 < r.coverage <= 1 for r in found.collect())
    assert overlapping_texts(e.limit(0), t)[1].count() == overlapping_texts(e, t.limit(0))[1].count() == 0
    with pytest.raises(ValueError):
        overlapping_texts(e, t, share=(3, 4))
