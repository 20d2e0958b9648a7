"""Pairs that a sketch loses: variants of a hot text, members of large families."""

import random

import pytest

from kinspark.llm.near_duplicates import linked_pairs, near_duplicates
from kinspark.llm.split_overlap import overlapping_texts

HOT = [f"hot{i}" for i in range(120)]


def _variant(r, name, words, changed):
    out = list(words)
    for i in r.sample(range(len(out)), changed):
        out[i] = f"{name}x{i}"
    r.shuffle(out)
    return " ".join(out)


def _others(r, n):
    return [(f"o{i}", " ".join(f"w{r.randrange(3000)}" for _ in range(120))) for i in range(n)]


def test_variants_of_a_text_that_a_third_of_the_rows_hold(spark):
    r = random.Random(1)
    variants = [(f"v{i}", _variant(r, f"v{i}", HOT, 24)) for i in range(12)]
    beyond = [("far", _variant(r, "far", HOT, 25))]
    copies = [(f"c{i:03}", " ".join(HOT)) for i in range(100)]
    df = spark.createDataFrame([*copies, *variants, *beyond, *_others(r, 190)], "id string, text string")
    found = linked_pairs(near_duplicates(df)).where("id_a like 'c%' and id_b not like 'c%'").collect()
    assert {(x.id_a, x.id_b) for x in found} == {(c, v) for c, _ in copies for v, _ in variants}


def test_split_overlap_with_a_text_copied_under_many_ids(spark):
    r = random.Random(2)
    variants = [(f"v{i}", _variant(r, f"v{i}", HOT, 24)) for i in range(12)]
    train = [*[(f"c{i}", " ".join(HOT)) for i in range(100)], *_others(r, 100)]
    schema = "id string, text string"
    members, found = overlapping_texts(spark.createDataFrame([*variants, ("far", _variant(r, "far", HOT, 25))], schema), spark.createDataFrame(train, schema))
    rows = members.join(found, members.cid == found.eval_cid).select("id", "coverage").collect()
    assert {x.id for x in rows} == {v for v, _ in variants} and all(0 < x.coverage <= 1 for x in rows)


@pytest.mark.parametrize("n", [300, 3000])
def test_families_are_found_whole_at_every_size(spark, n):
    """A tenth of the texts are a template of 80 words with 8 to 16 of them changed; each pair is compared by brute force."""
    r = random.Random(3)
    template = [f"t{i}" for i in range(80)]
    texts = [(f"f{i:03}", _variant(r, f"f{i}", template, r.randrange(8, 17))) for i in range(n // 10)]
    texts.append(("f", " ".join(template)))
    df = spark.createDataFrame([*texts, *_others(r, n - len(texts))], "id string, text string")
    bags = [(i, set(t.split())) for i, t in texts]
    want = {tuple(sorted((i, j))) for k, (i, x) in enumerate(bags) for j, y in bags[:k] if len(x & y) >= 64}
    got = {(x.id_a, x.id_b) for x in linked_pairs(near_duplicates(df)).collect()}
    assert len(want) >= n // 10 and got == want
