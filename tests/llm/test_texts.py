"""Problems 8, 9, 10: packing, leakage, line labels."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinspark.llm.batches import slices
from kinspark.llm.leakage import leaked, winnow, words
from kinspark.llm.line_labels import Tokens, page_shares, shares, train
from kinspark.llm.packing import best_two_fit, pack, token_counts

CAPACITIES = "container_id long, capacity_tokens int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_two_fit_packs_everything_once(sizes):
    bins = best_two_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= 1 + 2 * -(-sum(sizes) // 50)


def test_best_two_replace_the_smallest():
    # Greedy takes 6 and 3 of 10; the 3 gives way to 2 and 2, which fill the gap.
    assert sorted(sorted([6, 3, 2, 2][i] for i in b) for b in best_two_fit([6, 3, 2, 2], 10)) == [[2, 2, 6], [3]]


def test_packing_round_trip(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choice(["car", "engine", "oil", "the"]) for _ in range(r.randrange(1, 120)))) for i in range(200)]
    docs += [(500, "word " * 700), (501, ""), (502, None), (None, "x"), docs[0]]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, bin_id int")
    n = {x.doc_id: x.n_tokens for x in token_counts(df).collect()}
    sizes = spark.createDataFrame([(1, 64), (2, 256), (2, 256), (3, 0), (4, None)], CAPACITIES)
    rows = pack(df, sizes, shard=60).collect()
    for container, capacity in ((1, 64), (2, 256)):
        mine = [x for x in rows if x.container_id == container]
        by_doc, by_bin = {}, {}
        for x in mine:
            by_doc.setdefault(x.doc_id, []).append(x)
            by_bin[x.bin_id] = by_bin.get(x.bin_id, 0) + x.n_tokens
        assert set(by_doc) == set(n) and max(by_bin.values()) <= capacity
        for d, pieces in by_doc.items():
            pieces.sort(key=lambda x: x.piece)
            assert sum(x.n_tokens for x in pieces) == n[d] and [x.start_token for x in pieces] == [i * capacity for i in range(len(pieces))]
            assert len(pieces) == 1 or n[d] > capacity  # only a text that is too long is cut
        assert sum(by_bin.values()) / (len(by_bin) * capacity) > 0.9
    assert {x.container_id for x in rows} == {1, 2}
    assert pack(df.limit(0), sizes).count() == 0 and pack(df, sizes.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=13, max_size=13), st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20))
def test_a_shared_span_always_shares_a_fingerprint(span, before, after):
    other = ["x"] * 9
    assert set(winnow(before + span + after, 8, 6).values()) & set(winnow(other + span + other, 8, 6).values())


def test_leaks(spark, rows):
    passage = [f"p{i}" for i in range(30)]
    docs = [
        (1, "Start. " + ", ".join(passage[5:18]).upper() + " end"), (2, " ".join(passage[5:17])), (3, " ".join(passage * 3)), (4, None), (5, ""), (6, "a " * 20000), (3, " ".join(passage * 3)),
        (7, " ".join(passage[:8] + ["no"] + passage[8:16] + ["no"] + passage[16:24])), (None, " ".join(passage)),
    ]
    items = spark.createDataFrame([(10, " ".join(passage), "s"), (11, " ".join(["q", *passage[:14]]), "s"), (12, None, "s"), (13, "short", "s"), (10, " ".join(passage), "t"), (11, "another " + " ".join(passage[8:25]), "t"), (14, "a " * 60, "t")], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    assert rows(leaked(df, items)) == [(1, 10, 13), (3, 10, 30), (3, 11, 17), (6, 14, 60)]
    assert leaked(df.limit(0), items).count() == leaked(df, items.limit(0)).count() == 0


def test_words():
    assert words("Éa-B1's\n2") == ["a", "b1", "s", "2"] and words(None) == []


def test_slices_keep_every_row():
    texts = ["a" * n for n in (0, 5, 30, 1, 1, 100, 2, 0, 9, 9)] + [None, "b"]
    b = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts)], names=["i", "t"])
    parts = list(slices(b, 1, rows=4, size=20))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(12)) and all(0 < p.num_rows <= 4 for p in parts)
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 20 for p in parts)
    assert list(slices(b.slice(0, 0), 1)) == []


PROSE = "We drove the car to the coast and it was quiet on the way back. The brakes feel good and the oil was changed in May."
LINKS = "\n".join(f"[Cheap Type {i}](http://www.a-{i}.example/type-{i}-used) | Cheap Make >> b-{i}.example/x" for i in range(20))
TAGS = " ".join(f"#cheaptype{i}" for i in range(60))
WORDS = "; ".join(["cheap", "parts", "dealer", "typex", "for sale", "near me"] * 12)
MENU = "\n".join(f"Type{i} Used\nBuy Cheap" for i in range(20))


FRENCH = "Nous avons pris la route vers la côte au petit matin et la voiture roulait sans bruit. Le moteur tourne bien, les freins sont neufs et l'huile a été changée en mai. "
PORTUGUESE = "Fomos de carro até à costa e a viagem correu muito bem. Os travões estão bons e o óleo foi mudado em maio. O meu irmão ainda procura um lugar para o estacionar. "
CHINESE = "我们开车去海边，路上很安静。\n刹车很好，机油五月换过。\n我弟弟还在找停车位。\n"
CODE = "function add(a, b) {\n  var total = a + b;\n  if (total > 10) { return total; }\n  return 0;\n}\nconsole.log(add(3, 4));\n"
STUFFED = "car rental from rome car rental to milan the best car rental of italy " * 6
PAGES = [(PROSE * 3, False), (LINKS, True), (TAGS, True), (WORDS, True), (MENU, True), (PROSE * 6 + "\n#oil #car", False), (PROSE + "\n" + LINKS * 3, True), (PROSE * 5 + "\nEquipment:\n- tow package\n- navigation", False), ("", False), (None, False), ("---", False), ("\n \n", False), ((PROSE + " ") * 2000, False), (FRENCH * 3, False), (PORTUGUESE * 3, False), (CHINESE * 4, False), (CODE * 3, False), (STUFFED, True)]


@pytest.fixture(scope="module", params=["guess", "trained"])
def model(request):
    return train([] if request.param == "guess" else [PROSE * 3, LINKS, TAGS, WORDS, MENU, PROSE, "hotel deals in paris hotel deals in london cheap hotel deals for the summer " * 6] * 20)


@pytest.mark.parametrize("text, flagged", PAGES)
def test_pages(model, text, flagged):
    n, listed = shares([text], model, Tokens())
    assert (2 * listed[0] > n[0]) == flagged


def test_pages_are_judged_alone(model):
    together = shares([t for t, _ in PAGES], model, Tokens())
    alone = [shares([t], model, Tokens()) for t, _ in PAGES]
    assert together[0].tolist() == [int(n[0]) for n, _ in alone] and together[1].tolist() == [int(m[0]) for _, m in alone]


def test_page_shares(spark, rows):
    df = spark.createDataFrame([(1, PROSE, 5), (2, LINKS, 5), (2, LINKS, 5), (3, None, 5), (None, TAGS, 5)], "doc_id long, text string, flagged int")
    assert rows(page_shares(df), "doc_id", "flagged") == [(1, False), (2, True), (2, True), (3, False), (None, True)]
    assert page_shares(df.limit(0)).count() == 0
