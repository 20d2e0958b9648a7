"""Token-set similarity compares every entry that can be near enough, however many there are."""

import random
import re

from kinspark.llm.canonical import Resolver, allowed, typing_distance


def _full_search(entries, tokens):
    forms = set(tokens) | {a + b for a, b in zip(tokens, tokens[1:])} | {a + b + c for a, b, c in zip(tokens, tokens[1:], tokens[2:])}
    best, answer = float("inf"), 0
    for ref, canonical, _ in sorted(entries):
        words, joined = canonical.split(), canonical.replace(" ", "")
        score = sum(min((typing_distance(f, w, allowed(w)) for f in forms), default=float("inf")) for w in words) / max(sum(map(len, words)), 1)
        number = "".join(re.findall(r"\d+$", joined))
        if len(words) > 1 and number:
            score = min(score, min((typing_distance(f[: -len(number)], joined[: -len(number)], 2.0) for f in forms if f.endswith(number)), default=float("inf")) / len(joined))
        if score < best:
            best, answer = score, ref
    return answer


def test_filler_words_hide_no_entry():
    entries = [(1, "corolla", []), *[(i, f"wonderful conditioning{i}x", []) for i in range(2, 40)]]
    assert Resolver(entries).resolve("wonderful condition corlola") == 1


def test_similar_is_the_full_search():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(1, 9)))
    entries = [(i, " ".join([*(word() for _ in range(r.randrange(1, 3))), *([str(r.randrange(30))] if i % 3 == 0 else [])]), []) for i in range(1, 300)]
    entries.append((300, "aaaaaa", []))
    resolver = Resolver(entries)
    some = 0
    for _ in range(400):
        name = list(r.choice(entries)[1])
        for _ in range(r.randrange(3)):
            name[r.randrange(len(name))] = r.choice("abcde")
        tokens = [*"".join(name).split(), *(word() for _ in range(r.randrange(6)))]
        want = _full_search(entries, tokens)
        some += want > 0
        assert resolver.similar(tokens) == want
    assert some > 100
