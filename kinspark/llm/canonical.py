"""Problem 3: free-entered values to a canonical list.

Only the distinct values of each field are examined, after a combined count; the result is
joined back. A multi-pattern automaton holds the canonical names and aliases of a field,
each also without blanks, bounded by blanks; the longest mention wins, then those that do
not overlap it. A value in which no entry is mentioned goes to token-set similarity: the
share of an entry's letters that the value's tokens, in any order, single or run together,
account for. A token accounts for the letters of a word less its edits from it, if they are
few enough; edits know neighbouring keys and swapped letters; numbers must agree exactly.
The entry of the highest similarity wins. What remains gets reference 0.

The reference list is sent to the tasks only up to ``MAX_REFERENCE`` rows; a longer one is
refused. Null and blank values are no cases; ties take the smaller reference id; repeated
rows count once; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_REFERENCE = 100_000
# The rows of a keyboard.
KEYBOARD = ["qwertyuiop", "asdfghjkl", "zxcvbnm"]


def _neighbours() -> set[tuple[str, str]]:
    at = {c: (x + y * 0.4, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}
    return {(a, b) for a in at for b in at if a != b and abs(at[a][0] - at[b][0]) <= 1.1 and abs(at[a][1] - at[b][1]) <= 1}


NEAR = _neighbours()


def typing_distance(typed: str, meant: str, most: float) -> float:
    """Edits from ``meant`` to ``typed``; a neighbouring key or swapped letters cost 0.9, any other letter 1.3; above ``most`` it is infinite."""
    if abs(len(typed) - len(meant)) > most:
        return float("inf")
    before: list[float] = []
    row = [float(j) for j in range(len(meant) + 1)]
    for i, c in enumerate(typed, 1):
        older, before, row = before, row, [float(i)]
        for j, d in enumerate(meant, 1):
            best = before[j - 1] if c == d else before[j - 1] + (0.9 if (c, d) in NEAR else 1.3)
            best = min(best, before[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and c == meant[j - 2] and typed[i - 2] == d and c != d:
                best = min(best, older[j - 2] + 0.9)
            row.append(best)
        if min(row) > most:
            return float("inf")
    return row[-1] if row[-1] <= most else float("inf")


def allowed(word: str) -> float:
    """Edits allowed in a word of an entry."""
    return 0.0 if word.isdigit() or len(word) < 3 else 1.3 if len(word) < 6 else 2.0


def _bigrams(w: str) -> set[str]:
    w = f"^{w}$"
    return {w[i : i + 2] for i in range(len(w) - 1)}


class Resolver:
    """The entries of one field."""

    def __init__(self, entries: list[tuple[int, str, list[str]]]):
        self.automaton = ahocorasick.Automaton()
        self.by_word, self.by_number, self.by_bigram = defaultdict(list), defaultdict(list), defaultdict(list)
        owner: dict[str, int] = {}
        for ref, canonical, aliases in sorted(entries):
            for name in (canonical, *aliases):
                for form in {name, name.replace(" ", "")}:
                    owner.setdefault(form, ref)
            words, joined = canonical.split(), canonical.replace(" ", "")
            if words:
                self.by_word[words[0]].append((ref, words))
            if len(words) > 1 and (number := "".join(re.findall(r"\d+$", joined))):
                self.by_number[number].append((ref, joined[: -len(number)]))
        # An edit of ``typing_distance`` changes at most three bigrams of a word, so a form within the allowed
        # distance keeps all but that many; words with no more of them are compared with every form.
        self.keeps = {w: len(_bigrams(w)) - 3 * int(allowed(w) / 0.9) for words in self.by_word.values() for _, ws in words for w in ws}
        self.short = [w for w, n in self.keeps.items() if n < 1]
        for w in self.keeps:
            for g in _bigrams(w):
                self.by_bigram[g].append(w)
        for form, ref in owner.items():
            if form:
                self.automaton.add_word(f" {form} ", (len(form), ref))
        if owner:
            self.automaton.make_automaton()
        self.any = bool(owner)

    def mentions(self, value: str) -> list[tuple[int, int, int]]:
        """(length, start, ref) of the mentions that win: longest first, never overlapping."""
        found = [(n, end - n, ref) for end, (n, ref) in self.automaton.iter(f" {value} ")] if self.any else []
        won: list[tuple[int, int, int]] = []
        for n, s, ref in sorted(found, key=lambda x: (-x[0], x[1])):
            if all(s + n <= t or t + m <= s for m, t, _ in won):
                won.append((n, s, ref))
        return won

    def similar(self, tokens: list[str]) -> int:
        """The entry of the highest token-set similarity, 0 if none has all its words; no entry is left out."""
        forms = set(tokens) | {a + b for a, b in zip(tokens, tokens[1:])} | {a + b + c for a, b, c in zip(tokens, tokens[1:], tokens[2:])}
        near: dict[str, float] = {}
        found = []
        for f in forms:
            shared = Counter(w for g in _bigrams(f) for w in self.by_bigram.get(g, ()))
            for w in [*(w for w, n in shared.items() if n >= self.keeps[w] > 0), *self.short]:
                distance = typing_distance(f, w, allowed(w))
                if distance < near.get(w, float("inf")):
                    near[w] = distance
            digits = len(f) - len(f.rstrip("0123456789"))
            for n in range(1, digits + 1):
                found += [(typing_distance(f[:-n], stem, 2.0) / (len(stem) + n), ref) for ref, stem in self.by_number.get(f[-n:], ())]
        found += [(sum(near[w] for w in words) / sum(map(len, words)), ref) for first in near for ref, words in self.by_word.get(first, ()) if all(w in near for w in words)]
        lacking, ref = min(found, default=(float("inf"), 0))  # similarity is 1 less this share
        return ref if lacking < float("inf") else 0

    def resolve(self, value: str) -> int:
        tokens = re.findall("[a-z0-9]+", value.lower())
        won = self.mentions(" ".join(tokens))
        return won[0][2] if won else self.similar(tokens)


def resolve_values(values: DataFrame, reference: DataFrame) -> DataFrame:
    """field_name, value, ref_id of each row of ``values`` (field_name, value)."""
    rows = reference.where(F.col("canonical").isNotNull()).select("field_name", "ref_id", "canonical", "aliases").limit(MAX_REFERENCE + 1).collect()
    if len(rows) > MAX_REFERENCE:
        raise ValueError(f"the reference list has more than {MAX_REFERENCE} rows")
    fields = defaultdict(list)
    for r in rows:
        fields[r["field_name"]].append((r["ref_id"], r["canonical"], [a.strip() for a in (r["aliases"] or "").split(";") if a.strip()]))
    fields = dict(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolvers = {f: Resolver(e) for f, e in fields.items()}
        none = Resolver([])
        for b in batches:
            refs = [resolvers.get(f, none).resolve(v) for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(refs, pa.int64())], names=["field_name", "value", "ref_id"])

    # Few bytes but much work: as many tasks as there are cores, which adaptive execution would put into one.
    spread = values.select("field_name", "value").repartition(3 * values.sparkSession.sparkContext.defaultParallelism, "field_name", "value")
    return spread.mapInArrow(run, "field_name string, value string, ref_id long")


def canonical_entries(records: DataFrame, reference: DataFrame, fields: list[str]) -> DataFrame:
    """rec_id, field_name, value, ref_id of each filled value that isn't literally canonical."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]))
    filled = records.select("rec_id", pairs.alias("x")).select("rec_id", "x.*").where(F.trim("value") != "")
    literal = reference.select("field_name", F.col("canonical").alias("value")).where(F.col("value").isNotNull()).distinct()
    typed = filled.join(literal, ["field_name", "value"], "left_anti")
    known = resolve_values(typed.groupBy("field_name", "value").agg(F.count("*").alias("n")), reference)
    return typed.join(known, ["field_name", "value"]).select("rec_id", "field_name", "value", "ref_id").distinct()
