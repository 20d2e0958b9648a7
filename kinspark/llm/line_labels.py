"""Problem 10: keyword-stuffed and link-list pages, by a hidden Markov model over lines.

A text's lines, long ones in pieces of ``PIECE`` words, are the observations. Each piece
emits some yes/no features (links, hash tags, separators, sentence ends, capitals, length,
repetition, symbols) and its words; no list of words is given. The states are prose, link list, tag
list, menu and code; Viterbi labels every piece of every text, whatever its length, and a page is
flagged if more than half of its words stand in link lists, tag lists and menus.

The model is trained by Baum-Welch on all documents, without labels: each round reads them all,
sums what it expects in the tasks and gathers the sums. Written down are a rough guess of the features' chances, which counts as ``PRIOR`` pieces a state, and
that neighbouring pieces tend to be of one kind. What words say of a state (``-LIMIT`` to
``LIMIT``) is learned: from links, tags and separators to the words beside them, from there
to keywords in the shape of sentences. Words are known by one of ``BUCKETS`` hashes, whatever their
number; those of fewer than three pieces say nothing, so text in a rare language is judged by its features.

Null, blank and wordless texts are never flagged; each row is judged by itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

STATES = ("prose", "links", "tags", "menu", "code")
LISTS, CODE = (1, 3), 4  # first and last state that makes a page a list; the last state
PIECE = 14
FEATURES = ("link", "hash", "separated", "sentence", "capitals", "short line", "repeats", "one word again", "stuffed", "symbols")
#: A rough guess of the chance of each feature, in the order of FEATURES, in each state (fixed values).
GUESS = np.array([
    (0.01, 0.005, 0.03, 0.70, 0.05, 0.05, 0.05, 0.01, 0.05, 0.01),
    (0.97, 0.05, 0.30, 0.10, 0.30, 0.50, 0.20, 0.10, 0.50, 0.05),
    (0.02, 0.40, 0.70, 0.05, 0.05, 0.10, 0.50, 0.30, 0.60, 0.01),
    (0.02, 0.01, 0.30, 0.10, 0.80, 0.60, 0.40, 0.05, 0.60, 0.01),
    (0.01, 0.005, 0.20, 0.10, 0.10, 0.60, 0.10, 0.05, 0.30, 0.98),
])
STAY, START, PRIOR = 0.85, np.array((0.69, 0.1, 0.1, 0.1, 0.01)), 500.0
LIMIT, SMOOTH, ROUNDS = 0.7, 20.0, 8
MEMO, BUCKETS = 500_000, 1 << 20
LINK = re.compile(r"https?://|www\.|href=|\]\(|^[a-z0-9-]+\.[a-z]{2,}/|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,8}/\S", re.I)
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SYMBOL = re.compile(r"[{}=]|^[+!&<]+$|\w\(|\)\W*\)")
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")  # writing without blanks between words
# Bits of a token; above them stands the number of its word.
IS_WORD, IS_LINK, IS_TAG, IS_MARK, IS_END, IS_CAPITAL, IS_LONG, IS_SYMBOL, SHIFT = 1, 2, 4, 8, 16, 32, 64, 128, 8


class Tokens(dict):
    """Blank-separated tokens to their bits and the number of their word; remembers those seen, up to a bound."""

    def __init__(self) -> None:
        super().__init__()
        self.words: dict[str, int] = {}
        self.hashed = np.empty(0, np.int64)

    def hashes(self) -> np.ndarray:
        """The hash of each word, in the order of their numbers."""
        fresh = list(itertools.islice(self.words, len(self.hashed), None))
        self.hashed = np.r_[self.hashed, np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in fresh), np.int64, len(fresh))]
        return self.hashed

    def __missing__(self, t: str) -> int:
        word = EDGE.sub("", t).lower()
        bits = IS_MARK * (t[-1] in ";,|·•*" or not word) | IS_SYMBOL * bool(SYMBOL.search(t) and not LINK.search(t))
        if word:
            bits |= IS_WORD | IS_LINK * bool(LINK.search(t)) | IS_TAG * (t[0] == "#") | IS_END * (t[-1] in ".!?。！？…" or t[-1] in "\"')»”" and t[-2:-1] in tuple(".!?"))
            bits |= IS_CAPITAL * t.lstrip("([\"'").strip("*_")[:1].isupper() | IS_LONG * (len(word) > 3 and not UNSPACED.search(word))
        x = self[t] = bits | self.words.setdefault(word, len(self.words)) << SHIFT
        return x


@dataclass
class Pieces:
    """Pieces of a batch of texts: the text, words and features of each, and which words it has, each once."""

    text: np.ndarray
    size: np.ndarray
    seen: np.ndarray
    piece: np.ndarray
    word: np.ndarray


def pieces_of(texts: list[str | None], tokens: Tokens) -> Pieces:
    """The pieces of all texts, in order; texts without words have none."""
    if len(tokens) > MEMO:
        tokens.clear()
        tokens.words.clear()
        tokens.hashed = tokens.hashed[:0]
    flat: list[str] = []
    text, ends, short = [], [0], []
    for k, t in enumerate(texts):
        for line in t.splitlines() if t else ():
            words = line.split()
            if not words:
                continue
            flat += words
            n, few = ends[-1], len(words) <= 4 and (line.isascii() or not UNSPACED.search(line))
            for i in range(0, len(words), PIECE):
                text.append(k)
                ends.append(n + min(i + PIECE, len(words)))
                short.append(few)
    if not flat:
        none = np.empty(0, np.int64)
        return Pieces(none, none, np.empty((0, len(FEATURES)), bool), none, none)
    code = np.fromiter(map(tokens.__getitem__, flat), np.int64, len(flat))
    ends, of_text = np.array(ends), np.array(text)
    start, length = ends[:-1], np.diff(ends)
    count = lambda bit: np.add.reduceat(code & bit != 0, start, dtype=np.int64)
    size = count(IS_WORD)
    n = np.maximum(size, 1)
    real = np.flatnonzero(code & IS_WORD)
    piece = np.repeat(np.arange(len(start)), length)[real]
    word = code[real] >> SHIFT
    many = len(tokens.words)
    both, some, times = np.unique(piece * many + word, return_index=True, return_counts=True)
    in_piece, its_word = both // many, both % many
    # How often each word stands in its text: words that are frequent there and longer than a few letters tell stuffing.
    _, back, often = np.unique(of_text[piece] * many + word, return_inverse=True, return_counts=True)
    long = code[real] & IS_LONG != 0
    total = np.bincount(piece, long, len(start))
    again = np.bincount(piece, long & (often[back] >= 3), len(start))
    distinct, thrice = np.bincount(in_piece, minlength=len(start)), np.bincount(in_piece, (times >= 3) & long[some], len(start))
    seen = np.stack([
        count(IS_LINK) * 8 >= n, count(IS_TAG) * 3 >= n, count(IS_MARK) * 4 >= n, count(IS_END) > 0, count(IS_CAPITAL) * 10 >= 6 * n,
        np.array(short), (distinct * 10 <= size * 8) & (size > 4), thrice > 0, (again * 2 >= total) & (total > 0), count(IS_SYMBOL) * 5 >= length,
    ], axis=1)
    seen[size == 0] = False
    return Pieces(of_text, size, seen, in_piece, its_word)


def _steps(text: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Pieces by their place in the text: at step t the piece numbers of the texts that have one, longest texts first; and the place of each piece's text in that order."""
    bounds = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True]) if len(text) else np.zeros(1, np.int64)
    first, length = bounds[:-1], np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    return [first[:a] + t for t, a in enumerate(alive)], first


@dataclass
class Model:
    """Logarithms of the chances; ``says``: hashes of the words that say something of the states, ascending, and ``weight`` what they say, after a row for all others."""

    start: np.ndarray
    move: np.ndarray
    chance: np.ndarray
    says: np.ndarray
    weight: np.ndarray

    def emission(self, p: Pieces, numbers: np.ndarray) -> np.ndarray:
        """Log chance of each piece in each state; ``numbers``: this model's number of each word of ``p``, 0 if unknown."""
        out = p.seen @ (np.log(self.chance) - np.log(1 - self.chance)).T + np.log(1 - self.chance).sum(axis=1)
        which = numbers[p.word]
        known = which > 0
        for s in range(len(STATES)):
            out[:, s] += np.bincount(p.piece[known], self.weight[which[known], s], len(out))
        out[p.size == 0] = 0
        return out

    def numbers(self, tokens: Tokens) -> np.ndarray:
        hashes = tokens.hashes()
        if not len(self.says):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.says, hashes), len(self.says) - 1)
        return np.where(self.says[at] == hashes, at + 1, 0)

    def viterbi(self, p: Pieces, numbers: np.ndarray) -> np.ndarray:
        """The state of each piece."""
        out = np.zeros(len(p.text), np.int64)
        if not len(out):
            return out
        emitted = self.emission(p, numbers)
        steps, _ = _steps(p.text)
        came, score = [], self.start + emitted[steps[0]]
        last = np.empty(len(score), np.int64)
        for at in steps[1:]:
            last[len(at) : len(score)] = score[len(at) :].argmax(axis=1)
            way = score[: len(at), :, None] + self.move
            back = way.argmax(axis=1)
            came.append(back)
            score = np.take_along_axis(way, back[:, None, :], 1)[:, 0] + emitted[at]
        last[: len(score)] = score.argmax(axis=1)
        for t in range(len(steps) - 1, -1, -1):
            n = len(steps[t])
            out[steps[t]] = last[:n]
            if t:
                last[:n] = np.take_along_axis(came[t - 1], last[:n, None], 1)[:, 0]
        return out

    def posteriors(self, p: Pieces, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances of the states of each piece, and the expected moves between states."""
        emitted = self.emission(p, numbers)
        emitted = np.exp(emitted - emitted.max(axis=1, keepdims=True))
        steps, _ = _steps(p.text)
        move, forward, backward = np.exp(self.move), np.empty_like(emitted), np.ones_like(emitted)
        for t, at in enumerate(steps):
            f = (np.exp(self.start) if not t else forward[steps[t - 1][: len(at)]] @ move) * emitted[at]
            forward[at] = f / f.sum(axis=1, keepdims=True)
        moves = np.zeros_like(move)
        for t in range(len(steps) - 1, 0, -1):
            at, before = steps[t], steps[t - 1][: len(steps[t])]
            late = emitted[at] * backward[at]
            joint = forward[before][:, :, None] * move * late[:, None, :]
            moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = late @ move.T
            backward[before] = b / b.sum(axis=1, keepdims=True)
        both = forward * backward
        return both / both.sum(axis=1, keepdims=True), moves


K = len(STATES)
STILL = np.full((K, K), (1 - STAY) / (K - 1)) + np.eye(K) * (STAY - (1 - STAY) / (K - 1))
#: Columns of the sums. Their keys are hashes of words, or below 0: -1 the states, then the moves from each state, then the features.
SUMS = ["held", *(f"s{s}" for s in range(K))]


def guess() -> Model:
    return Model(np.log(START), np.log(STILL), GUESS, np.empty(0, np.int64), np.zeros((1, K)))


def expected(parts: Iterable[list[str | None]], model: Model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and SUMS that ``model`` expects in ``parts`` of texts: for each word in how many pieces it is, and in how many of each state."""
    tokens, dense = Tokens(), np.zeros((1 + K + len(FEATURES), 1 + K))
    words = np.zeros((BUCKETS, 1 + K))
    for texts in parts:
        p = pieces_of(texts, tokens)
        if not len(p.text):
            continue
        chance, moves = model.posteriors(p, model.numbers(tokens))
        dense[0, 1:] += chance.sum(axis=0)
        dense[1 : 1 + K, 1:] += moves
        dense[1 + K :, 1:] += p.seen.T @ chance
        some, which = np.unique(tokens.hashes()[p.word], return_inverse=True)
        words[some, 0] += np.bincount(which, minlength=len(some))
        for s in range(K):
            words[some, 1 + s] += np.bincount(which, chance[p.piece, s], len(some))
    known = np.flatnonzero(words[:, 0])
    yield np.r_[-1 - np.arange(len(dense)), known], np.concatenate([dense, words[known]])


def improved(model: Model, keys: np.ndarray, sums: np.ndarray) -> Model:
    """The model that all sums give, each key once; the guess goes on counting as a prior."""
    order = np.argsort(keys)
    keys, sums = keys[order], sums[order]
    words = keys >= 0
    dense = sums[~words][::-1, 1:]
    if not len(dense) or not dense[0].sum():
        return model
    mass, move, seen = dense[0], dense[1 : 1 + K] + PRIOR * STILL, dense[1 + K :].T
    held, counted = sums[words, 0], sums[words, 1:]
    share = counted.sum(axis=1, keepdims=True) / max(counted.sum(), 1e-12)
    weight = np.clip(np.log(np.maximum((counted + SMOOTH * share * K) / (counted.sum(axis=0) + SMOOTH * K), 1e-12) / np.maximum(share, 1e-12)), -LIMIT, LIMIT)
    weight[:, CODE] = 0
    guessed = (seen + PRIOR * GUESS) / (mass[:, None] + PRIOR)
    guessed[CODE] = GUESS[CODE]  # few texts have code, and without its symbols nothing is
    often = held >= 3
    return Model(model.start, np.log(move / move.sum(axis=1, keepdims=True)), guessed, keys[words][often], np.concatenate([np.zeros((1, K)), weight[often]]))


def train(texts: list[str]) -> Model:
    """Baum-Welch on unlabelled texts, from the guess, in ``ROUNDS`` rounds."""
    model = guess()
    for _ in range(ROUNDS):
        model = improved(model, *next(expected([texts], model)))
    return model


def _expected(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (part.column(0).to_pylist() for b in batches for part in slices(b, 0, rows=1000))
        for keys, sums in expected(parts, model):
            yield pa.RecordBatch.from_arrays([pa.array(keys), *map(pa.array, sums.T.copy())], names=["key", *SUMS])

    return run


def train_on(documents: DataFrame) -> Model:
    """``train`` on all rows of ``documents`` (text)."""
    model, schema = guess(), ", ".join(["key long", *(f"{c} double" for c in SUMS)])
    for _ in range(ROUNDS):
        sums = documents.select("text").mapInArrow(_expected(model), schema).groupBy("key").agg(*[F.sum(c).alias(c) for c in SUMS]).toArrow()
        model = improved(model, sums.column("key").to_numpy(), np.stack([sums.column(c).to_numpy() for c in SUMS], axis=1))
    return model


def shares(texts: list[str | None], model: Model, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text and how many of them stand in lists."""
    p = pieces_of(texts, tokens)
    state = model.viterbi(p, model.numbers(tokens))
    listed = (state >= LISTS[0]) & (state <= LISTS[1])
    total = lambda x: np.bincount(p.text, x, len(texts)).astype(np.int64)
    return total(p.size), total(p.size * listed)


def _label(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for b in batches:
            for part in slices(b, 1, rows=1000):
                n, listed = shares(part.column(1).to_pylist(), model, tokens)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(listed)], names=["doc_id", "n_words", "n_listed"])

    return run


def page_shares(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_listed (words in lists), flagged (more than half)."""
    model = train_on(documents)
    out = documents.select("doc_id", "text").mapInArrow(_label(model), "doc_id long, n_words long, n_listed long")
    return out.select("*", (F.col("n_listed") * 2 > F.col("n_words")).alias("flagged"))
