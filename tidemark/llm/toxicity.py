"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learned from labels of documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import chain
from operator import itemgetter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.labels import held_out, sampled_texts
from tidemark.llm.texts import filter_texts, per_text, utf8

BREAK = b"\x1e"
EDGES = b".,;:!?\"'()[]{}<>*#%$&|-_/\\=+~`"
CACHED = 1_000_000
SHORTEST, LONGEST = 4, 7
SLICE = 64


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample, and how the weights are fitted.

    ``per_class`` documents of each label at most, each of ``max_bytes`` at most; words that
    fewer than ``min_docs`` of them hold have no weight. The prior is a bound for the fit of short documents.
    Sentences of log-odds up to ``level`` add nothing, so that length alone makes nothing toxic. The first ``steps``
    find the words, without that level; the last ``settled`` fit the very noisy-or that scores.
    """

    per_class: int = 2000
    max_bytes: int = 8_192
    min_docs: int = 3
    steps: int = 300
    settled: int = 150
    rate: float = 0.5
    damping: float = 0.02
    l1: float = 0.0005
    prior: float = -8.0
    toxic_share: float = 0.3
    level: float = -3.0


@dataclass(frozen=True)
class Model:
    """Log-odds of a sentence: the prior, and the weights of the features of its distinct words.

    Sentences of log-odds up to ``level`` are no evidence, however many a document has.
    """

    weights: dict[bytes, float]
    prior: float
    level: float


FIELDS = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    + [T.StructField("n_sentences", T.LongType()), T.StructField("worst_sentence", T.LongType())]
    + [T.StructField("worst_score", T.DoubleType()), T.StructField("worst_text", T.StringType())]
)


def tokens(text: bytes) -> list[bytes]:
    """Words by white space; line ends become a token of their own."""
    return text.replace(BREAK, b" ").replace(b"\n", b" \x1e ").split()


def normal(word: bytes) -> tuple[bytes, bool]:
    """The word in lower case without marks at its ends, and whether a sentence ends after it."""
    if word == BREAK:
        return b"", True
    bare = word.decode("utf-8", "replace").lower().encode().strip(EDGES)
    return bare, word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?")


def sentences(ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Number of the sentence of each token; a new one begins after an end and with each document."""
    first = np.ones(len(ends), dtype=bool)
    first[1:] = ends[:-1] | (doc[1:] != doc[:-1])
    return np.cumsum(first) - 1


def worded(sentence: np.ndarray, has_word: np.ndarray) -> np.ndarray:
    """Whether each token stands in a sentence with a word: blank lines and rules of marks are none."""
    return np.bincount(sentence, weights=has_word)[sentence] > 0


def features(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings: compounds of one stem share them."""
    letters = word.decode()
    return [word, *(b"^" + letters[:k].encode() for k in range(SHORTEST, LONGEST + 1) if k <= len(letters))]


def fit(texts: Sequence[bytes], labels: Sequence[int], how: Training = Training()) -> Model:
    """Weights by proximal gradient on the noisy-or likelihood of the documents' labels.

    A document is clean if none of its sentences is toxic: -log P(clean) is the sum of
    softplus(log-odds) of its sentences above the level. A toxic document that has none above it learns from
    all its sentences. The toxic documents have the weight ``toxic_share`` together. Without
    documents of both labels no word has a weight.
    """
    y = np.asarray(labels, dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return Model({}, how.prior, how.level)
    ids: dict[bytes, int] = {}
    word, ends, sizes = [], [], []
    for text in texts:
        split = [normal(w) for w in tokens(text)]
        word.append(np.array([ids.setdefault(w, len(ids)) for w, _ in split], dtype=np.int32))
        ends.append(np.array([e for _, e in split], dtype=bool))
        sizes.append(len(split))
    word, doc = np.concatenate(word), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    sentence = sentences(np.concatenate(ends), doc)
    kept = worded(sentence, word != ids.get(b"", -1))
    word, doc, sentence = word[kept], doc[kept], sentence[kept]
    begins = np.diff(sentence, prepend=-1) != 0
    sentence, owner = np.cumsum(begins) - 1, doc[begins]
    del ends, kept, begins
    # Distinct words of each sentence, and features of each word; features in few documents are left out.
    n = len(ids)
    of = (x for w, i in ids.items() if w for f in features(w) for x in (i, xxhash.xxh3_64_intdigest(f)))
    typed, feature = np.fromiter(of, dtype=np.uint64).reshape(-1, 2).T
    typed = typed.astype(np.int64)
    names, feature = np.unique(feature, return_inverse=True)
    share = np.where(y == 1, how.toxic_share / y.sum(), (1 - how.toxic_share) / (len(y) - y.sum()))
    in_docs, mass = np.zeros(len(names), dtype=np.int64), np.zeros(len(names))
    begin, pairs = np.searchsorted(typed, np.arange(n + 1)), []
    # A slice of documents at a time: all features of all of them would be the most that the fit holds.
    for start in range(0, len(y), SLICE):
        a, b = np.searchsorted(doc, [start, start + SLICE])
        there = np.unique(doc[a:b].astype(np.int64) * n + word[a:b])
        many = begin[there % n + 1] - begin[there % n]
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        held = np.repeat(there // n, many) * len(names) + feature[np.repeat(begin[there % n], many) + step]
        by, held = np.divmod(np.unique(held), len(names))
        np.add.at(in_docs, held, 1)
        np.add.at(mass, held, share[by])
        pairs.append(np.unique(sentence[a:b] * n + word[a:b]))
    del doc, there, many, step, held, by, begin, sentence
    use = in_docs[feature] >= how.min_docs
    typed, feature = typed[use], feature[use]
    at, word = np.divmod(np.concatenate(pairs), n)
    del pairs
    weight = np.zeros(len(names))
    for step in range(how.steps + how.settled):
        by_word = np.bincount(typed, weights=weight[feature], minlength=n)
        odds = how.prior + np.bincount(at, weights=by_word[word], minlength=len(owner))
        live = odds > (how.level if step >= how.steps else -np.inf)
        learns = live | (y == 1)[owner] & (np.bincount(owner, weights=live, minlength=len(y)) == 0)[owner]
        clean = np.bincount(owner, weights=np.where(learns, np.logaddexp(0, odds), 0), minlength=len(y))
        slope = share * np.where(y == 1, -1 / np.expm1(np.clip(clean, 1e-9, 500)), 1.0)
        push = (slope[owner] * np.where(learns, np.exp(-np.logaddexp(0, -odds)), 0))[at]
        pull = np.bincount(feature, weights=np.bincount(word, weights=push, minlength=n)[typed], minlength=len(names))
        rate = how.rate / (mass + how.damping)
        moved = weight - rate * pull
        weight = np.sign(moved) * np.maximum(np.abs(moved) - rate * how.l1, 0)
    found = {int(names[i]): float(weight[i]) for i in np.flatnonzero(weight)}
    weights = {f: found[h] for w in ids if w for f in features(w) if (h := xxhash.xxh3_64_intdigest(f)) in found}
    return Model(weights, how.prior, how.level)


def scorer(model: Model, threshold: float = 0.5) -> Callable[[], Callable]:
    def start() -> Callable:
        known: dict[bytes, int] = {}
        weight, ends, bares = [], [], []

        def number(word: bytes) -> int:
            bare, end = normal(word)
            known[word] = at = len(weight)
            weight.append(sum(model.weights.get(f, 0.0) for f in features(bare)))
            ends.append(end)
            bares.append(bare != b"")
            return at

        def make(texts: Sequence[bytes | None]) -> list:
            if len(known) > CACHED:
                known.clear(), weight.clear(), ends.clear(), bares.clear()
            split = [tokens(t or b"") for t in texts]
            sizes = np.array([len(s) for s in split], dtype=np.int64)
            for word in set(chain.from_iterable(split)).difference(known):
                number(word)
            ids = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
            doc = np.repeat(np.arange(len(texts)), sizes)
            begins = np.cumsum(sizes) - sizes
            n, clean = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            worst, most = np.full(len(texts), -1, dtype=np.int64), np.full(len(texts), -np.inf)
            at = np.zeros(0, dtype=np.int64)
            if len(ids):
                sentence = sentences(np.array(ends, dtype=bool)[ids], doc)
                at = np.flatnonzero(worded(sentence, np.array(bares, dtype=bool)[ids]))
            if len(at):
                ids, doc = ids[at], doc[at]
                sentence = np.unique(sentence[at], return_inverse=True)[1]
                # A word counts once in a sentence.
                values = np.array(weight)[ids]
                felt = np.flatnonzero(values)
                _, one = np.unique(sentence[felt] * len(weight) + ids[felt], return_index=True)
                felt = felt[one]
                odds = model.prior + np.bincount(sentence[felt], weights=values[felt], minlength=sentence[-1] + 1)
                first = np.flatnonzero(np.diff(sentence, prepend=-1))
                owner = doc[first]
                evidence = np.where(odds > model.level, np.logaddexp(0, odds), 0)
                clean = np.bincount(owner, weights=evidence, minlength=len(texts))
                n = np.bincount(owner, minlength=len(texts))
                np.maximum.at(most, owner, odds)
                top = np.flatnonzero(odds == most[owner])[::-1]
                worst[owner[top]] = top  # the first of the worst, as it is written last
            score = -np.expm1(-clean)
            where, said = np.full(len(texts), -1, dtype=np.int64), []
            for i, s in enumerate(worst):
                if s < 0:
                    said.append(None)
                    continue
                stop = first[s + 1] if s + 1 < len(first) else len(ids)
                start = at[first[s]] - begins[i]
                part = split[i][start : start + stop - first[s]]
                said.append(b" ".join(w for w in part if w != BREAK).decode("utf-8", "replace"))
                where[i] = s - np.searchsorted(owner, i)
            worst_score = np.where(where < 0, 0.0, 1 / (1 + np.exp(-most)))
            return [score, (score >= threshold).astype(np.int32), n, where, worst_score, said]

        return make

    return start


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, how: Training = Training()
) -> Model:
    rows = sampled_texts(docs, labels, id_column, text, label, how.per_class, how.max_bytes).toArrow()
    pairs = sorted(zip(utf8(rows.column("text")), rows.column("label").to_pylist(), strict=True), key=itemgetter(0))
    del rows
    return fit([t for t, _ in pairs], [y for _, y in pairs], how)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    how: Training = Training(),
    threshold: float = 0.5,
) -> DataFrame:
    """Score of every whole text, and its worst sentence (number from 0, score, text).

    Fitted on a bounded sample of the labelled rows that are not held out; scored in one pass
    without a shuffle. Texts without a word have no sentence and score 0; a null id stays null
    and is not held out; repeated rows each give a row; an empty table gives none. Null labels
    are not used, and other columns are not read.
    """
    model = fit_toxicity(docs, labels, id_column, text, label, how)
    scored = per_text(docs, text, [id_column], FIELDS, scorer(model, threshold))
    rest = [name for name in scored.columns if name != id_column]
    return scored.select(f"`{id_column}`", held_out(id_column).alias("held_out"), *rest)


def keep_clean(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    how: Training = Training(),
    threshold: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    Null and empty texts and texts without a word score 0 and stay. Equal rows have equal scores and
    stay or go together; a null id does not matter. Without labels of both kinds all rows stay; an empty
    table gives none.
    """
    model = fit_toxicity(docs, labels, id_column, text, label, how)

    def start() -> Callable:
        make = scorer(model, threshold)()
        return lambda texts: make(texts)[1] == 0

    return filter_texts(docs, text, start)
