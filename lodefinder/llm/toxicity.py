"""Toxicity by subword bags: character n-gram vectors averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams, so a misspelling that training never saw
still shares most of its vectors with the word it hides. A text's distinct words are cut into windows of WINDOW; a
window's vector is the mean over its words, and a linear softmax scores it. Vectors, softmax weights and bias are
trained together by gradient descent with one rate: each window is an example with its text's label, so n-grams that
both kinds of text hold end up at the base rate, and one that few texts hold moves little; decay keeps all small. A
text's margin is that of its most toxic window, so a long text does not dilute a short insult. One such model is
trained without each fold of the training rows; what margin makes a toxic label likelier than not is fitted by
logistic regression on the margins of the rows that a model had not seen, and the models' mean scores all texts. Training takes a bounded sample of labelled rows; every document is scored whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodefinder.llm.common import held, map_text

#: Labelled rows that training may use at most (the smallest hashes of their ids).
TRAIN_DOCS = 3_000
BUCKETS, DIM, GRAMS, WINDOW = 1 << 18, 8, (3, 4, 5), 4
EPOCHS, BATCH, RATE, DAMPING, DECAY, FOLDS = 4, 64, 1.0, 0.03, 1e-3, 5
CACHE_SIZE = 1_000_000
#: What is stripped from the ends of words; inside a word any character counts, as misspellings use digits and symbols.
OUTER = ".,;:!?\"'()[]{}<>«»“”‘’„…-–—_/\\|"


def words_of(text: str | None) -> list[str]:
    """The distinct words of a text in the order of their first use: repetition says nothing about toxicity."""
    return [w for w in dict.fromkeys(x.strip(OUTER) for x in text.lower().split()) if w] if text else []


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each <word>, all words in a row, and each word's first index."""
    coded = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(first + size, size) - np.arange(len(coded))  # characters from here to the word's end
    mult = np.uint64(0x9E3779B97F4A7C15)
    found, owners, hashed = [], [], np.zeros(len(coded), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        hashed = (hashed ^ coded) * mult
        hashed ^= hashed >> np.uint64(29)
        if n in GRAMS:
            ok = left >= n
            found.append(hashed[ok])
            owners.append(owner[ok])
        coded = np.append(coded[1:], np.uint64(0))
    flat, who = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    flat, counts = flat[order], np.bincount(who, minlength=len(words))
    return ((flat >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int32), np.cumsum(counts) - counts


def grams_in_parts(words: list[str], size: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """grams_of, a part of the words at a time, to bound what it holds besides its result."""
    parts = [grams_of(words[lo : lo + size]) for lo in range(0, len(words), size)]
    starts = np.cumsum([0] + [len(g) for g, _ in parts])
    return np.concatenate([g for g, _ in parts]), np.concatenate([f + s for (_, f), s in zip(parts, starts, strict=False)])


class Model:
    """z(word), the word's share of a window's margin, from n-gram vectors and softmax weights; scale and bias of the text's margin."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, scale: float, bias: float) -> None:
        self.vectors, self.weights = vectors, weights
        self.along = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
        self.scale, self.bias = scale, bias

    @classmethod
    def of(cls, along: np.ndarray, scale: float, bias: float) -> Model:
        model = cls.__new__(cls)
        model.along, model.scale, model.bias = along, scale, bias
        return model

    def word_logits(self, words: list[str]) -> np.ndarray:
        grams, first = grams_of(words)
        counts = np.diff(np.append(first, len(grams)))
        return np.add.reduceat(self.along[grams], first) / counts


class Bags:
    """Training texts: the n-grams of each distinct word, and each text as word numbers."""

    def __init__(self, texts: Iterable[list[str]]) -> None:
        vocab: dict[str, int] = {}
        self.docs = [np.array([vocab.setdefault(w, len(vocab)) for w in x], dtype=np.int32) for x in texts]
        self.grams, self.first = grams_in_parts(list(vocab)) if vocab else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))
        self.size = np.diff(np.append(self.first, len(self.grams)))

    def of_words(self, used: np.ndarray) -> np.ndarray:
        """Places of the n-grams of the used words, one word's after the other's."""
        return spread(self.first[used], self.size[used])

    def margins(self, vectors: np.ndarray, weights: np.ndarray, bias: float, which: np.ndarray) -> np.ndarray:
        """The margin of the most toxic window of each text; none may be empty."""
        along, out = vectors @ (weights[:, 1] - weights[:, 0]), []
        for part in np.array_split(which, max(1, len(which) // 500)):
            if not len(part):
                continue
            used, at = np.unique(np.concatenate([self.docs[i] for i in part]), return_inverse=True)
            begin = np.cumsum(self.size[used]) - self.size[used]
            logit = (np.add.reduceat(along[self.grams[self.of_words(used)]], begin) / self.size[used])[at]
            starts, wide, opens = windows(np.array([len(self.docs[i]) for i in part]))
            out.append(np.maximum.reduceat(np.add.reduceat(logit, starts) / wide, opens))
        return np.concatenate(out) + bias if out else np.zeros(0)


def descend(bags: Bags, labels: np.ndarray, which: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """Vectors, softmax weights and the toxic class's bias over the other's after EPOCHS of joint gradient descent over the windows of the texts in which."""
    vectors = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    weights = ((rng.random((DIM, 2)) - 0.5) * 2 / np.sqrt(DIM)).astype(np.float32)
    bias, place_of = np.zeros(2, dtype=np.float32), np.full(BUCKETS, -1, dtype=np.int32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(which), max(1, len(which) // BATCH)):
            used, at = np.unique(np.concatenate([bags.docs[i] for i in part]), return_inverse=True)
            places, size = bags.grams[bags.of_words(used)], bags.size[used]
            place_of[places] = 0  # np.unique would sort
            rows = np.flatnonzero(place_of == 0)
            place_of[rows] = np.arange(1, len(rows) + 1)
            inverse = place_of[places] - 1
            place_of[rows] = -1
            lengths = np.array([len(bags.docs[i]) for i in part])
            starts, wide, _ = windows(lengths)
            # means of vectors times weights are means of products, which have two columns only
            product, begin, power = vectors[rows] @ weights, np.cumsum(size) - size, []
            for k in (0, 1):
                word = np.add.reduceat(product[:, k][inverse], begin) / size
                power.append(np.add.reduceat(word[at], starts) / wide + bias[k])
            of = np.repeat(labels[part], -(-lengths // WINDOW))
            toxic = 1 / (1 + np.exp(np.clip(power[0] - power[1], -30, 30))) - of
            delta = np.stack([-toxic, toxic], axis=1)
            of_word = np.bincount(at, weights=np.repeat(toxic / wide, wide), minlength=len(used))
            of_row = np.bincount(inverse, weights=np.repeat(of_word / size, size), minlength=len(rows)).astype(np.float32)
            of_row = np.stack([-of_row, of_row], axis=1)
            # a bound of the loss's curvature along each n-gram scales its step: frequent ones do not overshoot, and one
            # that few windows hold moves by its gradient over DAMPING, so little
            share = np.bincount(at, weights=np.repeat(1 / wide, wide), minlength=len(used)) / size
            curve = np.bincount(inverse, weights=np.repeat(share, size), minlength=len(rows)) * np.square(weights[:, 1] - weights[:, 0]).sum() / 4
            step = (vectors[rows].T @ of_row) / len(of)
            vectors[rows] -= rate * ((of_row @ weights.T / (curve + DAMPING)[:, None]).astype(np.float32) + DECAY * vectors[rows])
            weights -= rate * (step.astype(np.float32) + DECAY * weights)
            bias -= rate * delta.mean(axis=0)
    return vectors, weights, float(bias[1] - bias[0])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and bias of the logistic regression of y on x, by Newton steps; a weak prior keeps the scale finite."""
    middle, spread_of = x.mean(), x.std() + 1e-9
    z = np.stack([(x - middle) / spread_of, np.ones(len(x))], axis=1)
    w, prior = np.zeros(2), np.array([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(prior), z.T @ (p - y) + prior * w)
    return float(w[0] / spread_of), float(w[1] - w[0] * middle / spread_of)


def train(texts: Iterable[list[str]], labels: np.ndarray, seed: int = 7) -> Model:
    """texts: the words of each text, taken one by one. One class only, or no rows: every text gets the share of toxic labels."""
    rng = np.random.default_rng(seed)
    bags = Bags(texts)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    filled = np.array([i for i, x in enumerate(bags.docs) if len(x)], dtype=np.int64)
    known = labels[filled]
    if min(known.sum(), (1 - known).sum()) < 1:
        return Model(np.zeros((1, DIM), dtype=np.float32).repeat(BUCKETS, axis=0), np.zeros((DIM, 2), dtype=np.float32), 0.0, float(np.log(share / (1 - share))))
    fold = np.zeros(len(filled), dtype=np.int64)
    dealt = np.concatenate([rng.permutation(np.flatnonzero(known == y)) for y in (0, 1)])  # each fold gets its part of either label
    fold[dealt] = np.arange(len(dealt)) % FOLDS
    unseen, made = np.zeros(len(filled)), []
    for k in range(FOLDS):
        held = fold == k
        made.append(descend(bags, labels, filled[~held], rng))
        unseen[held] = bags.margins(*made[-1], filled[held])
    scale, bias = logistic(unseen, known)
    # the mean of the models is one with their vectors side by side
    vectors, weights = np.concatenate([v for v, _, _ in made], axis=1), np.concatenate([w for _, w, _ in made]) / FOLDS
    scale = max(scale, 0.0)
    return Model(vectors, weights, scale, bias + scale * float(np.mean([b for _, _, b in made])))


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0] .. first[0]+size[0]-1, first[1] .. and so on."""
    begin = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(begin - first, size)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and widths of all windows of texts of the given (positive) lengths laid in a row; each text's first window."""
    n = -(-lengths // WINDOW)
    opens = np.cumsum(n) - n
    starts = np.repeat(np.cumsum(lengths) - lengths - opens * WINDOW, n) + np.arange(n.sum()) * WINDOW
    return starts, np.diff(np.append(starts, lengths.sum())), opens


class Scorer:
    """Scores of texts; what each word adds is kept, up to CACHE_SIZE words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        docs = [words_of(x) for x in texts]
        known = self.known
        if missing := list({w for x in docs for w in x if w not in known}):
            if len(known) + len(missing) > CACHE_SIZE:
                known.clear()
                missing = list({w for x in docs for w in x})
            for lo in range(0, len(missing), 100_000):
                part = missing[lo : lo + 100_000]
                known.update(zip(part, self.model.word_logits(part).tolist(), strict=True))
        margin = np.full(len(texts), self.model.bias)
        filled = [i for i, x in enumerate(docs) if x]
        if filled:
            logits = np.array([known[w] for i in filled for w in docs[i]])
            starts, wide, opens = windows(np.array([len(docs[i]) for i in filled]))
            margin[filled] += self.model.scale * np.maximum.reduceat(np.add.reduceat(logits, starts) / wide, opens)
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def in_fold(id_col: str, folds: int = 5) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % folds


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """A model of at most train_docs labelled texts: those with the smallest hashes of their ids.

    A text with several labels counts as toxic if one says so; null labels and ids, and labels without a text, are
    left out.
    """
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__label"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(train_docs)
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)

    def start():
        return lambda texts: [[" ".join(words_of(x)) for x in texts]]

    table = map_text(rows, text_col, [id_col, "__label"], [("__words", T.StringType())], start).orderBy(F.xxhash64(id_col), id_col).limit(train_docs).toPandas()
    return train((x.split(" ") if x else [] for x in table["__words"]), table["__label"].to_numpy(dtype=np.float32))


def toxicity_scores(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The kept columns and score_col: 0 to 1, higher where a toxic label is likelier. No or empty text: the base rate."""
    sent, name = docs.sparkSession.sparkContext.broadcast((model.along, model.scale, model.bias)), uuid.uuid4().hex

    def start():
        scorer = held(("toxicity", name), lambda: Scorer(Model.of(*sent.value)))
        return lambda texts: [scorer.scores(texts).tolist()]

    return map_text(docs, text_col, keep, [(score_col, T.DoubleType())], start)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs; only labels outside fold 0 of 5 are learned from."""
    model = fit(docs, labels.filter(in_fold(id_col) != 0), id_col, text_col, label_col, train_docs)
    scored = toxicity_scores(docs, model, [id_col], text_col)
    return scored.select(id_col, F.coalesce(in_fold(id_col) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
