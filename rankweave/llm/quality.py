"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text.  Expectation-maximisation
over the counts of all vote patterns estimates, without any given label, how accurate each labeller
is; the posteriors of a bounded sample of texts then train a linear scorer on hashed features, which
scores every text, also those on which no labeller votes.

Only the patterns (at most 3 to the number of labellers) reach the driver for the estimate, whatever
the number of rows; ``train_docs`` bounds the scorer's sample.  Texts are read whole.

Defined results: null text, empty text and text of white space only: score 0 and rejected.  With no
other text there is no model and nothing else to score.  Equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.textbatch import code_points, column, slices, starts_of, sums, trimmed, use_memory

BUCKETS = 1024
BATCH_CHARS = 500_000
FULL_WORDS = 12  #: words from which a text speaks for itself
LABELLERS = ("symbols", "lone_marks", "capitals", "echo", "runs", "shouting", "sentences", "marked_words")
GAP, LOWER, UPPER, DIGIT, STOP, LINE, OTHER = range(7)  #: shapes; further marks have their own

_SHAPES: list[np.ndarray] = []


def _shapes() -> np.ndarray:
    """The shape of every code point: kinds of letters, digits and gaps, and each ASCII mark alone."""
    if not _SHAPES:
        out = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isspace():
                out[cp] = LINE if c == "\n" else GAP
            elif c.isalpha():
                out[cp] = UPPER if c.isupper() else LOWER
            elif c.isdigit():
                out[cp] = DIGIT
        for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
            out[ord(c)] = STOP if c in ".,;:?'\"-()" else OTHER + 1 + i
        _SHAPES.append(out)
    return _SHAPES[0]


def _per_text(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The labellers' votes (1, -1 or 0 by text and labeller), the hashed features and the words by text."""
    flat, lengths = code_points(texts)
    shape = _shapes()[flat]
    n_texts = len(texts)
    owner = np.repeat(np.arange(n_texts), lengths)

    def of(mask: np.ndarray) -> np.ndarray:
        return sums(mask, lengths).astype(np.float64)

    gap = (shape == GAP) | (shape == LINE)
    inked = ~gap
    before, after = np.ones_like(gap), np.ones_like(gap)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    full = lengths > 0
    first_at = starts_of(lengths)[full]
    before[first_at] = True
    after[first_at + lengths[full] - 1] = True
    begins, ends = inked & before, inked & after
    word_at, word_end = np.flatnonzero(begins), np.flatnonzero(ends)
    word_owner = owner[word_at]
    letters = (shape == LOWER) | (shape == UPPER)
    marks = (shape >= OTHER) & inked

    def by_word(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[word_end + 1] - total[word_at]

    size = word_end - word_at + 1
    alnum = by_word(letters | (shape == DIGIT))
    marked = by_word(marks)
    mixed = flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mixed * inked, out=total[1:])
    word_key = (total[word_end + 1] - total[word_at]) * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
    same = np.zeros(len(word_key), bool)
    same[1:] = (word_key[1:] == word_key[:-1]) & (word_owner[1:] == word_owner[:-1])

    thrice = same.copy()
    thrice[1:] &= same[:-1]

    def words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(word_owner[mask], minlength=n_texts).astype(np.float64)

    n_words = np.maximum(np.bincount(word_owner, minlength=n_texts), 1).astype(np.float64)
    n_inked, n_letters = np.maximum(of(inked), 1), np.maximum(of(letters), 1)
    lone = words(alnum == 0) / n_words
    echo = words(same) / n_words
    ending = words(shape[word_end] == STOP) / n_words
    tagged = words((alnum > 0) & (marked >= 2)) / n_words
    symbols = of(marks) / n_inked
    capitals = of(shape == UPPER) / n_letters
    bangs = of(flat == ord("!")) / n_words

    votes = np.zeros((n_texts, len(LABELLERS)), np.int8)

    def vote(k: str, good: np.ndarray, bad: np.ndarray) -> None:
        votes[:, LABELLERS.index(k)] = good.astype(np.int8) - bad.astype(np.int8)

    vote("symbols", symbols < 0.02, symbols > 0.05)
    vote("lone_marks", lone < 0.02, lone > 0.08)
    vote("capitals", (capitals < 0.15) & (n_letters > 40), (capitals > 0.3) & (n_letters > 10))
    vote("echo", echo < 0.03, echo > 0.12)
    vote("runs", np.zeros(n_texts, bool), words(thrice) > 0.08 * n_words)
    vote("shouting", np.zeros(n_texts, bool), bangs > 0.1)
    vote("sentences", (ending > 0.02) & (ending < 0.4) & (n_words > 8), ((ending < 0.005) | (ending > 0.7)) & (n_words > 30))
    vote("marked_words", tagged < 0.02, tagged > 0.08)

    window = np.zeros((4, len(shape)), np.int64)
    for k in range(4):
        window[k, : len(shape) - k] = shape[k:]
    code = ((window[0] * 41 + window[1]) * 41 + window[2]) * 41 + window[3]
    inside = np.arange(len(shape)) < np.repeat(starts_of(lengths) + lengths - 3, lengths)
    half = BUCKETS // 2
    bucket = (code * 2654435761 >> 11) % half
    counts = np.bincount((owner * half + bucket)[inside], minlength=n_texts * half).reshape(n_texts, half)
    word_shape = np.minimum(size, 15) * 64 + np.minimum(marked, 3) * 16 + (shape[word_at] == UPPER) * 8 + same * 4 + (alnum == 0) * 2 + (shape[word_end] == STOP)
    word_bucket = (word_shape * 2654435761 >> 7) % half
    word_counts = np.bincount(word_owner * half + word_bucket, minlength=n_texts * half).reshape(n_texts, half)
    features = np.concatenate([counts / np.maximum(counts.sum(1, keepdims=True), 1), word_counts / n_words[:, None]], axis=1)
    votes[of(inked) == 0] = 0
    return votes, np.sqrt(features).astype(np.float32), n_words


def _blank(text: str | None) -> bool:
    return not text or text.isspace()


@dataclass
class WeakLabels:
    """What the estimate found: how often texts are good, and each labeller's votes given that."""

    prior: float = 0.5
    given_good: np.ndarray = field(default_factory=lambda: np.full((len(LABELLERS), 3), 1 / 3))
    given_bad: np.ndarray = field(default_factory=lambda: np.full((len(LABELLERS), 3), 1 / 3))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability that each text is good, from its votes."""
        k = np.arange(len(LABELLERS))
        good = np.log(self.prior) + np.log(self.given_good)[k, votes + 1].sum(1)
        bad = np.log1p(-self.prior) + np.log(self.given_bad)[k, votes + 1].sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller: how often its votes are right."""
        right = self.prior * self.given_good[:, 2] + (1 - self.prior) * self.given_bad[:, 0]
        wrong = self.prior * self.given_good[:, 0] + (1 - self.prior) * self.given_bad[:, 2]
        return right / (right + wrong)


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 200) -> WeakLabels:
    """Expectation-maximisation over vote patterns; it starts from bad votes being seldom wrong."""
    out = WeakLabels()
    if not len(votes):
        return out
    good = np.clip(0.97 * 0.3 ** (votes < 0).sum(1), 0.03, 0.97)
    hot = (votes[:, :, None] + 1) == np.arange(3)
    for _ in range(rounds):
        w1, w0 = weight * good, weight * (1 - good)
        out.prior = float(np.clip(w1.sum() / weight.sum(), 0.02, 0.98))
        out.given_good = (np.einsum("p,pkv->kv", w1, hot) + 0.5) / (w1.sum() + 1.5)
        out.given_bad = (np.einsum("p,pkv->kv", w0, hot) + 0.5) / (w0.sum() + 1.5)
        new = out.posterior(votes)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return out


@dataclass
class QualityModel:
    weak: WeakLabels
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """The probability that each text is good; few words say little, so there the prior counts too."""
        trust = np.minimum(1.0, n_words / FULL_WORDS)
        prior = np.log(self.weak.prior) - np.log1p(-self.weak.prior)
        logit = trust * (features @ self.weights + self.bias) + (1 - trust) * prior
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit_linear(features: np.ndarray, target: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by accelerated full-batch descent, both classes of equal weight."""
    x = np.concatenate([features, np.ones((len(features), 1), np.float32)], axis=1)
    weight = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    weight /= weight.sum()
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    weight, target = weight.astype(np.float32), target.astype(np.float32)
    rate = 4.0 / ((x * x).sum(1).max() + 1e-9)
    for step in range(steps):
        ahead = w + v * (step / (step + 3))
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -60, 60)))
        new = ahead - rate * (x.T @ (weight * (p - target)) + ridge * np.append(ahead[:-1], np.float32(0)))
        v, w = new - w, new
    return w[:-1].astype(np.float64), float(w[-1])


def _votes(docs: DataFrame, text: str) -> DataFrame:
    """The vote pattern of every text that isn't blank, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("quality")
        for whole in batches:
            texts = [t for t in column(whole, text) if not _blank(t)]
            for lo, hi in slices([len(t) for t in texts], BATCH_CHARS):
                votes = _per_text(texts[lo:hi])[0]
                kinds, counts = np.unique(votes, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in kinds], pa.binary()), pa.array(counts.astype(np.int64))], names=["pattern", "n"])

    return docs.select(text).mapInArrow(trimmed(run), "pattern binary, n long")


def train(docs: DataFrame, text: str = "text", train_docs: int = 2000) -> QualityModel:
    """``train_docs`` bounds the distinct texts, picked by their hash, that fit the linear scorer;
    the labellers' accuracies come from all rows."""
    counted = _votes(docs, text).groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    votes = np.array([np.frombuffer(r["pattern"], np.int8) for r in counted], np.int8).reshape(-1, len(LABELLERS))
    order = np.lexsort(votes.T)
    weight = np.array([r["n"] for r in counted], np.float64)[order]
    votes = votes[order]
    weak = estimate(votes, weight)
    total = weight.sum()
    if not total:
        return QualityModel(weak, np.zeros(BUCKETS), 0.0)
    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.lit(29), F.col(text)).alias("x"), F.col(text).alias("t"))
    hashed = F.pmod("x", F.lit(1 << 30)).alias("h")
    drawn = texts.select("x").distinct().orderBy(hashed, "x").limit(3 * train_docs // 2).collect()  # more than train_docs, as blank ones go
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in drawn], "x long")
    rows = texts.join(F.broadcast(wanted), "x").groupBy("x").agg(F.min("t").alias("t")).select("t", hashed)  # copies count once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("quality")
        for whole in batches:
            kept = [(t, h) for t, h in zip(column(whole, "t"), column(whole, "h"), strict=True) if not _blank(t)]
            for lo, hi in slices([len(t) for t, _ in kept], BATCH_CHARS):
                found, features, _ = _per_text([t for t, _ in kept[lo:hi]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for _, h in kept[lo:hi]], pa.int64()), pa.array([v.tobytes() for v in found], pa.binary()), pa.array([f.tobytes() for f in features], pa.binary())],
                    names=["h", "votes", "features"],
                )

    best = rows.mapInArrow(trimmed(run), "h long, votes binary, features binary").orderBy("h", "features").limit(train_docs).collect()
    found = np.array([np.frombuffer(r["votes"], np.int8) for r in best], np.int8).reshape(-1, len(LABELLERS))
    features = np.array([np.frombuffer(r["features"], np.float32) for r in best], np.float32).reshape(-1, BUCKETS)
    weights, bias = fit_linear(features, weak.posterior(found))
    return QualityModel(weak, weights, bias)


def classify(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.25) -> DataFrame:
    """``docs`` with quality_score (0 to 1), weak_posterior and kept; columns of these names are replaced."""
    added = ["quality_score", "weak_posterior", "kept"]
    base = docs.drop(*added)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use_memory("quality")
        for whole in batches:
            texts = column(whole, text)
            for lo, hi in slices([len(t or "") for t in texts], BATCH_CHARS):
                votes, features, n_words = _per_text([t or "" for t in texts[lo:hi]])
                blank = np.array([_blank(t) for t in texts[lo:hi]], bool)
                score = np.where(blank, 0.0, model.score(features, n_words))
                posterior = np.where(blank, 0.0, model.weak.posterior(votes))
                part = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score), pa.array(posterior), pa.array(score >= threshold)], names=[*names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(trimmed(run), f"{fields}, quality_score double, weak_posterior double, kept boolean")
