"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. A label model, fitted by expectation
maximisation on the counts of all vote patterns, estimates how often each labeller votes what given the
hidden class; its posterior labels train a linear scorer on hashed character n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.llm import chars
from brandsieve.llm.common import checkpointed

BAD, NOTHING, GOOD = 0, 1, 2
LABELLERS = ["symbols", "capitals", "bars", "exclaims", "repeats", "word_length", "stops"]
SYMBOLS = "#$%&*@~^=_<>{}[]\\"
ROUNDS = 500
#: Pseudo-rows of each vote share.
PRIOR = 1.0
#: Where every labeller has a fault of its own, its threshold is set wide: the prior of the share of good texts that it
#: calls bad, worth so many pseudo-rows for each row. It decides where the votes do not, and does not bound.
FALSE_ALARM, WORTH = 0.002, 0.3
#: Pseudo-rows of the votes of a labeller on its own fault, and on the faults of others: bad, good.
OWN, OTHERS = (2.0, 0.1), (0.02, 0.1)
BITS = 16
SIZES = (1, 2)
#: Bound of the training sample, gathered on the driver: rows for each of the two posterior classes.
ROWS_PER_CLASS = 2000
EPOCHS, RATE, SEED = 8, 0.5, 13


@lru_cache(maxsize=1)
def _uppers() -> np.ndarray:
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), np.bool_, 0x110000)


@dataclass
class Profile:
    """Measures of a text: words, shares of symbols and capitals, bars and exclamation marks a word,
    share of distinct words, mean word length, share of words that end a sentence."""

    words: int
    symbols: float
    capitals: float
    bars: float
    exclaims: float
    fresh: float
    mean: float
    stops: float


def profile(text: str) -> Profile:
    words, points = text.split(), np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n, size = max(1, len(words)), max(1, sum(map(len, words)))
    letters = max(1, int(chars.letters()[points].sum()))
    return Profile(
        words=len(words),
        symbols=sum(map(text.count, SYMBOLS)) / size,
        capitals=int(_uppers()[points].sum()) / letters,
        bars=text.count("|") / n,
        exclaims=text.count("!") / n,
        fresh=len(set(words)) / n,
        mean=size / n,
        stops=sum(w.endswith((".", "?", "!", ":")) for w in words) / n,
    )


def votes(text: str | None) -> list[int]:
    """What each labeller says, in the order of LABELLERS; a text without words is bad to the last three."""
    p = profile(text or "")
    if not p.words:
        return [NOTHING] * 4 + [BAD] * 3
    long = p.words >= 20
    return [
        BAD if p.symbols > 0.05 else GOOD if p.symbols < 0.01 else NOTHING,
        BAD if p.capitals > 0.4 else GOOD if p.capitals < 0.15 else NOTHING,
        BAD if p.bars > 0.2 else GOOD if p.bars < 0.02 else NOTHING,
        BAD if p.exclaims > 0.3 else GOOD if p.exclaims < 0.05 else NOTHING,
        NOTHING if not long else BAD if p.fresh < 0.4 else GOOD if p.fresh > 0.6 else NOTHING,
        BAD if not 2 <= p.mean <= 9.5 else GOOD if 3 <= p.mean <= 8 else NOTHING,
        NOTHING if not long else BAD if not 0.005 <= p.stops <= 0.5 else GOOD,
    ]


@dataclass
class _Votes:
    """Vote patterns and how often each occurs; bad and good votes by pattern and labeller."""

    bad: np.ndarray
    good: np.ndarray
    count: np.ndarray

    def fitted(self, posterior: np.ndarray, bad_prior: np.ndarray, good_prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior by pattern and class, and bad-vote shares by labeller and class.

        Expectation maximisation takes class and vote shares from posteriors and posteriors from them. Only
        votes count as evidence, their absence does not.
        """
        classes = posterior.shape[1]
        shares = np.zeros(bad_prior.shape)
        for _ in range(ROUNDS):
            weight = self.count[:, None] * posterior
            bad, good = self.bad.T @ weight + bad_prior, self.good.T @ weight + good_prior
            shares = bad / (bad + good)
            sizes = (weight.sum(axis=0) + 0.1) / (weight.sum() + 0.1 * classes)
            log = self.bad @ np.log(shares) + self.good @ np.log(1 - shares) + np.log(sizes)
            new = np.exp(log - log.max(axis=1, keepdims=True))
            new /= new.sum(axis=1, keepdims=True)
            moved, posterior = np.abs(new - posterior).max(initial=0), new
            if moved < 1e-9:
                break
        return posterior, shares


def label_model(patterns: dict[tuple[int, ...], int]) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior probability of good for each vote pattern; bad-vote shares by labeller and hidden class (good first).

    Two models are fitted. One has a hidden class good and one bad, about which all labellers vote; it counts if
    each labeller is better than a coin on either. The other has good and one kind of fault for each labeller, of which some are seen by others too, so that
    overlapping labellers are not taken for independent ones. Every share is estimated from the votes; priors decide
    only where these do not.
    """
    keys, n = sorted(patterns), len(next(iter(patterns), LABELLERS))
    seen, count = np.array(keys).reshape(len(keys), n), np.array([patterns[k] for k in keys], float)
    votes_ = _Votes((seen == BAD).astype(float), (seen == GOOD).astype(float), count)
    share = (votes_.bad.sum(axis=1) + 0.5) / (votes_.bad.sum(axis=1) + votes_.good.sum(axis=1) + 1)
    flat = np.full((n, 2), PRIOR)
    two = votes_.fitted(np.stack((1 - share, share), axis=1), flat, flat)
    named = np.hstack((np.where(votes_.bad.any(axis=1, keepdims=True), 0.0, 1.0), votes_.bad)) + 1e-3
    bad_prior, good_prior, own = np.full((n, n + 1), OTHERS[0]), np.full((n, n + 1), OTHERS[1]), np.arange(n)
    bad_prior[own, own + 1], good_prior[own, own + 1] = OWN
    rows = WORTH * count.sum()
    bad_prior[:, 0], good_prior[:, 0] = FALSE_ALARM * rows + 0.01, rows + 1
    faults = votes_.fitted(named / named.sum(axis=1, keepdims=True), bad_prior, good_prior)
    of_one_mind = ((two[1][:, 0] < 0.5) & (two[1][:, 1] > 0.5)).all()
    posterior, shares = two if of_one_mind else faults
    return dict(zip(keys, posterior[:, 0].tolist(), strict=True)), shares


def _bins(p: Profile) -> list[int]:
    """One bucket behind the hashed ones for each measure and its level."""
    levels = [min(15, p.words.bit_length()), *(min(15, int(16 * x)) for x in (p.symbols * 4, p.capitals, p.bars, p.exclaims, p.fresh, p.mean / 16, p.stops))]
    return [(1 << BITS) + 16 * k + level for k, level in enumerate(levels)]


BUCKETS = (1 << BITS) + 16 * 8


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's character n-grams with their shares, and of its measures with one each."""
    text = text or ""
    counts = np.zeros(1 << BITS, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    for at in range(0, len(points), chars.PIECE):
        for n in SIZES:
            part = points[at : at + chars.PIECE + n - 1]
            size = len(part) - n + 1
            if size > 0:
                hashes = np.full(size, n, np.uint64)
                for i in range(n):
                    hashes = hashes * np.uint64(1_000_003) + part[i : i + size]
                counts += np.bincount(chars.spread(hashes, BITS), minlength=1 << BITS)
    used, total = np.nonzero(counts)[0], max(1, counts.sum())
    bins = _bins(profile(text))
    return np.concatenate((used, bins)).astype(np.int32), np.concatenate((counts[used] / total, np.ones(len(bins)))).astype(np.float32)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Probability that the text is good."""
        used, value = bag(text)
        return float(1 / (1 + np.exp(-np.clip(value @ self.weights[used] + self.bias, -30, 30))))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> Scorer:
    """Logistic regression on soft labels by stochastic gradient descent."""
    rng, weights, bias = np.random.default_rng(SEED), np.zeros(BUCKETS, np.float32), 0.0
    steps, step = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            used, value = rows[i]
            error = 1 / (1 + np.exp(-np.clip(value @ weights[used] + bias, -30, 30))) - good[i]
            rate = RATE * (1 - step / steps)
            weights[used] -= np.float32(rate * error) * np.where(used < 1 << BITS, 30 * value, 0.1 * value)
            bias -= 0.1 * rate * error
            step += 1
    return Scorer(weights, bias)


def _key() -> Column:
    return F.xxhash64(F.lit(17), "doc_id", "text")


def vote_table(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the row) and pattern (votes as digits) per row of ``docs``."""
    source = docs.select(docs["doc_id"], docs["text"].alias("text")).withColumn("key", _key())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns = ["".join(map(str, votes(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(patterns, pa.string())], ["doc_id", "key", "pattern"])

    return source.mapInArrow(run, source.select("doc_id", "key", F.lit("").alias("pattern")).schema)


def train(docs: DataFrame) -> tuple[Scorer, dict[tuple[int, ...], float], DataFrame]:
    """(scorer, posterior by pattern, votes): the label model reads every row, the scorer a bounded sample.

    There are at most 3^7 vote patterns. Sampled rows are drawn by a hash, ROWS_PER_CLASS for each
    posterior class, and their keys (at most four times that) are broadcast to pick the texts.
    """
    table = checkpointed(vote_table(docs))
    patterns = {tuple(map(int, r["pattern"])): r["count"] for r in table.groupBy("pattern").count().collect()}
    posterior, _ = label_model(patterns)
    counts = [max(1, sum(n for p, n in patterns.items() if (posterior[p] >= 0.5) == side)) for side in (False, True)]
    rows = [("".join(map(str, p)), g, min(1.0, ROWS_PER_CLASS / counts[g >= 0.5])) for p, g in sorted(posterior.items())]
    known = docs.sparkSession.createDataFrame(rows, "pattern string, good double, chance double")
    drawn = (
        table.join(F.broadcast(known), "pattern")
        .where(F.pmod(F.shiftrightunsigned("key", 10), F.lit(1 << 20)) < F.col("chance") * (1 << 20))
        .select("key", "good")
        .limit(4 * ROWS_PER_CLASS)
        .distinct()
    )
    source = docs.select(docs["doc_id"], docs["text"].alias("text")).select("text", _key().alias("key")).join(F.broadcast(drawn), "key").limit(8 * ROWS_PER_CLASS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t.as_py()) for t in batch.column("text")]
            arrays = [batch.column("key"), batch.column("good"), pa.array([b.tobytes() for b, _ in bags], pa.binary()), pa.array([v.tobytes() for _, v in bags], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "good", "buckets", "shares"])

    sample = sorted((r["key"], r["good"], r["buckets"], r["shares"]) for r in source.mapInArrow(run, "key long, good double, buckets binary, shares binary").toLocalIterator())
    bags = [(np.frombuffer(b, np.int32), np.frombuffer(v, np.float32)) for _, _, b, v in sample]
    return fit_scorer(bags, np.array([r[1] for r in sample])), posterior, table


def classify(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, pattern (the votes), score (probability of good), good (score of one half and more).

    Whole texts are read. Null and empty texts are scored as a text without words; repeated rows are
    scored alike; an empty table gives an empty result. Only doc_id and text are read.
    """
    scorer, _, _ = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    source = docs.select(docs["doc_id"], docs["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            scores = np.array([shared.value.score(t) for t in texts], float)
            patterns = ["".join(map(str, votes(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(patterns, pa.string()), pa.array(scores, pa.float64()), pa.array(scores >= 0.5, pa.bool_())], ["doc_id", "pattern", "score", "good"])

    return source.mapInArrow(run, source.select("doc_id", F.lit("").alias("pattern"), F.lit(0.0).alias("score"), F.lit(True).alias("good")).schema)
