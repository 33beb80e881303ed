"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on hashed words. Each later model also
gets the probabilities of the categories before it. In training these come from models that have not
seen the row (out-of-fold), so that a model does not learn to trust fits to its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandsieve.llm import chars

# Words of the categories below ``toxic``, in the order of the chain.
CATEGORY_WORDS = {
    "insult": ["idiot", "moron", "stupid", "clown", "loser"],
    "contempt": ["trash", "scum", "worthless", "pathetic", "disgusting"],
}
TARGET = "toxic"
#: Bounds of the training sample, gathered on the driver: labelled rows per value of the label.
ROWS_PER_VALUE = 4000
#: Word hashes that a model may use: those whose presence differs most between its classes.
FEATURES = 512
HASH_BITS = 40
FOLDS = 4
RIDGE = 1.0
THRESHOLD = 0.5


def word_set(text: str | None) -> np.ndarray:
    """Distinct word hashes of a text."""
    found = [np.unique(h) for h in chars.words(text, HASH_BITS)] if text else []
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


@dataclass
class Link:
    """One model of the chain: word features, then the categories before it, then the constant."""

    features: np.ndarray
    weights: np.ndarray


@dataclass
class Chain:
    names: list[str]
    links: list[Link] = field(default_factory=list)

    def predict(self, text: str | None) -> list[float]:
        """Probability of each category, in order."""
        present, before = word_set(text), []
        for link in self.links:
            words = np.isin(link.features, present, assume_unique=True).astype(float)
            before.append(float(_probability(np.concatenate((words, before, [1.0])) @ link.weights)))
        return before


def _probability(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Bags:
    """Rows as sets of word numbers; words in fewer than three rows are left out."""

    def __init__(self, rows: list[np.ndarray]):
        every, number, count = np.unique(np.concatenate([np.empty(0, np.int64), *rows]), return_inverse=True, return_counts=True)
        kept = count >= 3
        self.hashes, self.count = every[kept], len(rows)
        place = np.where(kept, np.cumsum(kept) - 1, -1)[number]
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.word, self.row = place[place >= 0], row[place >= 0]

    def select(self, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Numbers of the words whose share of rows differs most, in standard errors, between the classes."""
        inside = np.isin(self.row, rows)
        word, label = self.word[inside], y[self.row[inside]]
        n1, n0 = max(1, y[rows].sum()), max(1, (1 - y[rows]).sum())
        with1, all_ = np.bincount(word, label, len(self.hashes)), np.bincount(word, minlength=len(self.hashes))
        mean = all_ / (n1 + n0)
        z = np.abs(with1 / n1 - (all_ - with1) / n0) / np.sqrt(np.maximum(1e-9, mean * (1 - mean)) * (1 / n1 + 1 / n0))
        return np.sort(np.argsort(-z, kind="stable")[:FEATURES])

    def matrix(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """All rows: presence of ``words``, the categories before, the constant."""
        column = np.full(len(self.hashes) + 1, -1)
        column[words] = np.arange(len(words))
        at = column[self.word]
        x = np.zeros((self.count, len(words)))
        x[self.row[at >= 0], at[at >= 0]] = 1
        return np.hstack((x, before, np.ones((self.count, 1))))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant is not penalised."""
    weights, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(12):
        p = _probability(x @ weights)
        slope = x.T @ (p - y) + ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-4:
            break
    return weights


def fit_chain(names: list[str], rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """The chain for ``labels`` (row x category, 0 or 1), with out-of-fold inputs between its links."""
    chain, bags, before, every = Chain(names), Bags(rows), np.zeros((len(rows), 0)), np.arange(len(rows))
    for k in range(len(names)):
        y, out = labels[:, k].astype(float), np.zeros(len(rows))
        for fold in range(FOLDS):
            inside, outside = every[folds != fold], every[folds == fold]
            x = bags.matrix(bags.select(y, inside), before)
            out[outside] = _probability(x[outside] @ _fit(x[inside], y[inside]))
        words = bags.select(y, every)
        chain.links.append(Link(bags.hashes[words], _fit(bags.matrix(words, before), y)))
        before = np.column_stack((before, out))
    return chain


def train(docs: DataFrame, labels: DataFrame) -> Chain:
    """Chain learned from a bounded sample of ``labels`` (doc_id, toxic) and their texts.

    The ids are drawn by a hash, ROWS_PER_VALUE for each value of the label, and broadcast (at most
    twice that many rows) to pick their texts; rows with a null label or text are left out. A category
    below ``toxic`` is true of a toxic row that has one of its words. Without labels every probability
    is one half.
    """
    known = labels.select("doc_id", F.col(TARGET).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, ROWS_PER_VALUE / counts.get(1, 1)))).otherwise(F.lit(min(1.0, ROWS_PER_VALUE / counts.get(0, 1))))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).limit(4 * ROWS_PER_VALUE)
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y"))
    source = docs.select(docs["doc_id"], docs["text"]).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").limit(8 * ROWS_PER_VALUE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_set(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(words, pa.binary())], ["doc_id", "y", "words"])

    kind = source.schema["doc_id"].dataType.simpleString()
    sample = sorted((r["doc_id"], r["y"], r["words"]) for r in source.mapInArrow(run, f"doc_id {kind}, y int, words binary").toLocalIterator())
    rows = [np.frombuffer(w, np.int64) for _, _, w in sample]
    y = np.array([r[1] for r in sample], int)
    named = [np.isin(y, 1) & np.array([np.isin(word_set(" ".join(words)), r).any() for r in rows], bool) for words in CATEGORY_WORDS.values()]
    folds = np.random.default_rng(1).permutation(len(rows)) % FOLDS
    return fit_chain([*CATEGORY_WORDS, TARGET], rows, np.column_stack([*named, y]).astype(int), folds)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Per row of ``docs``: doc_id, p_<category> for each category of the chain, toxic (boolean).

    A row is toxic if its last probability is THRESHOLD or more and above that of an empty text. Whole
    texts are read. Texts that are null, empty or without words get the probabilities of a text without
    any known word and are not toxic; repeated rows are scored alike; an empty table gives an empty result. Only
    doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    columns, blank = [f"p_{n}" for n in chain.names], chain.predict(None)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([shared.value.predict(t.as_py()) for t in batch.column("text")], float).reshape(-1, len(columns))
            toxic = pa.array((found[:, -1] >= THRESHOLD) & (found[:, -1] > blank), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(found[:, k], pa.float64()) for k in range(len(columns))], toxic], ["doc_id", *columns, "toxic"])

    source = docs.select(docs["doc_id"], docs["text"])
    schema = source.select("doc_id", *[F.lit(0.0).alias(c) for c in columns], F.lit(True).alias("toxic")).schema
    return source.mapInArrow(run, schema)
