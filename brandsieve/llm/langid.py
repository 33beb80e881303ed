"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams; a linear softmax on that mean
gives the language. Embeddings and softmax are trained together by stochastic gradient descent. A
temperature fitted on rows kept out of training makes the scores probabilities, and the rejection
threshold is set on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.llm import chars
from brandsieve.llm.common import checkpointed

BITS = 16  # of a subword's bucket
DIMENSIONS = 16
EPOCHS = 5
RATE = 0.5
#: Bounds of the training sample, which is gathered on the driver: rows per language, and rows in all,
#: which many languages share evenly. Every language is learned, from one row at least. A row comes as
#: the counts of its buckets, at most 2^BITS of them.
ROWS_PER_LANGUAGE = 800
ROWS = 64 * ROWS_PER_LANGUAGE
#: Share of right predictions that may fall below the rejection threshold, and the threshold's limit.
LOSS = 0.0005
HIGHEST_THRESHOLD = 0.5
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # bucket x language: embedding times softmax
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, count = np.zeros(len(self.languages)), 0
        for buckets in chars.subwords(text, BITS):
            total += self.weights[buckets].sum(axis=0, dtype=np.float64)
            count += len(buckets)
        return total / max(1, count) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.languages or not chars.has_letter(text):
            return UNKNOWN, 0.0, True
        scores = _softmax(self.logits(text) / self.temperature)
        best = int(scores.argmax())
        return self.languages[best], float(scores[best]), bool(scores[best] < self.threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32 of the id as text leaves 2 modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares."""
    counts = np.zeros(1 << BITS, np.int64)
    for buckets in chars.subwords(text, BITS):
        counts += np.bincount(buckets, minlength=1 << BITS)
    used = np.nonzero(counts)[0]
    return used.astype(np.uint16), (counts[used] / max(1, counts.sum())).astype(np.float32)


def _snippet(text: str, key: int) -> str:
    """A few consecutive words from a place that ``key`` decides, so that short texts are learned too."""
    words = text.split()
    size, at = 2 + key % 9, (key >> 8) % max(1, len(words))
    return " ".join(words[at : at + size])


def training_bags(docs: DataFrame) -> DataFrame:
    """(lang, key, part, buckets, shares): a bounded sample of the rows one may learn from.

    Rows are drawn by a hash, so that each language has about ROWS_PER_LANGUAGE, or its part of ROWS with
    many languages; the row of the least hash is always drawn. Each gives two bags: of its whole text
    and of a snippet.
    """
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.withColumn("key", F.xxhash64(F.lit(11), "doc_id", "text"))
    counts = checkpointed(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")))
    languages = max(1, counts.count())
    each = max(1, min(ROWS_PER_LANGUAGE, ROWS // languages))
    drawn = F.pmod(F.shiftrightunsigned("key", 20), F.lit(1 << 20)) * F.col("n") < each * (1 << 20)
    sample = (
        rows.join(F.broadcast(counts), "lang")  # a row per language
        .where(drawn | (F.col("key") == F.col("least")))
        .select("lang", "key", "text")
        .dropDuplicates(["lang", "key"])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for part, text in enumerate((r["text"], _snippet(r["text"], r["key"]))):
                    used, shares = _bag(text)
                    if len(used):
                        rows.append((r["lang"], r["key"], part, used.tobytes(), shares.tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "key", "part", "buckets", "shares"])

    return sample.mapInArrow(run, "lang string, key long, part int, buckets binary, shares binary")


def train(docs: DataFrame, seed: int = 5) -> Model:
    """Model learned from rows with text and lang that are not held out.

    Of each language a fifth of the sample fits temperature and threshold only. Without any row to
    learn from, the model knows no language and rejects everything.
    """
    sample = sorted((r["lang"], r["key"], r["part"], r["buckets"], r["shares"]) for r in training_bags(docs).toLocalIterator())
    languages = sorted({r[0] for r in sample})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    x = [(np.frombuffer(b, np.uint16), np.frombuffer(s, np.float32)) for _, _, _, b, s in sample]
    place = {name: i for i, name in enumerate(languages)}
    y = np.array([place[r[0]] for r in sample])
    aside = np.array([r[1] % 5 == 0 for r in sample])
    aside &= np.isin(y, y[~aside])  # a language without any other row is learned from these
    rng = np.random.default_rng(seed)
    embeddings = rng.uniform(-1, 1, (1 << BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    softmax, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    learned = np.nonzero(~aside)[0]
    steps, step = EPOCHS * len(learned), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learned):
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            used, shares = x[i]
            mean = shares @ embeddings[used]
            error = _softmax(mean @ softmax + bias)
            error[y[i]] -= 1
            back = softmax @ error
            softmax -= rate * np.outer(mean, error)
            bias -= rate * np.float32(0.02) * error
            embeddings[used] -= (rate * 5 * shares)[:, None] * back  # a bucket holds a small share of a mean
    model = Model(languages, embeddings @ softmax, bias.astype(np.float64))
    if aside.any():
        _calibrate(model, [x[i] for i in np.nonzero(aside)[0]], y[aside])
    return model


def _calibrate(model: Model, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
    """Temperature of least log loss; threshold that costs at most LOSS of the right predictions."""
    logits = np.array([s @ model.weights[b] for b, s in bags]) + model.bias
    options = np.geomspace(0.05, 100, 80)
    losses = [-np.log(np.maximum(1e-12, _softmax(logits / t)[np.arange(len(y)), y])).mean() for t in options]
    model.temperature = float(options[int(np.argmin(losses))])
    scores = _softmax(logits / model.temperature)
    right = np.sort(scores.max(axis=1)[scores.argmax(axis=1) == y])
    if len(right):
        model.threshold = min(HIGHEST_THRESHOLD, float(right[int(LOSS * len(right))]))


def _predictor(docs: DataFrame, model: Model):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t.as_py()) for t in batch.column("text")]
            lang, score, rejected = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, lang_pred, score, rejected; learned from ``docs`` if no model is given.

    Whole texts are read; only the text decides a prediction. Null texts and texts without letters are
    ``und`` with score 0 and rejected. Rows with null lang are predicted but not learned from; repeated
    rows are predicted alike; an empty table gives an empty result.
    """
    model = model or train(docs)
    source = docs.select(docs["doc_id"], docs["text"], held_out(docs["doc_id"]).alias("held_out"))
    schema = source.select("doc_id", "held_out", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")).schema
    return source.mapInArrow(_predictor(docs, model), schema)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the rows whose language is rejected; all columns kept, nothing shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not shared.value.predict(t.as_py())[2] for t in batch.column(column)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
