"""Ranked lexical search by pipelined term partitioning.

Documents are cut into blocks; a block's postings of the items' terms are packed once. Terms have owners,
the rarest with the first one. A bundle of items carries its sparse accumulators (item, place in the block,
score) of one block from owner to owner: at each stage ``cogroup`` brings the bundles of a block together
with the postings that the owner holds for it, and integer contributions are added. What remains after the
last owner is selected per block, then over all blocks.

An accumulator is left behind only if all that later owners could add does not lift it to the score that
``top`` documents of its block have already: it cannot be among the item's results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brandsieve.llm.common import checkpointed

TOP = 50
#: Owners of terms, one stage each.
OWNERS = 4
#: Documents in a block, and items in a bundle: together the bound of a task's accumulators.
BLOCK_DOCS, BUNDLE_ITEMS = 4096, 64
#: Distinct terms of items that go to the tasks at a time; more items take more passes.
VOCABULARY = 1 << 18
#: Parts in which an item's block results are ranked before the last ranking.
PARTS = 64

#: Bytes that separate terms become blanks, A-Z small letters; bytes of characters beyond ASCII stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """All terms of a text in UTF-8, with repeats."""
    return text.translate(_TERM_BYTES).split() if text else []


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their distinct terms, in blocks of at most VOCABULARY terms (or one item)."""
    block, known = [], set()
    for row in items.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        own = sorted(set(terms(row["text"].encode())))
        if block and len(known.union(own)) > VOCABULARY:
            yield block
            block, known = [], set()
        if own:
            block.append((row["item_id"], own))
            known.update(own)
    if block:
        yield block


def _postings(docs: DataFrame, vocabulary: list[bytes], block_docs: int) -> DataFrame:
    """Per block: its doc_ids and term counts ``n``, and the (term, place, tf) of the vocabulary's terms."""
    source = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = f"block long, doc_ids array<{id_type}>, n binary, documents long, words long, term binary, place binary, tf binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block_docs):
                part = batch.slice(at, block_docs)
                n, term, place, tf = [], [], [], []
                for where, text in enumerate(part.column("text").cast(pa.binary())):
                    words = terms(text.as_py())
                    n.append(len(words))
                    counts = Counter(filter(None.__ne__, map(number.get, words)))
                    term.extend(counts)
                    place.extend([where] * len(counts))
                    tf.extend(counts.values())
                packed = [np.array(x, np.int32).tobytes() for x in (term, place, tf)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [block],
                        "doc_ids": pa.ListArray.from_arrays([0, part.num_rows], part.column("doc_id")),
                        "n": [np.array(n, np.int64).tobytes()],
                        "documents": [sum(x > 0 for x in n)],
                        "words": [sum(n)],
                        "term": [packed[0]],
                        "place": [packed[1]],
                        "tf": [packed[2]],
                    },
                )
                block += 1

    return source.mapInArrow(run, schema)


def _document_counts(postings: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for packed in batch.column("term"):
                counts += np.bincount(np.frombuffer(packed.as_py(), np.int32), minlength=size)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"term": held, "df": counts[held]})

    out = np.zeros(size, np.int64)
    for row in postings.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["term"]] = row["df"]
    return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def owners_of(df: np.ndarray, owners: int) -> np.ndarray:
    """The owner of each term: rare terms first, about as many postings for each."""
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) - df[order]
    out = np.empty(len(df), np.int64)
    out[order] = before * owners // max(1, int(df.sum()))
    return out


def _contributions(postings: DataFrame, documents: int, words: int, weights: np.ndarray, owner: np.ndarray, owners: int) -> DataFrame:
    """Per block and owner the (term, place, contribution) of its postings; the last owner's row has the doc_ids."""
    spark, ids = postings.sparkSession, postings.schema["doc_ids"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((weights, owner))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, owner = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                n, term, place, tf = (np.frombuffer(one.column(c)[0].as_py(), k).astype(np.int64) for c, k in (("n", np.int64), ("term", np.int32), ("place", np.int32), ("tf", np.int32)))
                m = 50 + 50 * n * documents // max(1, words)
                added = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[place]))
                by = [np.flatnonzero((owner[term] == k) & (added > 0)) for k in range(owners)]
                last = [None] * (owners - 1) + [one.column("doc_ids")[0].as_py()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [one.column("block")[0].as_py()] * owners,
                        "owner": pa.array(range(owners), pa.int32()),
                        "doc_ids": pa.array(last, one.schema.field("doc_ids").type),
                        "term": [term[b].astype(np.int32).tobytes() for b in by],
                        "place": [place[b].astype(np.int32).tobytes() for b in by],
                        "added": [added[b].tobytes() for b in by],
                    },
                )

    return postings.mapInArrow(run, f"block long, owner int, doc_ids {ids}, term binary, place binary, added binary")


_BUNDLE = "block long, bundle int, item binary, place binary, score binary"


def _add(right: pa.Table, of_items: list[np.ndarray], held: pa.Table, row: int, block_docs: int) -> np.ndarray:
    """A bundle's accumulators (items by places), with the contributions of one owner's terms of the block."""
    scores = np.zeros((len(of_items), block_docs), np.int64)
    item, place, score = (np.frombuffer(held.column(c)[row].as_py(), k) for c, k in (("item", np.int32), ("place", np.int32), ("score", np.int64)))
    scores[item, place] = score
    for at in range(right.num_rows):
        term, place, added = (np.frombuffer(right.column(c)[at].as_py(), k) for c, k in (("term", np.int32), ("place", np.int32), ("added", np.int64)))
        order = np.argsort(term, kind="stable")
        term, place, added = term[order], place[order], added[order]
        for i, own in enumerate(of_items):
            low, high = np.searchsorted(term, own), np.searchsorted(term, own, "right")
            for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                scores[i, place[a:b]] += added[a:b]
    return scores


def _stage(of_items: list[np.ndarray], rest: np.ndarray, top: int, block_docs: int):
    """The function of one owner's stage; ``rest`` bounds what later owners can add to each item's documents."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in range(left.num_rows):
            bundle = left.column("bundle")[row].as_py()
            items = slice(bundle * BUNDLE_ITEMS, (bundle + 1) * BUNDLE_ITEMS)
            scores = _add(right, of_items[items], left, row, block_docs)
            reached = np.partition(scores, -top, axis=1)[:, -top] if block_docs > top else np.zeros(len(scores), np.int64)
            item, place = np.nonzero((scores > 0) & (scores + rest[items, None] >= reached[:, None]))
            out.append((left.column("block")[row].as_py(), bundle, item.astype(np.int32).tobytes(), place.astype(np.int32).tobytes(), scores[item, place].tobytes()))
        return pa.Table.from_pylist([dict(zip(("block", "bundle", "item", "place", "score"), r, strict=True)) for r in out], _bundle_schema())

    return run


def _bundle_schema() -> pa.Schema:
    return pa.schema([("block", pa.int64()), ("bundle", pa.int32()), ("item", pa.binary()), ("place", pa.binary()), ("score", pa.binary())])


def _last_stage(of_items: list[np.ndarray], top: int, block_docs: int, id_type: pa.DataType):
    """The last owner's stage: each item's ``top`` documents of the block."""
    schema = pa.schema([("item", pa.int32()), ("doc_id", id_type), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = pa.concat_arrays([c for x in right.column("doc_ids") if (c := x.values) is not None])
        order = np.argsort(pc.sort_indices(ids, null_placement="at_end").to_numpy())
        parts = []
        for row in range(left.num_rows):
            first = left.column("bundle")[row].as_py() * BUNDLE_ITEMS
            scores = _add(right, of_items[first : first + BUNDLE_ITEMS], left, row, block_docs)
            for i, own in enumerate(scores):
                held = np.flatnonzero(own)
                best = held[np.lexsort((order[held], -own[held]))[:top]]
                parts.append(pa.table([pa.array(np.full(len(best), first + i, np.int32)), ids.take(pa.array(best)), pa.array(own[best])], schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return run


def _search_block(docs: DataFrame, items: list[tuple[object, list[bytes]]], id_type: str, top: int, block_docs: int, owners: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, own in items for t in own})
    number = {t: i for i, t in enumerate(vocabulary)}
    of_items = [np.array([number[t] for t in own], np.int32) for _, own in items]
    postings = checkpointed(_postings(docs, vocabulary, block_docs))
    documents, words = (x or 0 for x in postings.agg(F.sum("documents"), F.sum("words")).first())
    df = _document_counts(postings, len(vocabulary))
    weights = np.array([weight(documents, int(x)) for x in df], np.int64)
    owner = owners_of(df, owners)
    parts = checkpointed(_contributions(postings, documents, words, weights, owner, owners))
    count = -(-len(items) // BUNDLE_ITEMS)
    none = F.lit(b"")
    bundles = postings.select("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("bundle"), none.alias("item"), none.alias("place"), none.alias("score"))
    for k in range(owners):
        met = bundles.groupBy("block").cogroup(parts.where(F.col("owner") == k).groupBy("block"))
        if k < owners - 1:
            # a contribution is below a million times its term's weight
            rest = np.array([int(weights[own][owner[own] > k].sum()) * 1_000_000 for own in of_items], np.int64)
            bundles = met.applyInArrow(_stage(of_items, rest, top, block_docs), _BUNDLE)
    ids = parts.schema["doc_ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    best = met.applyInArrow(_last_stage(of_items, top, block_docs, to_arrow_type(ids)), f"item int, doc_id {ids.simpleString()}, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)
    named = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], f"item int, item_id {id_type}")
    return best.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")  # one row per item of the block


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_docs: int = BLOCK_DOCS, owners: int = OWNERS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's ``top`` documents with a score above 0.

    Every row of ``docs`` is a document and every row of ``items`` an item, repeated ids and texts
    included; equal scores rank by ascending doc_id (nulls last). Null and empty texts have no terms: such
    items find nothing and such documents are not counted. Whole texts are read; an empty table on either
    side gives an empty result. Columns other than the ids and text are not read.
    """
    id_type, doc_type = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    out = None
    for block in _item_blocks(items):
        found = _search_block(docs, block, id_type, top, block_docs, owners)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id {doc_type}, score long")
    return out
