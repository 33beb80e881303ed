"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to ``budget`` edits. Cut into budget + 1 pieces, at least
one piece then occurs unchanged. All pieces of a block of items are found in one pass over the
document; around every hit, Myers' bit-parallel distance decides whether the item is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Edits allowed per character of an item.
ERROR_RATE = 0.08
#: Characters of items that one pass looks for; more items take more passes over the documents.
BLOCK_CHARS = 1_000_000


def normalise(text: str | None) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split()) if text else ""


def offsets(text: str) -> list[int]:
    """For each character of ``normalise(text)`` the place in ``text`` it comes from."""
    out, blank = [], False
    for at, char in enumerate(text):
        if char.isspace():
            blank = True
            continue
        if blank and out:
            out.append(at - 1)
        blank = False
        out += [at] * len(char.lower())
    return out


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``item`` in budget + 1 pieces of near equal length."""
    cuts = [i * len(item) // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def best_end(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of ``pattern`` in ``text`` within ``budget``, the first of equals."""
    ones: dict[str, int] = {}
    for i, c in enumerate(pattern):
        ones[c] = ones.get(c, 0) | 1 << i
    full, high = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score, best = full, 0, len(pattern), None
    for at, c in enumerate(text):
        equal = ones.get(c, 0)
        diagonal = (((equal & up) + up) ^ up) | equal
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(rise & high) - bool(fall & high)
        rise, fall = rise << 1 & full, fall << 1 & full
        vertical = equal | down
        up, down = fall | (full & ~(vertical | rise)), rise & vertical
        if score <= budget and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Matcher:
    """Finds items of one block, given as (item_id, text)."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = [(i, t, int(len(t) * error_rate)) for i, t in items if t]
        self.pieces = ahocorasick.Automaton()
        for n, (_, text, budget) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                known = self.pieces.get(piece, None)
                if known is None:
                    self.pieces.add_word(piece, (len(piece), known := []))
                else:
                    known = known[1]
                known.append((n, offset))
        if self.items:
            self.pieces.make_automaton()

    def _windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per item the stretches of ``text`` around its hits, merged where they overlap."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.pieces.iter(text):
            for n, offset in where:
                _, item, budget = self.items[n]
                begin = end + 1 - size - offset
                found.setdefault(n, []).append([max(0, begin - budget), min(len(text), begin + len(item) + budget)])
        for n, spans in found.items():
            spans.sort()
            merged = spans[:1]
            for low, high in spans[1:]:
                if low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            found[n] = merged
        return found

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, budget, start, end) of each item's best place in the normalised ``text``."""
        if not self.items:
            return []
        out = []
        for n, windows in self._windows(text).items():
            name, item, budget = self.items[n]
            best = None
            for low, high in windows:
                hit = best_end(item, text[low:high], budget)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], low + hit[1])
            if best:
                distance, end = best
                low = max(0, end - len(item) - budget)
                back = best_end(item[::-1], text[low:end][::-1], distance)
                out.append((name, distance, budget, end - back[1], end))
        return out


@lru_cache(maxsize=4)
def _matcher(items: tuple[tuple[int, str], ...], error_rate: float) -> Matcher:
    return Matcher(list(items), error_rate)


def _blocks(items: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """The items with text, normalised, in blocks of at most BLOCK_CHARS (or one item); one empty block if none."""
    block, size, any_ = [], 0, False
    for row in items.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        text = normalise(row["text"])
        if block and size + len(text) > BLOCK_CHARS:
            yield tuple(block)
            block, size, any_ = [], 0, True
        if text:
            block.append((row["item_id"], text))
            size += len(text)
    if block or not any_:
        yield tuple(block)


def matches(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """One row per document row and item found in it: doc_id, item_id, distance, budget, start, end.

    Text is compared in lower case with white space collapsed; ``start`` and ``end`` are character
    places in the original text. Of equally good places the first counts. Documents and items without text match
    nothing; equal items, items that share an id (each with its own budget) and repeated rows are each reported; ids
    may be null. Either table empty gives an empty result. The
    whole of every text is searched; the items go to the tasks in blocks of bounded size.
    """
    spark, out = docs.sparkSession, None
    source = docs.select(docs["doc_id"], docs["text"])
    doc_type, item_type = source.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, distance int, budget int, start long, end long"
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, error_rate)
            for batch in batches:
                rows = []
                for at, value in enumerate(batch.column("text")):
                    text = value.as_py() or ""
                    found = matcher.find(normalise(text))
                    place = offsets(text) if found else []
                    rows += [(at, i, d, n, place[a], place[b - 1] + 1) for i, d, n, a, b in found]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                ids = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
                kinds = [pa.int64() if item_type.simpleString() == "bigint" else None, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], ["doc_id", "item_id", "distance", "budget", "start", "end"])

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without rows whose text holds an item (see ``matches``); all columns kept, nothing shuffled."""
    for block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, column=docs.columns.index("text")) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, error_rate)
            for batch in batches:
                keep = [not matcher.find(normalise(t.as_py())) for t in batch.column(column)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
