"""Near copies by covering locality-sensitive hashing of wide fingerprints, each candidate pair checked exactly.

A text is the set of its five-word shingles; two texts are near copies at a Jaccard similarity of 4/5 and more.
Their SimHash fingerprints then differ in a share of about 0.15 of the bits at most, too many for masks over one
fingerprint. So the fingerprint has BLOCKS blocks, and each block the covering masks of ``simhash``: a pair
that differs in at most RADIUS bits of any one block shares a bucket, always. The first round takes a few blocks. Inside a bucket
texts are joined to their nearest ones by a spanning forest over a check word, so that a group of copies gives as
many pairs as it has texts; the sets of each pair are compared, and this links most of a large group. The second round
takes all blocks and pairs every two texts of a bucket whose check words are near and that are not linked yet, however large the bucket.
Near copies are the connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.llm.common import checkpointed, join_groups
from brandsieve.llm.components import components
from brandsieve.llm.exact_dedup import filter_bits, flag_possible, present_filter
from brandsieve.llm.simhash import SEED, covering_masks, representatives

SHINGLE = 5
#: Blocks of the fingerprint, bits of a block, bits in which texts may differ in some block; 7 tables for a block.
BLOCKS, BLOCK_BITS, RADIUS = 24, 42, 2
WORDS = -(-BLOCKS * BLOCK_BITS // 64)
#: Blocks whose buckets give a forest each; those of all blocks then give all pairs of texts that are not linked by it.
FIRST = range(3)
#: Of the 64 check bits, at most so many differ in a candidate pair: 9.7 do on average at a similarity of 4/5,
#: with a deviation of 2.9.
CHECK_BITS = 19
#: Texts of a bucket that are compared at once. A larger one goes on part by part: for a forest, each part with HEADS of
#: every earlier part; for all pairs, each part with every other, in tasks of their own.
LARGE, HEADS = 2048, 64
#: Rows of a bucket up to which all pairs of many buckets are looked at together.
SMALL = 64
#: Pairs that a task gathers before it passes them on.
HELD_PAIRS = 1 << 16
#: Words whose hashes a task remembers.
HELD_WORDS = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_PLANES, _FLIPS = (np.random.default_rng(n).integers(1 << 63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (1, 2))


class _Words(dict):
    """Hashes of words, each taken once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out


def shingles(text: bytes | None, known: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle as a whole.

    A-Z are lower-cased and words are runs of anything but ASCII white space.
    """
    words = text.lower().split() if text else []  # bytes: both treat ASCII only
    hashes = np.array(list(map((_Words() if known is None else known).__getitem__, words)), np.uint64)
    if len(hashes) < SHINGLE:
        mixed = (hashes * _PLACES[: len(hashes)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(hashes))
    else:
        count = len(hashes) - SHINGLE + 1
        mixed = np.full(count, SHINGLE, np.uint64)
        for at, place in enumerate(_PLACES):
            mixed += hashes[at : at + count] * place
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(33)))


def _ones(rows: np.ndarray) -> np.ndarray:
    """How many rows have each bit set: rows are added as bits, three to a sum and a carry, before bits are unpacked."""
    total, weight = np.zeros(rows.shape[1] * 64, np.int64), 1
    while len(rows):
        carries = []
        while len(rows) >= 12:
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
            either = a ^ b
            carries.append((a & b) | (either & c))
            rows = np.concatenate((either ^ c, rows[3 * m :]))
        bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little")
        total += weight * bits.sum(axis=0, dtype=np.int64)
        rows = np.concatenate(carries) if carries else rows[:0]
        weight *= 2
    return total


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The WORDS words of a set's fingerprint: a bit is set if it is in over half of the shingles."""
    ones = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(hashes), 4096):  # in pieces that stay in the cache
        mixed = (hashes[at : at + 4096, None] ^ _FLIPS) * _PLANES
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD
        ones += _ones(mixed ^ (mixed >> np.uint64(32)))
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def _sets(docs: DataFrame, body: Column) -> DataFrame:
    """(doc_id, body, node, print) per row; ``node`` is a hash of the set, ``print`` its fingerprint."""
    source = docs.select(docs["doc_id"].alias("doc_id"), body.alias("body"), docs["text"].alias("text"))
    schema = source.drop("text").withColumns({"node": F.lit(0).cast("long"), "print": F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            nodes, prints = [], []
            for text in batch.column("text").cast(pa.binary()):
                own = shingles(text.as_py(), known)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes()))
                prints.append(fingerprint(own).tobytes())
            columns = [batch.column("doc_id"), batch.column("body"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "body", "node", "print"])

    return source.mapInArrow(run, schema)


def _block(words: np.ndarray, block: int) -> np.ndarray:
    """The bits of one block of fingerprints (rows of words)."""
    at, shift = divmod(block * BLOCK_BITS, 64)
    low = words[:, at] >> np.uint64(shift)
    if shift + BLOCK_BITS > 64:
        low = low | words[:, at + 1] << np.uint64(64 - shift)
    return low & np.uint64((1 << BLOCK_BITS) - 1)


def _masks() -> list[list[int]]:
    """The covering masks of each block, drawn for it."""
    return [covering_masks(RADIUS, seed=block, bits=BLOCK_BITS) for block in range(BLOCKS)]


def _keyed(nodes: DataFrame, blocks: range) -> DataFrame:
    """(key, node, check, label): each text under the bucket of every table of ``blocks``, with its check word."""
    masks = _masks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                words = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(-1, WORDS)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
                check = np.packbits(bits[:, :: WORDS], axis=1, bitorder="little").view(np.int64).ravel()
                keys = []
                for block in blocks:
                    own = _block(words, block)
                    for mask in masks[block]:
                        keys.append((own & np.uint64(mask)) | np.uint64(len(keys) << BLOCK_BITS))
                columns = [np.concatenate(keys).view(np.int64), *[np.tile(x, len(keys)) for x in (batch.column("node").to_numpy(), check, batch.column("label").to_numpy())]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "check", "label"])

    return nodes.select("node", "print", "label").mapInArrow(run, "key long, node long, check long, label long")


def _distance(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count((one ^ other).view(np.uint64)).astype(np.int16)  # of signed numbers it counts the absolute value


def _forest(check: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of least distances between check words, as far as CHECK_BITS allows.

    Texts of one label are linked already: they are joined first and give no ends.
    """
    linked = np.int16(-1)
    far = np.int16(99)
    near, parent = np.where(label == label[0], linked, _distance(check, check[0])), np.zeros(len(check), np.int64)
    done = np.zeros(len(check), bool)
    done[0], near[0] = True, far
    one, other = [], []
    for _ in range(len(check) - 1):
        at = int(near.argmin())
        if 0 <= near[at] <= CHECK_BITS:
            one.append(int(parent[at]))
            other.append(at)
        done[at] = True
        distance = np.where(label == label[at], linked, _distance(check, check[at]))
        closer = (distance < near) & ~done
        near[closer] = distance[closer]
        parent[closer] = at
        near[at] = far
    return np.array(one, np.int64), np.array(other, np.int64)


def _bucket(rows: np.ndarray, heads: np.ndarray, large: int, keep: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pairs (two nodes a row) of one bucket's rows (node, check, label), and the heads of its parts so far."""
    pairs = []
    for at in range(0, len(rows), large):
        part = np.concatenate((heads, rows[at : at + large]))
        if len(part) > 1:
            a, b = _forest(part[:, 1], part[:, 2])
            pairs.append(np.stack((part[a, 0], part[b, 0]), axis=1))
        heads = np.concatenate((heads, rows[at : at + keep]))[-large:]
    return pairs, heads


def _all_pairs(one: np.ndarray, other: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs (two nodes a row) of rows (node, check, label) of two labels within CHECK_BITS: of ``one``, or of one and the other."""
    for at in range(len(one)):
        to = one[at + 1 :] if other is None else other
        near = to[(to[:, 2] != one[at, 2]) & (_distance(to[:, 1], one[at, 1]) <= CHECK_BITS), 0]
        if len(near):
            yield np.stack((np.full(len(near), one[at, 0]), near), axis=1)


def _small_pairs(rows: np.ndarray) -> Iterator[np.ndarray]:
    """The same of rows (key, node, check, label) of many small buckets: each row with the first, the second ... behind it."""
    at, step = np.arange(len(rows)), 0
    while len(at):
        step += 1
        at = at[at + step < len(rows)]
        at = at[rows[at, 0] == rows[at + step, 0]]
        near = at[(rows[at, 3] != rows[at + step, 3]) & (_distance(rows[at, 2], rows[at + step, 2]) <= CHECK_BITS)]
        yield np.stack((rows[near, 1], rows[near + step, 1]), axis=1)


_NO_HEADS = np.zeros((0, 3), np.int64)
_PAIRS = "a long, b long"
#: A part of a bucket above ``large`` rows, its number and its least and largest label.
_PARTS = "key long, part long, low long, high long, rows binary"


def _batch(found: list[np.ndarray]) -> pa.RecordBatch:
    """Distinct pairs as (a, b), the lesser first."""
    pairs = np.unique(np.sort(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _batches(found: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The same in batches: pairs can be as many as the square of the rows, so they are passed on as they are found."""
    held, size = [], 0
    for pairs in found:
        held.append(pairs)
        size += len(pairs)
        if size >= HELD_PAIRS:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _ordered(keyed: DataFrame, large: int, meet: Callable, of_large: Callable, schema: str) -> DataFrame:
    """What ``meet`` makes of the rows of whole buckets and ``of_large`` of each part of a larger one.

    Rows of a bucket come one after the other, by label; no more than a part of one is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        going = None  # the bucket that is met in parts

        def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows) and rows[0, 0] == going:
                end = int(np.searchsorted(rows[:, 0], going, "right"))
                yield from of_large(rows[:end], False)
                rows = rows[end:]
            if len(rows):
                yield from meet(rows)

        for batch in batches:
            rows = np.concatenate((held, np.stack([batch.column(c).to_numpy() for c in ("key", "node", "check", "label")], axis=1)))
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0])) if len(rows) else 0
            yield from found(rows[:last])
            held = rows[last:]
            while len(held) > large:  # a part of a large bucket
                yield from of_large(held[:large], going != held[0, 0])
                going, held = held[0, 0], held[large:]
        yield from found(held)

    return keyed.repartition("key").sortWithinPartitions("key", "label", "node").mapInArrow(run, schema)


def _buckets(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(rows)]))


def _forest_pairs(keyed: DataFrame, large: int, keep: int) -> DataFrame:
    """Distinct candidate pairs (a, b) that link the texts of a bucket to their nearest ones."""
    heads = _NO_HEADS

    def meet(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, ends = _buckets(rows)
        sizes = ends - starts
        two = starts[sizes == 2]
        close = two[(_distance(rows[two, 2], rows[two + 1, 2]) <= CHECK_BITS) & (rows[two, 3] != rows[two + 1, 3])]
        out = [np.stack((rows[close, 1], rows[close + 1, 1]), axis=1)]
        for a, b in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            out += _bucket(rows[a:b, 1:], _NO_HEADS, large, keep)[0]
        yield _batch(out)

    def of_large(rows: np.ndarray, new: bool) -> Iterator[pa.RecordBatch]:
        nonlocal heads
        pairs, heads = _bucket(rows[:, 1:], _NO_HEADS if new else heads, large, keep)
        yield _batch(pairs)

    return _ordered(keyed, large, meet, of_large, _PAIRS).where("a <> b").distinct()


def _exact_pairs(keyed: DataFrame, large: int) -> DataFrame:
    """All distinct pairs (a, b) of texts that share a bucket, have different labels and differ in CHECK_BITS at most.

    The parts of a bucket of more than ``large`` rows meet each other by a join, each two in one row, so that no task
    has a whole bucket. Two parts of one and the same label have no pairs and do not meet.
    """
    part = 0
    fields = ["key", "part", "low", "high", "rows"]

    def meet(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, ends = _buckets(rows)
        mixed = rows[starts, 3] != rows[ends - 1, 3]  # by label: else all have one
        small = mixed & (ends - starts <= SMALL)
        larger = zip(starts[mixed & ~small], ends[mixed & ~small], strict=True)
        for batch in _batches(chain(_small_pairs(rows[np.repeat(small, ends - starts)]), *(_all_pairs(rows[a:b, 1:]) for a, b in larger))):
            none = [pa.nulls(batch.num_rows, pa.binary() if f == "rows" else pa.int64()) for f in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *none], ["a", "b", *fields])

    def of_large(rows: np.ndarray, new: bool) -> Iterator[pa.RecordBatch]:
        nonlocal part
        part = 0 if new else part + 1
        none = [pa.nulls(1, pa.int64())] * 2
        own = [pa.array([int(x)], pa.int64()) for x in (rows[0, 0], part, rows[0, 3], rows[-1, 3])]
        yield pa.RecordBatch.from_arrays([*none, *own, pa.array([np.ascontiguousarray(rows[:, 1:]).tobytes()], pa.binary())], ["a", "b", *fields])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, one, other in zip(*(batch.column(c).to_pylist() for c in ("same", "one", "other")), strict=True):
                one, other = (np.frombuffer(x, np.int64).reshape(-1, 3) for x in (one, other))
                yield from _batches(_all_pairs(one) if same else _all_pairs(one, other))

    met = checkpointed(_ordered(keyed, large, meet, of_large, f"{_PAIRS}, {_PARTS}").distinct())
    parts = met.where("rows IS NOT NULL")
    least = parts.select("key", F.col("part").alias("n"), F.col("low").alias("l"), F.col("high").alias("h"), F.col("rows").alias("other"))
    mixed = "part <= n AND NOT (low = high AND l = h AND low = l)"
    twos = parts.join(least, "key").where(mixed).select((F.col("part") == F.col("n")).alias("same"), F.col("rows").alias("one"), "other")
    twos = twos.repartition(F.rand(7)).mapInArrow(cross, _PAIRS) if parts.take(1) else None
    pairs = met.where("rows IS NULL").select("a", "b")
    return (pairs if twos is None else pairs.unionAll(twos)).where("a <> b").distinct()


def _whole_sets(docs: DataFrame, body: Column, each: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, v) of ``nodes``: the shingles, from one text of each. Texts pass a Bloom filter before they are shuffled."""
    wanted = checkpointed(each.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("body").alias("digest")).select("digest"))
    bits = filter_bits(wanted.count())
    texts = docs.select(body.alias("digest"), docs["text"].alias("text"))
    maybe = flag_possible(texts, checkpointed(present_filter(wanted, bits)), bits).where("possible")
    texts = maybe.join(wanted, "digest", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                sets = [shingles(t.as_py(), known) for t in whole.column("text").slice(at, 256).cast(pa.binary())]
                nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "v"])

    return texts.mapInArrow(run, "node long, v array<long>").dropDuplicates(["node"])


def _verified(docs: DataFrame, body: Column, each: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) with a Jaccard similarity of 4/5 and more."""
    total = pairs.count()
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("ends"))
    sets = checkpointed(_whole_sets(docs, body, each, ends).join(ends, "node"))
    # a text that very many pairs share comes to them
    first = join_groups(pairs, sets.withColumnsRenamed({"node": "a", "v": "x"}), "a", "ends", total).drop("ends")
    both = join_groups(first, sets.withColumnsRenamed({"node": "b", "v": "y"}), "b", "ends", total)
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common * 9 >= (F.size("x") + F.size("y")) * 4).select("a", "b")


def linked(docs: DataFrame, body: Column, each: DataFrame, large: int = LARGE, keep: int = HEADS) -> DataFrame:
    """Links (a, b) between sets of ``each`` that join its near copies, directly or over others.

    Each link of the last round has a Jaccard similarity of 4/5 and more; what the first round has joined that
    way is linked to the least of its component. ``large`` and ``keep`` say how the work is cut, not what is linked.
    """
    nodes = each.groupBy("node").agg(F.first("print").alias("print"))
    labelled = nodes.withColumn("label", F.col("node"))
    links = checkpointed(_verified(docs, body, each, checkpointed(_forest_pairs(_keyed(labelled, FIRST), large, keep))))
    known = components(links)
    links = known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    labelled = nodes.join(known, "node", "left").select("node", "print", F.coalesce("component", "node").alias("label"))
    pairs = checkpointed(_exact_pairs(_keyed(labelled, range(BLOCKS)), large))
    return checkpointed(links.unionByName(_verified(docs, body, each, pairs)))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of its smallest doc_id (nulls last).

    Groups are the connected components of pairs with a five-word Jaccard similarity of 4/5 and more that share
    a bucket; equal sets always do. See ``simhash.representatives`` for the rows that go. Null and empty
    texts are equal; texts of fewer than five words are near copies of equal ones only. Ties do not arise: all
    links of a component count alike. Whole texts are read and an empty table gives an empty result.
    """
    body = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    each = checkpointed(_sets(docs, body))
    labels = components(linked(docs, body, each))
    rows = each.select("doc_id", "body", "node").join(labels, "node", "left")
    return representatives(docs, rows.select("doc_id", "body", F.coalesce("component", "node").alias("component")))
