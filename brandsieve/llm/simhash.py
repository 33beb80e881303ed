"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint holds, per bit, the majority of the XXH64 hashes of its word shingles.
Fingerprints link when at most ``radius`` bits differ. Bits are mapped to vectors of radius + 1 binary
digits; every nonzero vector gives a mask of the bits whose vector has an odd product with it. The bits
in which a linked pair differs span at most ``radius`` dimensions, so some mask avoids all of them: the
pair shares its bucket under that mask, always, not just probably.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandsieve.llm.common import ROW, checkpointed, join_groups, packed, unpacked
from brandsieve.llm.components import components
from brandsieve.llm.exact_dedup import filter_bits, flag_possible, present_filter

BITS = 64
SEED = 42  # of the shingle hash
#: Buckets with more distinct fingerprints than this are split further instead of compared in one task.
LARGE = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a text; null and texts without words give zero.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles keep repeats.
    """
    words = text.encode().lower().split() if text else []  # bytes: both treat ASCII only
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:count].tolist()
    ends = ends[len(words) - count :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, count)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, count, 1 << 16):  # in pieces, for very long texts
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, extra: dict | None = None) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint as a signed long) per row, with the columns of ``extra``."""
    extra = extra or {}
    source = docs.select(docs["doc_id"], docs["text"].alias("text"), *[c.alias(k) for k, c in extra.items()])
    schema = source.drop("text").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            fps = pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())
            rest = [(n, batch.column(n)) for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [fps], [n for n, _ in rest] + ["fp"])

    return source.mapInArrow(run, schema)


def covering_masks(radius: int, seed: int = 1, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 masks of ``bits`` bits; any ``radius`` bits are left out by at least one of them."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if bin(m & v).count("1") % 2) for v in range(1, size)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _forest(values: np.ndarray, radius: int) -> np.ndarray:
    """For each value the place of one it is connected with inside the bucket, the same for a component."""
    near = np.concatenate([np.bitwise_count(block[:, None] ^ values[None, :]) <= radius for block in np.array_split(values, -(-len(values) // 256))])
    label = np.arange(len(values))
    while True:
        lower = np.where(near, label[None, :], len(values)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        ends = ends - ends[0]
        starts, sizes = ends[:-1], np.diff(ends)
        two = starts[sizes == 2]
        close = two[np.bitwise_count(flat[two] ^ flat[two + 1]) <= radius]
        left, right = [flat[close]], [flat[close + 1]]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            values = flat[at : at + n]
            label = _forest(values, radius)
            moved = label != np.arange(n)
            left.append(values[moved])
            right.append(values[label[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], ["a", "b"])


def links(fps: DataFrame, radius: int = 2, large: int = LARGE) -> DataFrame:
    """Links (a, b) that connect every two distinct fingerprints within ``radius``, directly or over others.

    Buckets of up to ``large`` fingerprints are compared inside a task and yield a spanning forest.
    In larger ones each fingerprint is keyed by every way to clear ``radius`` of the bits its mask
    leaves out: two share such a key exactly if they are within the radius, and at most 2^radius share
    one, so no bucket grows beyond a task and no pair is listed twice over.
    """
    masks = covering_masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))
    keyed = fps.select("fp", table.alias("at")).select("fp", "at.t", "at.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = checkpointed(keyed.join(sizes, ["t", "key"]))
    small = met.where(F.col("n") <= large).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    found = small.mapInArrow(lambda batches: _bucket_links(batches, radius), "a long, b long")
    ways = {
        (t, _signed(~sum(1 << i for i in bits) % (1 << 64)))
        for t, m in enumerate(masks)
        for bits in itertools.combinations([i for i in range(BITS) if not m >> i & 1], radius)
    }
    cleared = fps.sparkSession.createDataFrame(sorted(ways), "t int, mask long")  # a fixed number of rows
    starred = (
        met.where(F.col("n") > large)
        .join(F.broadcast(cleared), "t")
        .groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
        .where("a <> b")
    )
    return found.unionByName(starred).distinct()


def grouped(docs: DataFrame, shingle: int = 3, radius: int = 2, extra: dict | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, component (its least fingerprint), component_id (and ``extra``).

    ``component_id`` is the smallest doc_id reachable over links.
    Null ids are left out of the minimum; a component without any id has a null component. An empty
    table gives an empty result. Columns other than doc_id and text are not read.
    """
    each = checkpointed(fingerprints(docs, shingle, extra))
    distinct = checkpointed(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    labels = components(links(distinct, radius)).withColumnRenamed("node", "fp")
    met = distinct.join(labels, "fp")
    least = met.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = met.join(least, "component").select("fp", F.struct("component", "component_id").alias("linked"))
    component = F.coalesce(F.col("linked")["component"], F.col("fp")).alias("component")
    named = distinct.join(linked, "fp", "left").select("fp", "rows", component, F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("linked")["component_id"]).alias("component_id"))
    return join_groups(each, checkpointed(named), "fp", "rows", each.count()).drop("rows")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row of ``docs``; see ``grouped``."""
    return grouped(docs, shingle, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component of ``grouped``; see ``representatives``."""
    key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return representatives(docs, grouped(docs, shingle, radius, {"body": key}).select("doc_id", "body", "component"))


def representatives(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id (nulls last).

    ``rows`` has doc_id, body (the hash of the text) and a component that is never null, per row.
    Ids need not be unique: rows are told apart by id and text hash, and of rows equal in both the
    first is taken. All columns are kept. Rows of components of two and more meet in a shuffle of
    narrow keys; whole rows are shuffled only where a Bloom filter of the keys that go lets them through.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    rows = checkpointed(rows)
    total = rows.count()
    groups = checkpointed(rows.groupBy("component").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    per_key = rows.groupBy("component", "doc_id", "body").agg(F.count(F.lit(1)).alias("n"))
    first = F.col("first")
    marks = checkpointed(
        join_groups(per_key, groups, "component", "rows", total)
        .withColumn("stays", F.col("doc_id").eqNullSafe(first["doc_id"]) & (F.col("body") == first["body"]))
        .where("NOT stays OR n > 1")
        .select(F.col("doc_id").alias("m_id"), F.col("body").alias("m_body"), "stays", F.xxhash64("doc_id", "body").alias("digest"))
    )
    bits = filter_bits(marks.count())
    marked = packed(docs).select(ROW, F.col(ROW)["doc_id"].alias("doc_id"), F.xxhash64(F.coalesce(F.col(ROW)["text"], F.lit(""))).alias("body"))
    marked = flag_possible(marked.withColumn("digest", F.xxhash64("doc_id", "body")), checkpointed(present_filter(marks, bits)), bits)
    maybe = marked.where("possible").join(marks.drop("digest"), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("body") == F.col("m_body")), "left")
    kept = marked.where("NOT possible").select(ROW).unionByName(maybe.where("stays IS NULL").select(ROW))
    repeated = maybe.where("stays").groupBy("doc_id", "body").agg(F.first(ROW).alias(ROW)).select(ROW)
    return unpacked(kept.unionByName(repeated), docs.columns)
