"""Exact de-duplication by two-pass Bloom filtering.

Pass one hashes every text, sets two positions of a bit filter per text and keeps the positions hit
more than once. Pass two tests every text against that filter on the map side: a text with a position
hit only once is certainly unique and passes straight through; only the others are shuffled and
compared by their SHA-256.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.llm.common import ROW, ascii_lower, body, checkpointed, join_groups, packed, unpacked

#: Largest filter. It is broadcast as at most MAX_BITS / 64 rows of two longs (2 097 152 rows, about
#: 100 MB in memory); with more texts than it can tell apart, more rows are shuffled, none is lost.
MAX_BITS = 1 << 27
BITS_PER_TEXT = 16


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as lower-case hex."""
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def _positions(digest: str, bits: int) -> tuple[Column, Column]:
    hashed = F.xxhash64(digest)
    return hashed.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(hashed, 32).bitwiseAND(F.lit(bits - 1))


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """Size of the filter for ``rows`` texts: a power of two, BITS_PER_TEXT per text up to the bound."""
    return min(max_bits, 1 << max(10, math.ceil(math.log2(max(1, rows) * BITS_PER_TEXT))))


def repeated_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(word, bits): the positions of the filter that more than one text hits, 64 to a word."""
    first, second = _positions("digest", bits)
    return _filter(
        digests.select(F.explode(F.array_distinct(F.array(first, second))).alias("position"))
        .groupBy("position")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def present_filter(digests: DataFrame, bits: int) -> DataFrame:
    """(word, bits): the positions of the filter that any digest hits."""
    return _filter(digests.select(F.explode(F.array(*_positions("digest", bits))).alias("position")))


def _filter(positions: DataFrame) -> DataFrame:
    return positions.groupBy(F.shiftright("position", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(position & 63 AS INT))")).alias("bits"))


def flag_possible(rows: DataFrame, repeated: DataFrame, bits: int) -> DataFrame:
    """``rows`` (with ``digest``) plus ``possible``: false if no other text can be equal.

    The filter is broadcast: its rows are bounded by ``bits`` / 64.
    """
    first, second = _positions("digest", bits)
    words = F.broadcast(repeated)
    marked = rows.withColumn("p1", first).withColumn("p2", second)
    for side in ("1", "2"):
        word = words.select(F.col("word").alias(f"w{side}"), F.col("bits").alias(f"b{side}"))
        marked = marked.join(word, F.shiftright(f"p{side}", 6) == F.col(f"w{side}"), "left")
    hit = [F.expr(f"shiftrightunsigned(coalesce(b{s}, 0L), CAST(p{s} & 63 AS INT)) & 1L") == 1 for s in ("1", "2")]
    return marked.withColumn("possible", hit[0] & hit[1]).drop("p1", "p2", "w1", "w2", "b1", "b2")


def _groups(possible: DataFrame) -> DataFrame:
    """Per text that may repeat and document id: how many rows have both."""
    return possible.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def dedup_decisions(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row
    with the largest doc_id stays; if several rows share that id, one of them; a null id loses against
    any other and wins only among nulls. An empty table gives an empty result. Other columns of
    ``docs`` are ignored.
    """
    digests = checkpointed(docs.select(docs["doc_id"], text_digest(body(docs)).alias("digest")))
    rows = digests.count()
    bits = filter_bits(rows, max_bits)
    flagged = flag_possible(digests, checkpointed(repeated_filter(digests, bits)), bits)
    straight = flagged.where("NOT possible").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256")
    )
    per_id = checkpointed(_groups(flagged.where("possible")))
    groups = checkpointed(per_id.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")))
    compared = (
        join_groups(per_id, groups, "digest", "group_size", rows)
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))
    )
    return straight.unionByName(compared)


def dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without exact copies; same rules as ``dedup_decisions``, all columns kept.

    Rows that cannot have a copy are not shuffled. Of the others, whole rows are shuffled once, and
    only where a kept id occurs twice with the same text are rows compared beyond their id.
    """
    columns = docs.columns
    rows = packed(docs).select(ROW, F.col(ROW)["doc_id"].alias("doc_id"), text_digest(F.coalesce(F.col(ROW)["text"], F.lit(""))).alias("digest"))
    digests = checkpointed(rows.select("doc_id", "digest"))
    bits = filter_bits(digests.count(), max_bits)
    repeated = checkpointed(repeated_filter(digests, bits))
    keepers = (
        _groups(flag_possible(digests, repeated, bits).where("possible"))
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "n")).alias("last"))
        .select("digest", F.col("last")["doc_id"].alias("keep_id"), (F.col("last")["n"] > 1).alias("tied"))
    )
    flagged = flag_possible(rows, repeated, bits)
    # the id is part of the key, so the rows of one text spread over the tasks
    keepers = keepers.withColumnRenamed("digest", "kept_digest")
    staying = flagged.where("possible").join(keepers, (F.col("digest") == F.col("kept_digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    once = staying.where("NOT tied").select(ROW)
    tied = staying.where("tied").groupBy("digest").agg(F.first(ROW).alias(ROW)).select(ROW)
    return unpacked(flagged.where("NOT possible").select(ROW).unionByName(once).unionByName(tied), columns)
