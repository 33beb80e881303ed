"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Rows fall into logical partitions by a hash of their content and copy number.
2. A matrix of counts says how many rows of each partition go to each shard. It is drawn from the
   multivariate hypergeometric law, so it has the counts a uniform permutation of all rows would give,
   and its column sums are the shard sizes.
3. Each partition permutes its rows and cuts them by its line of the matrix (first exchange).
4. Each shard permutes what it received: rows fall into slices at random, each slice is permuted, and
   the slices follow one another (second exchange).

Every random choice is a hash of the row and the seed, so a task that is run again decides alike.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brandsieve.llm.common import ROW, body, checkpointed, packed

#: Rows of the matrix. Bounds what the driver draws and what is broadcast (PARTITIONS x shards counts).
PARTITIONS = 1024


def _hypergeometric(rng: random.Random, good: int, total: int, draws: int) -> int:
    """How many of ``good`` among ``total`` are met in ``draws`` draws without replacement.

    Inversion from the mode outwards: the ratio of neighbouring probabilities is a fraction of small
    numbers, so no factorial is formed.
    """
    low, high = max(0, draws - (total - good)), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    weights = {mode: 1.0}
    for step in (1, -1):
        k, w = mode, 1.0
        while low <= k + step <= high and w > 1e-18:
            up = k if step == 1 else k - 1  # ratio between up and up + 1
            ratio = (good - up) * (draws - up) / ((up + 1) * (total - good - draws + up + 1))
            w = w * ratio if step == 1 else w / ratio
            k += step
            weights[k] = w
    point = rng.random() * sum(weights.values())
    for k in sorted(weights):
        point -= weights[k]
        if point <= 0:
            return k
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Counts by partition (rows sum to ``counts``) and shard (columns sum to ``sizes``)."""
    rng, left, matrix = random.Random(seed), list(sizes), []
    for count in counts:
        line, rest, total = [], count, sum(left)
        for s, have in enumerate(left):
            got = rest if s == len(left) - 1 else _hypergeometric(rng, have, total, rest)
            line.append(got)
            rest, total = rest - got, total - have
        left = [a - b for a, b in zip(left, line, strict=True)]
        matrix.append(line)
    return matrix


def even_sizes(rows: int, shards: int) -> list[int]:
    """Shard sizes at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _number(modulus: int, seed: int, *what: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(modulus))


def _small_table(like: DataFrame, rows: list[list[int]], columns: list[str]) -> DataFrame:
    """A table of numbers from the driver; at most PARTITIONS x shards rows."""
    schema = f"array<struct<{','.join(f'{c}:bigint' for c in columns)}>>"
    literal = F.lit(json.dumps([dict(zip(columns, r, strict=True)) for r in rows]))
    return like.sparkSession.range(1).select(F.inline(F.from_json(literal, schema)))


def assign(identities: DataFrame, shards: int, seed: int, partitions: int = PARTITIONS) -> DataFrame:
    """``identities`` plus ``shard`` and ``slot``; its columns together identify a row.

    The two exchanges carry these columns only. Empty input gives an empty result.
    """
    columns = identities.columns
    placed = identities.withColumn("part", _number(partitions, seed, *columns))
    by_part = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(by_part)
    counts = [by_part[p] for p in parts]
    matrix = communication_matrix(counts, even_sizes(sum(counts), shards), seed)
    cuts, slices = [], max(1, partitions // shards)
    for part, line in zip(parts, matrix, strict=True):
        start = 0
        for shard, n in enumerate(line):
            if n:
                cuts.append([part, shard, start, start + n])
            start += n
    cut_table = (
        _small_table(identities, cuts, ["part", "shard", "lo", "hi"])
        .groupBy("part")
        .agg(F.sort_array(F.collect_list(F.struct("hi", "shard"))).alias("cuts"))
    )
    inside = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), *columns), *columns)
    exchanged = (
        placed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(F.broadcast(cut_table), "part")
        .withColumn("shard", F.expr("filter(cuts, c -> c.hi > rank)[0].shard").cast("int"))
        .drop("part", "cuts", "rank")
        .withColumn("slice", _number(slices, seed + 2, *columns))
    )
    exchanged = checkpointed(exchanged)
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        exchanged.groupBy("shard", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("shard", "slice").orderBy(F.xxhash64(F.lit(seed + 3), *columns), *columns)
    return (
        exchanged.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), ["shard", "slice"])  # at most shards x slices = PARTITIONS rows
        .select(*columns, "shard", (F.col("offset") + F.col("rank")).alias("slot"))
    )


def shard_plan(docs: DataFrame, shards: int, seed: int = 7, partitions: int = PARTITIONS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    ``size`` is the text's UTF-8 bytes (null: none) plus one. Shard sizes are at most one row apart,
    ``slot`` runs without gaps from 0 in each shard, and every permutation is as likely as the hash
    allows. Rows equal in id and text are numbered before they are placed, so that many copies of one
    row spread like any others; null ids are an id like any other. Columns other than doc_id and text
    are not read. Empty input gives an empty result.
    """
    text = body(docs).cast("binary")
    rows = docs.select(docs["doc_id"], (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    copies = (
        rows.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("doc_id", "size", "text_crc32", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    )
    return assign(checkpointed(copies), shards, seed, partitions).drop("copy")


def shard(docs: DataFrame, shards: int, seed: int = 7, partitions: int = PARTITIONS) -> DataFrame:
    """``docs`` with all columns in a struct ``row``, plus ``shard`` and ``slot``.

    The plan is drawn on narrow rows; whole rows are exchanged once, when they meet their place.
    Rows equal in id, size and checksum are numbered on both sides, so each takes one place.
    """
    text = F.coalesce(F.col(ROW)["text"], F.lit("")).cast("binary")
    key = ["doc_id", "size", "text_crc32", "copy"]
    rows = packed(docs).select(ROW, F.col(ROW)["doc_id"].alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    same = Window.partitionBy("doc_id", "size", "text_crc32").orderBy(F.xxhash64(ROW))
    rows = rows.withColumn("copy", F.row_number().over(same).cast("long"))
    places = assign(checkpointed(rows.select(*key)), shards, seed, partitions)
    met = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    on = met[0] & met[1] & met[2] & met[3]
    return rows.alias("a").join(places.alias("b"), on).select(F.col(f"a.{ROW}").alias(ROW), "b.shard", "b.slot")
