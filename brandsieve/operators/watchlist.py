"""Watchlist dimension: match terms and official stems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandsieve.functions.domains import strip

# Bit positions for the letters of a term or label; any other letter sets the sign bit.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789_-"


def letters(word: Column) -> Column:
    return F.array_remove(F.split(word, ""), "")


def letter_mask(word: Column) -> Column:
    """Set of distinct letters of a word as a bit set, in generated code (no lambda)."""
    bits = [
        F.when(word.contains(c), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(_LETTERS)
    ]
    bits.append(F.when(word.rlike(f"[^{_LETTERS}]"), F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long")))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def max_edits(length: Column) -> Column:
    return F.when(length <= 5, 1).when(length <= 8, 2).otherwise(3)


def watchlist_terms(watch: DataFrame) -> DataFrame:
    """One row per brand and distinct cleaned term, brand name first, then the aliases in order.

    Input: brand_idx, brand_name, aliases (``;``-list), official_domain, category.
    """
    brand = strip(F.col("brand_name"))
    aliases = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), ";"), strip), lambda a: a != "")
    words = F.transform(
        F.concat(F.array(brand), aliases),
        lambda t, i: F.struct(
            i.alias("term_idx"), t.alias("term"), F.replace(F.lower(t), F.lit(" "), F.lit("")).alias("clean")
        ),
    )
    first_of_kind = lambda w: (w["clean"] != "") & (
        F.array_position(F.col("words.clean"), w["clean"]) == w["term_idx"] + 1
    )
    return (
        watch.withColumn("words", words)
        .select(
            F.col("brand_idx").cast("long").alias("brand_idx"),
            brand.alias("brand_name"),
            F.lower(strip(F.col("official_domain"))).alias("official_domain"),
            strip(F.col("category")).alias("category"),
            F.explode(F.filter("words", first_of_kind)).alias("w"),
        )
        .select(
            "brand_idx",
            "brand_name",
            "official_domain",
            F.substring_index("official_domain", ".", 1).alias("official_stem"),
            "category",
            F.col("w.term_idx").alias("term_idx"),
            F.col("w.term").alias("term"),
            F.col("w.clean").alias("term_clean"),
            F.length("w.clean").alias("term_len"),
        )
    )
