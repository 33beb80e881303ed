"""What several operators share: text normalisation, checkpoints and packed rows."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROW = "row"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept.

    ``lower`` does just that on pure ASCII texts and is much faster than ``translate``.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def body(docs: DataFrame, column: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(docs[column], F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that working columns cannot clash with the caller's."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(ROW))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The caller's columns back out of ``row``."""
    return df.select(*[F.col(ROW)[c].alias(c) for c in columns])


def shared_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: the session's ``spark.checkpoint.dir``.

    Only a local session, whose executors are this process, may go without: it gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = Path(tempfile.mkdtemp(prefix="ckpt-")).as_uri()
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the folder all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: A key with more than one in HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key`` of ``groups``, whose ``size`` counts the key's rows.

    Hot keys, fewer than HOT_SHARE by their definition, are broadcast and their rows stay where they
    are; the rows of all other keys are shuffled. ``total`` is the number of rows of all keys.
    """
    hot = F.broadcast(groups.where(F.col(size) * HOT_SHARE > total))
    cold = groups.where(F.col(size) * HOT_SHARE <= total)
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(cold, key))
