"""A table that is kept by key in hash buckets and changed batch by batch, on plain Parquet.

    data/version=V/bucket=B/    what batch V wrote of bucket B
    versions/V/                 the versions in force of each bucket after batch V

A batch reads the buckets that its keys fall into, and no other; it adds rows to them (``append``) or
writes them anew (``rewrite``). Its list of versions is written last, so readers and a replay after a lost
driver see the batch as a whole or not at all, and a batch whose list is there changes nothing when it comes
again. Lists and data that only older lists name are removed, so the store holds what is in force
and what a reader of the version before may still read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brandsieve.sources import files

BUCKET = "_bucket"
#: How many versions a bucket may have before a batch that adds to it writes it anew.
MOST_VERSIONS = 8
#: Lists of versions that are kept.
KEPT_LISTS = 2


class KeyedStore:
    """``schema`` names the columns; rows of one ``keys`` value are always in one bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    # -- lists of versions

    def _lists(self) -> list[int]:
        found = [int(n) for n in files.names(self.spark, f"{self.path}/versions") if n.isdigit()]
        return sorted(v for v in found if files.exists(self.spark, f"{self.path}/versions/{v}/_SUCCESS"))

    def _list(self, version: int | None) -> dict[int, list[int]]:
        """Versions in force of each bucket: at most ``buckets`` rows."""
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, versions array<long>").json(f"{self.path}/versions/{version}").collect()
        return {r["bucket"]: list(r["versions"]) for r in rows}

    def version(self) -> int | None:
        """The last whole batch."""
        return max(self._lists(), default=None)

    # -- reading

    def _read(self, held: dict[int, list[int]]) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, versions in sorted(held.items()) for v in versions]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows in force, or those of some buckets: only their files are opened."""
        held = self._list(self.version())
        return self._read(held if buckets is None else {b: v for b, v in held.items() if b in set(buckets)})

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that ``rows`` fall into: at most ``buckets`` numbers."""
        return sorted(r[0] for r in self.bucketed(rows).select(BUCKET).distinct().collect())

    # -- writing

    def _commit(self, version: int, rows: DataFrame, held: dict[int, list[int]], anew: set[int]) -> None:
        rows = self.bucketed(rows).select(*self.schema.names, F.col(BUCKET).alias("bucket"))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        wrote = {int(n.partition("=")[2]) for n in files.names(self.spark, f"{self.path}/data/version={version}") if n.startswith("bucket=")}
        held = {b: v for b, v in held.items() if b not in anew}
        for b in wrote:
            held[b] = [*held.get(b, []), version]
        lists = self.spark.createDataFrame(sorted(held.items()), "bucket int, versions array<long>")
        lists.coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/{version}")
        self._clean()

    def _clean(self) -> None:
        lists = self._lists()
        old, kept = lists[:-KEPT_LISTS], lists[-KEPT_LISTS:]
        if not old:
            return
        pairs = lambda v: {(x, b) for b, versions in self._list(v).items() for x in versions}
        needed = set().union(*map(pairs, kept))
        for v in old:
            for x, b in sorted(pairs(v) - needed):
                files.remove(self.spark, f"{self.path}/data/version={x}/bucket={b}")
            files.remove(self.spark, f"{self.path}/versions/{v}")
        for x in {int(n.partition("=")[2]) for n in files.names(self.spark, f"{self.path}/data")} - {x for x, _ in needed}:
            if x < kept[0]:
                files.remove(self.spark, f"{self.path}/data/version={x}")

    def _before(self, version: int) -> dict[int, list[int]] | None:
        """What batch ``version`` builds on; None if it is done."""
        lists = self._lists()
        if lists and lists[-1] >= version:
            return None
        return self._list(lists[-1] if lists else None)

    def rewrite(self, batch: DataFrame, version: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Write the touched buckets anew as ``merge(rows of those buckets, batch)``; False if the batch is in already."""
        held = self._before(version)
        if held is None:
            return False
        batch = batch.persist()
        try:
            touched = self.touched(batch)
            rows = merge(self._read({b: held[b] for b in touched if b in held}), batch)
            self._commit(version, rows, held, set(touched))
        finally:
            batch.unpersist()
        return True

    def append(self, batch: DataFrame, version: int, added: Callable[[DataFrame, DataFrame], DataFrame], compacted: Callable[[DataFrame], DataFrame]) -> bool:
        """Add ``added(rows of the touched buckets, batch)``; False if the batch is in already.

        A bucket with MOST_VERSIONS versions is written anew as ``compacted`` of its rows and the added ones.
        """
        held = self._before(version)
        if held is None:
            return False
        batch = batch.persist()
        try:
            touched = self.touched(batch)
            rows = added(self._read({b: held[b] for b in touched if b in held}), batch).select(*self.schema.names)
            full = {b: held[b] for b in touched if len(held.get(b, [])) >= MOST_VERSIONS}
            if full:
                inside = F.col(BUCKET).isin(sorted(full))
                rows = self.bucketed(rows)
                rows = rows.where(~inside).drop(BUCKET).unionByName(compacted(self._read(full).unionByName(rows.where(inside).drop(BUCKET))))
            self._commit(version, rows, held, set(full))
        finally:
            batch.unpersist()
        return True
