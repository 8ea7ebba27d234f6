"""Keyed tables whose changes write only the buckets they touch.

Rows lie in folders by a hash of their key. A commit reads the buckets of the changed keys, writes their new contents
to a folder of its own and publishes a manifest that points these buckets to it (`versions`). A reader keeps the
version it opened; a second writer on the same version fails with `Conflict` and leaves nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodewell.operators import registry as K
from lodewell.plans import versions
from lodewell.plans.storage import materialize

_BUCKET = "_bucket"


@dataclass(frozen=True)
class Table:
    """One version of a keyed table. Null keys have a bucket like any other key."""

    spark: SparkSession
    root: str
    number: int
    manifest: dict

    @staticmethod
    def create(rows: DataFrame, root: str, key: str = "id", buckets: int = 64) -> Table:
        """A new table under root; a table that is there already is a Conflict."""
        manifest = {"key": key, "buckets": buckets, "schema": json.loads(rows.schema.json()), "files": {}}
        return Table(rows.sparkSession, root, 0, manifest)._commit(rows, range(buckets))

    @staticmethod
    def open(spark: SparkSession, root: str, number: int | None = None) -> Table:
        """The newest version, or the one asked for."""
        found = (number, versions.read(spark, root, number)) if number else versions.newest(spark, root)
        if found is None or found[1] is None:
            raise FileNotFoundError(f"no table under {root}")
        return Table(spark, root, *found)

    @property
    def key(self) -> str:
        return self.manifest["key"]

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(self.manifest["schema"])

    def _of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.manifest["buckets"])).cast("int")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        files = self.manifest["files"]
        paths = [f"{self.root}/{p}" for b, p in files.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from the buckets that can hold them."""
        return self.rows(self._touched(keys)).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r["b"] for r in keys.select(self._of(F.col(self.key)).alias("b")).distinct().collect()]  # at most `buckets` rows

    def _commit(self, rows: DataFrame, touched) -> Table:
        own = f"data/{uuid.uuid4().hex}"
        placed = rows.select(*self.schema.fieldNames(), self._of(F.col(self.key)).alias(_BUCKET))
        try:
            # one file a bucket, unless a key makes it too large for one task
            placed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.root}/{own}")
            written = [n for n in versions.children(self.spark, f"{self.root}/{own}") if n.startswith(f"{_BUCKET}=")]
            files = {b: p for b, p in self.manifest["files"].items() if int(b) not in set(touched)}
            files |= {n.partition("=")[2]: f"{own}/{n}" for n in written}
            manifest = self.manifest | {"files": files}
            return Table(self.spark, self.root, versions.publish(self.spark, self.root, self.number, manifest), manifest)
        except versions.Conflict:
            versions.remove(self.spark, f"{self.root}/{own}")
            raise

    def change(self, changes: DataFrame, f: Callable[[DataFrame, DataFrame], DataFrame]) -> Table:
        """The next version: f(rows, changes) over the buckets that hold a key of changes. Without changes, this version."""
        changes = materialize(changes, "changes")
        touched = self._touched(changes)
        return self._commit(f(self.rows(touched), changes), touched) if touched else self

    def upsert(self, new: DataFrame) -> Table:
        return self.change(new, lambda rows, c: K.upsert(rows, c, self.key))

    def patch(self, changes: DataFrame, columns: tuple[str, ...]) -> Table:
        return self.change(changes, lambda rows, c: K.patch(rows, c, self.key, columns))

    def delete(self, keys: DataFrame) -> Table:
        return self.change(keys.select(self.key), lambda rows, c: K.hard_delete(rows, c, self.key))

    def mark(self, keys: DataFrame, column: str = "is_vectorized") -> Table:
        return self.change(keys.select(self.key), lambda rows, c: K.mark(rows, c, self.key, column))

    def append(self, new: DataFrame) -> Table:
        """Further rows, beside those with the same key."""
        return self.change(new, K.append)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the data that none of the newest `keep` versions points to, and older manifests; returns the folders deleted.

        Not to be run while writers are at work: what they have not published yet would go too.
        """
        every = versions.numbers(self.spark, self.root)
        live = [m for n in every[-keep:] if (m := versions.read(self.spark, self.root, n))]
        used = {p.split("/")[1] for m in live for p in m["files"].values()}
        gone = [d for d in versions.children(self.spark, f"{self.root}/data") if d not in used]
        for d in gone:
            versions.remove(self.spark, f"{self.root}/data/{d}")
        for n in every[:-keep]:
            versions.remove(self.spark, f"{self.root}/versions/v{n}.json")
        return len(gone)
