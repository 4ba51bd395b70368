"""Keyed state between micro-batches, for steps that join a batch with what came before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType


class KeyedState:
    """One row per key, in the shared folder: a snapshot now and then, and the changes since.

    A batch writes the rows of the keys that it changes, under its number. Every ``every``
    batches the rows in force are written as a snapshot and what no batch can ask for again is
    deleted. Which snapshot and which changes make up the state before a batch depends on the
    batch's number alone, so a batch that is repeated after a failure reads the same rows and
    replaces its own. A read touches one snapshot and fewer than ``every`` changes, however long
    the stream has run; rows lie in buckets of their keys, and a look-up reads those it needs.

    ``keep`` names the rows that a snapshot takes over; the others are as if they never were.
    Null is a key like any other. ``values`` are all columns that are not keys.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, keys: list[str],
                 every: int = 8, buckets: int = 16, keep: Column | None = None):
        empty = spark.createDataFrame([], schema)
        self.spark, self.folder, self.keys, self.every, self.buckets = spark, folder, keys, every, buckets
        self.columns, self.values = empty.columns, [c for c in empty.columns if c not in keys]
        self.stored = StructType([*empty.schema.fields]).add("bucket", IntegerType())
        self.schema, self.keep = empty.schema, keep

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def _key(self) -> Column:
        return F.struct(*self.keys).alias("_key")

    def _write(self, rows: DataFrame, name: str) -> None:
        placed = rows.select(*self.columns, self._bucket())
        placed.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}")

    def _read(self, name: str, version: int) -> DataFrame:
        rows = self.spark.read.schema(self.stored).parquet(f"{self.folder}/{name}")
        return rows.withColumn("_version", F.lit(version))

    def base(self, number: int) -> int:
        """The batch before which the snapshot was taken that batch ``number`` starts from."""
        return number // self.every * self.every

    def in_force(self, number: int, wanted: DataFrame | None = None) -> DataFrame:
        """The rows before batch ``number``; with ``wanted``, of its keys only."""
        return self._newest(self.base(number), number, wanted)

    def _newest(self, base: int, number: int, wanted: DataFrame | None = None) -> DataFrame:
        parts = [self._read(f"snapshot={base}", base - 1)] if base else []
        parts += [self._read(f"change={i}", i) for i in range(base, number)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, parts).withColumn("_key", self._key())
        if wanted is not None:
            keys = wanted.select(self._bucket(), self._key()).distinct()
            rows = rows.join(keys, ["bucket", "_key"], "left_semi")
        newest = rows.groupBy("_key").agg(F.max_by(F.struct(*self.values), "_version").alias("_row"))
        return newest.select(*[F.col(f"_key.{c}") if c in self.keys else F.col(f"_row.{c}") for c in self.columns])

    def put(self, number: int, rows: DataFrame) -> None:
        """Replace the rows of these keys; one row per key."""
        self._write(rows, f"change={number}")
        if (number + 1) % self.every == 0:
            rows = self._newest(self.base(number), number + 1)
            self._write(rows if self.keep is None else rows.filter(self.keep), f"snapshot={number + 1}")
            self._forget(number + 1 - self.every)

    def _forget(self, before: int) -> None:
        """Delete the changes before a batch and the snapshots before the one it starts from."""
        files = self.spark._jvm.org.apache.hadoop.fs
        root = files.Path(self.folder)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in system.listStatus(root):
            name = status.getPath().getName()
            kind, _, number = name.partition("=")
            if number.isdigit() and int(number) < before and kind in ("change", "snapshot"):
                system.delete(status.getPath(), True)
