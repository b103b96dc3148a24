"""Stored tables whose rows are addressed by tuple id, as immutable snapshots.

``data`` and ``free`` of snapshot n lie under ``v<n>``; the file ``CURRENT`` names the snapshot and is replaced by a rename
once the snapshot is whole, so readers see the old or the new one. There is a single writer. Ids of removed rows are used
again, the smallest first; an updated row keeps its id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import numbered


#: Snapshots that stay beside the current one, for readers that have begun.
KEPT = 2


class UnknownTid(KeyError):
    pass


def without(rows: DataFrame, tids: DataFrame) -> DataFrame:
    return rows.join(tids.select("tid").distinct(), "tid", "left_anti")


def replaced(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows with the values of changes (tid and all columns) where it has their tid."""
    new = changes.select("tid", F.struct(*(c for c in rows.columns if c != "tid")).alias("_new"))
    return rows.join(new, "tid", "left").select("tid", *(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in rows.columns if c != "tid"))


class SegmentTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.row_schema = spark, path.rstrip("/"), schema
        self.schema = T.StructType([T.StructField("tid", T.LongType(), False), *schema])
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _version(self) -> int:
        current = self._path(f"{self.path}/CURRENT")
        if not self._fs.exists(current):
            return -1
        return int(self.spark.read.text(f"{self.path}/CURRENT").head()[0])

    def _read(self, what: str, schema: T.StructType | str) -> DataFrame:
        version = self._version()
        if version < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{version}/{what}")

    def scan(self, spark: SparkSession | None = None) -> DataFrame:
        return self._read("data", self.schema)

    def free(self) -> DataFrame:
        return self._read("free", "tid bigint")

    def _commit(self, data: DataFrame, free: DataFrame) -> None:
        version = self._version() + 1
        target = f"{self.path}/v{version}"
        data.write.mode("overwrite").parquet(f"{target}/data")
        free.write.mode("overwrite").parquet(f"{target}/free")
        temporary = self._path(f"{self.path}/.CURRENT.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(str(version).encode()))
        out.close()
        current = self._path(f"{self.path}/CURRENT")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri() if current.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        context.rename(temporary, current, options)
        for old in range(max(0, version - KEPT), version - KEPT + 1):
            self._fs.delete(self._path(f"{self.path}/v{old}"), True)

    def insert(self, rows: DataFrame, *order: str) -> DataFrame:
        """Appends the rows (in the order given, else as they come); the rows with their tids."""
        data, free = self.scan(), self.free()
        top = data.agg(F.max("tid")).head()[0]
        gone_top, n_free = free.agg(F.max("tid"), F.count("*")).head()
        following = max(-1 if top is None else top, -1 if gone_top is None else gone_top) + 1
        new = numbered(rows.select(*self.row_schema.names), "_n", *order)
        again = numbered(free.select("tid"), "_n", "tid")
        new = new.join(again, "_n", "left").withColumn("tid", F.coalesce("tid", F.col("_n") - n_free + following)).select(*self.schema.names)
        version = self._version() + 1
        new.write.mode("overwrite").parquet(f"{self.path}/v{version}/new")
        new = self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version}/new")
        self._commit(data.unionByName(new), free.join(new.select("tid"), "tid", "left_anti"))
        return new

    def _missing(self, tids: DataFrame) -> list[int]:
        return [r.tid for r in tids.select("tid").join(self.scan().select("tid"), "tid", "left_anti").limit(10).collect()]

    def remove(self, tids: DataFrame, missing: str = "raise") -> None:
        """Removes the rows; unknown ids raise, or are passed over with missing="ignore"."""
        if missing == "raise" and (bad := self._missing(tids)):
            raise UnknownTid(bad)
        data = self.scan()
        gone = data.select("tid").join(tids.select("tid").distinct(), "tid", "left_semi")
        self._commit(without(data, tids), self.free().union(gone))

    def lookup(self, tids: DataFrame | int) -> DataFrame:
        """The rows with these ids; unknown ids raise."""
        if isinstance(tids, int):
            found = self.scan().where(F.col("tid") == tids)
            if found.head() is None:
                raise UnknownTid(tids)
            return found
        if bad := self._missing(tids):
            raise UnknownTid(bad)
        return self.scan().join(tids.select("tid").distinct(), "tid", "left_semi")

    def update(self, changes: DataFrame) -> None:
        """Replaces the rows with the ids of changes (tid and all columns); unknown ids raise."""
        if bad := self._missing(changes):
            raise UnknownTid(bad)
        self._commit(replaced(self.scan(), changes), self.free())
