"""Unique ordered indexes as batch operations on (key..., tid) DataFrames.

Every operation gives a new index; the old one stays valid. A comparator of one's own is a tuple of expressions over the key
columns (``order``): keys are equal where these are, and ordered as these are, for inserts, erasures, lookups and ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The most entries that are drawn as a graph.
DOT_LIMIT = 100_000


@dataclass(frozen=True)
class UniqueIndex:
    df: DataFrame
    keys: tuple[str, ...] = ("key",)
    tid: str = "tid"
    order: tuple[Column, ...] | None = None

    @staticmethod
    def empty(spark: SparkSession, key_types: str = "key bigint", order: tuple[Column, ...] | None = None) -> UniqueIndex:
        df = spark.createDataFrame([], f"{key_types}, tid bigint")
        return UniqueIndex(df, tuple(df.columns[:-1]), "tid", order)

    def _with(self, df: DataFrame) -> UniqueIndex:
        return UniqueIndex(df, self.keys, self.tid, self.order)

    @property
    def _by(self) -> tuple[Column, ...]:
        return self.order or tuple(F.col(k) for k in self.keys)

    @property
    def _names(self) -> list[str]:
        return [f"_by{i}" for i in range(len(self._by))]

    def _marked(self, df: DataFrame) -> DataFrame:
        """df with what its keys compare by."""
        return df.select("*", *(c.alias(n) for c, n in zip(self._by, self._names, strict=True)))

    def _values(self, key: Any) -> tuple:
        """What a key compares by."""
        key = key if isinstance(key, tuple) else (key,)
        if not self.order:
            return key
        kinds = T.StructType([self.df.schema[k] for k in self.keys])
        return tuple(self.df.sparkSession.createDataFrame([key], kinds).select(*self.order).head())

    def insert(self, rows: DataFrame) -> tuple[UniqueIndex, DataFrame]:
        """The index with the rows whose key is new, and the rejected rows (key..., tid, and how many of each).

        Of rows with equal keys the one with the smallest tid is taken (ties: the smallest key); repeats are counted before
        the shuffle.
        """
        names = self._names
        least = F.min(F.struct(F.col(self.tid), *(F.col(k) for k in self.keys))).alias("_least")
        counted = self._marked(rows).groupBy(*names).agg(least, F.count("*").alias("n"))
        counted = counted.select(*names, *(F.col(f"_least.`{k}`").alias(k) for k in self.keys), F.col(f"_least.`{self.tid}`").alias(self.tid), "n")
        known = self._marked(self.df).select(*names, F.lit(True).alias("_known"))
        marked = counted.join(known, names, "left")
        new = marked.where("_known is null")
        rejected = marked.withColumn("n", F.col("n") - F.col("_known").isNull().cast("int")).where("n > 0").select(*self.keys, self.tid, "n")
        return self._with(self.df.unionByName(new.select(*self.keys, self.tid))), rejected

    def erase(self, keys: DataFrame) -> tuple[UniqueIndex, DataFrame]:
        """The index without the keys, and the keys that it did not have."""
        names, own = self._names, self._marked(self.df)
        wanted = self._marked(keys.select(*self.keys).distinct())
        left = own.join(wanted.select(*names).distinct(), names, "left_anti").select(*self.df.columns)
        return self._with(left), wanted.join(own.select(*names), names, "left_anti").select(*self.keys)

    def _equals(self, key: Any) -> Column:
        out = F.lit(True)
        for c, v in zip(self._by, self._values(key), strict=True):
            out = out & (c == F.lit(v))
        return out

    def lookup(self, key: Any) -> DataFrame:
        """The entry with the key; for a DataFrame of keys each of its rows, with a null tid where the index has none."""
        if isinstance(key, DataFrame):
            return self._marked(key).join(self._marked(self.df).select(*self._names, self.tid), self._names, "left").drop(*self._names)
        return self.df.where(self._equals(key))

    def get(self, key: Any) -> int | None:
        found = self.lookup(key).select(self.tid).head()
        return None if found is None else found[0]

    def lookup_range(self, a: Any, b: Any) -> DataFrame:
        """Entries from the smaller to the larger bound, both included, in key order; bounds may come in either order."""
        low, high = sorted((self._values(a), self._values(b)))
        by = self._by
        inside = by[0].between(F.lit(low[0]), F.lit(high[0]))  # for a plain key this reaches the Parquet scan
        if len(by) > 1:
            kinds = [t for _, t in self.df.select(*by).dtypes]
            key = F.struct(*(c.alias(n) for c, n in zip(by, self._names, strict=True)))
            bound = lambda x: F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(x, kinds, self._names, strict=True)))
            inside = (key >= bound(low)) & (key <= bound(high)) & inside
        return self.df.where(inside).orderBy(*by)

    def size(self) -> int:
        return self.df.count()

    def save(self, path: str, partitions: int = 8) -> None:
        """As Parquet, in ranges and sorted, so that row-group statistics serve lookups."""
        self.df.repartitionByRange(partitions, *self._by).sortWithinPartitions(*self._by).write.mode("errorifexists").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, keys: Sequence[str] = ("key",), tid: str = "tid", order: tuple[Column, ...] | None = None) -> UniqueIndex:
        return UniqueIndex(spark.read.parquet(path), tuple(keys), tid, order)

    def export_dot(self, max_node_size: int = 4) -> str:
        """A drawing of a search tree over the entries, filled from the bottom; at most DOT_LIMIT entries."""
        rows = self.df.orderBy(*self._by).limit(DOT_LIMIT + 1).collect()
        if len(rows) > DOT_LIMIT:
            raise ValueError(f"over {DOT_LIMIT} entries")
        label = lambda r: ",".join(str(r[k]) for k in self.keys)
        lines, number = ["digraph index {", "  node [shape=record];"], 0
        level = []
        for i in range(0, len(rows), max_node_size):
            part = rows[i : i + max_node_size]
            lines.append(f'  n{number} [label="{"|".join(f"{label(r)}: {r[self.tid]}" for r in part)}"];')
            level.append((number, label(part[-1])))
            if number:
                lines.append(f"  n{number - 1} -> n{number} [style=dashed, constraint=false];")
            number += 1
        while len(level) > 1:
            upper = []
            for i in range(0, len(level), max_node_size):
                part = level[i : i + max_node_size]
                lines.append(f'  n{number} [label="{"|".join(k for _, k in part)}"];')
                lines += [f"  n{number} -> n{c};" for c, _ in part]
                upper.append((number, part[-1][1]))
                number += 1
            level = upper
        return "\n".join([*lines, "}", ""])
