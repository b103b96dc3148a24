"""Operator trees. A node is an immutable description; ``to_df`` turns it into a lazy DataFrame that Catalyst plans.

Columns are addressed by position. Their names come along where they stay unique; where a projection repeats a column
or a join meets a name on both sides, columns are called by place (``c0``... or ``l0``.../``r0``...). Rows are bags.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any, TextIO

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import Cell, constant_family, family

#: The largest estimated size of a side that an explicit request may broadcast.
BROADCAST_LIMIT = 64 << 20


class Node:
    """An operator: open, next and close are Spark's affair; a node can be run any number of times."""

    def to_df(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def schema(self, spark: SparkSession) -> T.StructType:
        return self.to_df(spark).schema

    def columns(self, spark: SparkSession) -> list[str]:
        return self.to_df(spark).columns

    def collect(self, spark: SparkSession) -> list[Row]:
        return Collector(self).run(spark)


def _at(df: DataFrame, place: int) -> T.StructField:
    if not 0 <= place < len(df.columns):
        raise IndexError(f"column {place} of {len(df.columns)}")
    return df.schema[place]


def _column(df: DataFrame, place: int) -> Column:
    return F.col(f"`{_at(df, place).name.replace('`', '``')}`")


@dataclass(frozen=True)
class InMemoryScan(Node):
    """Rows given as Python values (or Cells), in a declared schema: a StructType, a DDL string, or a RelationSchema."""

    rows: Sequence[Sequence[Any]]
    schema_: Any

    def to_df(self, spark: SparkSession) -> DataFrame:
        kind = self.schema_.struct() if hasattr(self.schema_, "struct") else self.schema_
        plain = [tuple((c.integer if c.type.name == "INTEGER" else c.string) if isinstance(c, Cell) else c for c in r) for r in self.rows]
        return spark.createDataFrame(plain, kind)


@dataclass(frozen=True)
class TableScan(Node):
    """A stored table: a Parquet path, read with the declared schema if one is given, or a DataFrame (also a stream)."""

    source: Any
    schema_: Any = None

    def to_df(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.source, DataFrame):
            return self.source
        if hasattr(self.source, "scan"):
            return self.source.scan(spark)
        kind = self.schema_.struct() if hasattr(self.schema_, "struct") else self.schema_
        return (spark.read.schema(kind) if kind is not None else spark.read).parquet(self.source)


@dataclass(frozen=True)
class Selection(Node):
    """Rows whose column equals a constant. A constant of another family, or None, equals nothing."""

    child: Node
    place: int
    constant: Any

    def to_df(self, spark: SparkSession) -> DataFrame:
        df = self.child.to_df(spark)
        value = self.constant
        if isinstance(value, Cell):
            value = value.integer if value.type.name == "INTEGER" else value.string
        own, other = family(_at(df, self.place).dataType), constant_family(value)
        if value is None or (other != own and (own in ("integer", "char") or other in ("integer", "char"))):
            return df.where(F.lit(False))
        return df.where(_column(df, self.place) == F.lit(value))


@dataclass(frozen=True)
class Projection(Node):
    """Columns by place, in any order and any number of times; rows are not made distinct."""

    child: Node
    places: Sequence[int]
    names: Sequence[str] | None = None

    def to_df(self, spark: SparkSession) -> DataFrame:
        df = self.child.to_df(spark)
        own = [_at(df, p).name for p in self.places]
        names = self.names or (own if len(set(own)) == len(own) else [f"c{i}" for i in range(len(own))])
        return df.select(*(_column(df, p).alias(n) for p, n in zip(self.places, names, strict=True)))


@dataclass(frozen=True)
class HashJoin(Node):
    """Inner equi-join on one column of each side; all left columns, then all right ones; duplicates give all pairs.

    build: None lets Spark choose; "shuffle_hash" builds on the left; "broadcast" broadcasts the left if Spark estimates it
    at no more than ``broadcast_limit`` bytes, else builds on it after a shuffle. Keys of different families join to nothing.
    """

    left: Node
    right: Node
    left_place: int
    right_place: int
    build: str | None = None
    broadcast_limit: int = BROADCAST_LIMIT

    def to_df(self, spark: SparkSession) -> DataFrame:
        left, right = self.left.to_df(spark), self.right.to_df(spark)
        a, b = _at(left, self.left_place).dataType, _at(right, self.right_place).dataType
        kept = len(set(left.columns) | set(right.columns)) == len(left.columns) + len(right.columns)
        names = [*left.columns, *right.columns]
        left = left.toDF(*(f"l{i}" for i in range(len(left.columns))))
        right = right.toDF(*(f"r{i}" for i in range(len(right.columns))))
        if self.build not in (None, "broadcast", "shuffle_hash"):
            raise ValueError(f"unknown build {self.build!r}")
        if self.build:
            size = int(str(left._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            left = left.hint("broadcast" if self.build == "broadcast" and size <= self.broadcast_limit else "shuffle_hash")
        same = family(a) == family(b)
        out = left.join(right, F.col(f"l{self.left_place}") == F.col(f"r{self.right_place}") if same else F.lit(False), "inner")
        return out.toDF(*names) if kept else out


@dataclass(frozen=True)
class Collector:
    """Runs a tree and brings its rows to the driver."""

    child: Node

    def run(self, spark: SparkSession) -> list[Row]:
        return self.child.to_df(spark).collect()


def printed(df: DataFrame) -> DataFrame:
    """The rows as lines: cells joined by `` | ``, undefined ones as ``Undefined``."""
    cells = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("Undefined")) for c in df.toDF(*(f"c{i}" for i in range(len(df.columns)))).columns)
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(F.concat_ws(" | ", *cells).alias("value"))


@dataclass(frozen=True)
class Print(Node):
    """Writes each row as a line, then passes the rows on. Lines reach the driver a partition at a time."""

    child: Node
    out: TextIO = field(default_factory=lambda: sys.stdout)

    def run(self, spark: SparkSession) -> DataFrame:
        df = self.child.to_df(spark)
        self.lines(printed(df).toLocalIterator())
        return df

    def lines(self, rows: Iterable[Row]) -> None:
        for row in rows:
            self.out.write(row.value + "\n")

    def to_df(self, spark: SparkSession) -> DataFrame:
        return self.run(spark)
