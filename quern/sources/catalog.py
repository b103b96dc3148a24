"""Relation schemas and the catalog that keeps them.

Key, length and NOT NULL are recorded; NOT NULL becomes a field that is not nullable, lengths are not enforced
(``violations`` counts what a DataFrame breaks).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import TypeTag


@dataclass(frozen=True)
class Attribute:
    name: str
    type: TypeTag
    length: int | None = None
    not_null: bool = False
    precision: int | None = None
    scale: int | None = None

    def field(self) -> T.StructField:
        kinds = {TypeTag.INTEGER: T.IntegerType(), TypeTag.CHAR: T.StringType()}
        kind = T.DecimalType(self.precision, self.scale) if self.type == TypeTag.NUMERIC else kinds[self.type]
        return T.StructField(self.name, kind, not self.not_null, {"char_len": self.length} if self.type == TypeTag.CHAR else {})

    def __str__(self) -> str:
        size = {TypeTag.CHAR: f"({self.length})", TypeTag.NUMERIC: f"({self.precision}, {self.scale})"}.get(self.type, "")
        return f"{self.name} {self.type.name}{size}{' NOT NULL' if self.not_null else ''}"


@dataclass(frozen=True)
class RelationSchema:
    """primary_key: numbers of attributes, kept as given. segment, size: where the table is stored, and its pages."""

    name: str
    attributes: tuple[Attribute, ...] = ()
    primary_key: tuple[int, ...] = ()
    segment: int = 0
    size: int = 0

    def struct(self) -> T.StructType:
        return T.StructType([a.field() for a in self.attributes])

    def types(self) -> list[TypeTag]:
        return [a.type for a in self.attributes]

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"attributes": [asdict(a) | {"type": a.type.name} for a in self.attributes]}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> RelationSchema:
        d = json.loads(text)
        attributes = tuple(Attribute(**(a | {"type": TypeTag[a["type"]]})) for a in d.pop("attributes"))
        return RelationSchema(attributes=attributes, primary_key=tuple(d.pop("primary_key")), **d)

    def violations(self, df: DataFrame) -> DataFrame:
        """One row: rows with a null where NOT NULL is declared, with a string over its length, and beyond one a key."""
        null, long, key = F.lit(False), F.lit(False), [self.attributes[i].name for i in self.primary_key if i < len(self.attributes)]
        for a in self.attributes:
            if a.not_null:
                null = null | F.col(a.name).isNull()
            if a.type == TypeTag.CHAR:
                long = long | F.coalesce(F.length(a.name) > a.length, F.lit(False))
        counts = df.agg(F.count_if(null).alias("nulls"), F.count_if(long).alias("too_long"))
        extra = df.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("key_repeats")) if key else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("key_repeats"))
        return counts.crossJoin(extra)  # one row each

    def __str__(self) -> str:
        return "".join([f"TABLE {self.name}:\n", *(f"  {a}\n" for a in self.attributes), "  primary key:", *(f" {i}" for i in self.primary_key), "\n"])


class Catalog:
    """Schemas as a text file set of one JSON line a relation; ``store`` replaces them all."""

    def __init__(self, path: str) -> None:
        self.path = path

    def store(self, spark: SparkSession, relations: list[RelationSchema]) -> None:
        rows = [(i, r.to_json()) for i, r in enumerate(relations)]
        df = spark.createDataFrame(rows, "number int, relation string").coalesce(1)
        df.select(F.to_json(F.struct("number", "relation")).alias("value")).write.mode("overwrite").text(self.path)

    def read(self, spark: SparkSession) -> list[RelationSchema]:
        rows = spark.read.schema("number int, relation string").json(self.path).orderBy("number").collect()
        return [RelationSchema.from_json(r.relation) for r in rows]
