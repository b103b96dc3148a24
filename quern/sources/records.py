"""The record codec: a whole number is 4 bytes (signed, little-endian), a string 8 bytes of length and its UTF-8 bytes."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import TypeTag, family


class RecordError(ValueError):
    """A record that does not fit its types."""


def encode(row: Sequence[Any]) -> bytes:
    out = []
    for cell in row:
        if isinstance(cell, int) and not isinstance(cell, bool):
            out.append(struct.pack("<i", cell))
        elif isinstance(cell, str):
            raw = cell.encode()
            out.append(struct.pack("<Q", len(raw)) + raw)
        else:
            raise RecordError(f"no record form for {cell!r}")
    return b"".join(out)


def decode(record: bytes, types: Sequence[TypeTag]) -> tuple[Any, ...]:
    out: list[Any] = []
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if n > len(record) - at:
            raise RecordError("the record is too short")
        at += n
        return record[at - n : at]

    for tag in types:
        if tag == TypeTag.INTEGER:
            out.append(struct.unpack("<i", take(4))[0])
        elif tag == TypeTag.CHAR:
            out.append(take(struct.unpack("<Q", take(8))[0]).decode())
        else:
            raise RecordError(f"no record form for {tag.name}")
    if at != len(record):
        raise RecordError(f"{len(record) - at} bytes are left over")
    return tuple(out)


def _swapped(digits: Column, size: int) -> Column:
    """Hexadecimal digits of so many bytes in the opposite order of bytes."""
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))))


def encoded(df: DataFrame) -> DataFrame:
    """A binary column ``record`` of all rows; only integer and string columns. Null cells, and numbers of over 32 bits, raise."""
    if bad := [f.name for f in df.schema if family(f.dataType) not in ("integer", "char")]:
        raise RecordError(f"no record form for columns {bad}")
    parts = []
    for f in df.schema:
        cell = F.col(f"`{f.name}`")
        if family(f.dataType) == "integer":
            value = F.when(cell.cast("bigint").between(-(1 << 31), (1 << 31) - 1), cell.cast("bigint")).otherwise(F.raise_error(F.lit(f"no record form for a cell of {f.name}")).cast("bigint"))
            parts.append(_swapped(F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"), 4))
        else:
            text = F.coalesce(cell, F.raise_error(F.lit(f"no record form for a cell of {f.name}")).cast("string"))
            parts += [_swapped(F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0"), 8), F.hex(text.cast("binary"))]
    return df.select(F.unhex(F.concat(*parts) if parts else F.lit("")).alias("record"))


def decoded(df: DataFrame, schema: T.StructType, column: str = "record") -> DataFrame:
    """The rows of a binary column of records; one that does not fit the schema raises."""
    record = F.col(f"`{column}`")
    out, size = df.select(record.alias("_r"), F.lit(1).cast("bigint").alias("_at")), F.octet_length("_r").cast("bigint")
    fits = lambda n: F.col("_at") + n <= size + 1
    short = F.raise_error(F.lit("the record is too short"))
    number = lambda n: F.conv(_swapped(F.hex(F.substr(F.col("_r"), F.col("_at").cast("int"), F.lit(n))), n), 16, 10).cast("bigint")
    for i, f in enumerate(schema):
        if family(f.dataType) == "integer":
            value = F.when(fits(4), number(4)).otherwise(short.cast("bigint"))
            out = out.withColumn(f"_v{i}", value)
            signed = F.when(F.col(f"_v{i}") >= 1 << 31, F.col(f"_v{i}") - (1 << 32)).otherwise(F.col(f"_v{i}"))
            out = out.withColumn(f"_c{i}", signed.cast("int")).withColumn("_at", F.col("_at") + 4).drop(f"_v{i}")
        else:
            out = out.withColumn("_n", F.when(fits(8), number(8)).otherwise(short.cast("bigint"))).withColumn("_at", F.col("_at") + 8)
            text = F.decode(F.substr(F.col("_r"), F.col("_at").cast("int"), F.col("_n").cast("int")), "UTF-8")
            out = out.withColumn(f"_c{i}", F.when(fits(F.col("_n")), text).otherwise(short.cast("string"))).withColumn("_at", F.col("_at") + F.col("_n")).drop("_n")
    whole = F.when(F.col("_at") == size + 1, F.lit(True)).otherwise(F.raise_error(F.lit("bytes are left over")).cast("boolean"))
    return out.where(whole).select(*(F.col(f"_c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(schema)))
