"""Cell types and the rules by which they compare.

Two families exist: whole numbers (Integer) and strings (Char). Cells of different families are never equal, and a
whole number sorts before a string. Columns get their family from their Spark type, so the rule is applied when a plan is
built; other Spark types compare by Spark's rules within one type.
"""

from __future__ import annotations

import enum
import functools

from pyspark.sql import types as T


class TypeTag(enum.IntEnum):
    INTEGER, CHAR, NUMERIC, INVALID = range(4)


def family(kind: T.DataType | TypeTag) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.StringType):
        return "char"
    return kind.simpleString()


def constant_family(value: object) -> str | None:
    """The family of a Python constant; None for those that equal nothing by rule (None) or go by Spark's rules."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, str):
        return "char"
    return None


@functools.total_ordering
class Cell:
    """A single value with a strict type: a whole number, a string, or undefined."""

    __slots__ = ("_value",)

    def __init__(self, value: int | str | None = None) -> None:
        if isinstance(value, bool) or not isinstance(value, int | str | None):
            raise TypeError(f"a cell holds an int or a str, not {value!r}")
        self._value = value

    @property
    def type(self) -> TypeTag:
        return {int: TypeTag.INTEGER, str: TypeTag.CHAR, type(None): TypeTag.INVALID}[type(self._value)]

    def _get(self, kind: type):
        if type(self._value) is not kind:
            raise TypeError(f"the cell holds {self.type.name}")
        return self._value

    @property
    def integer(self) -> int:
        return self._get(int)

    @integer.setter
    def integer(self, value: int) -> None:
        self._value = Cell(value)._get(int)

    @property
    def string(self) -> str:
        return self._get(str)

    @string.setter
    def string(self, value: str) -> None:
        self._value = Cell(value)._get(str)

    def _known(self) -> tuple[TypeTag, object]:
        if self._value is None:
            raise TypeError("the cell is undefined")
        return self.type, self._value.encode() if isinstance(self._value, str) else self._value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Cell) and self._known() == other._known()

    def __lt__(self, other: Cell) -> bool:
        (t, a), (u, b) = self._known(), other._known()
        return a < b if t == u else t < u

    def __hash__(self) -> int:
        return hash(self._known())

    def __str__(self) -> str:
        return "Undefined" if self._value is None else str(self._value)

    def __repr__(self) -> str:
        return f"Cell({self._value!r})"
