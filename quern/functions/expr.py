"""64-bit integer expressions that compile to Columns.

Plain mode is Spark's checked arithmetic (an overflow or a division by zero raises under ANSI mode). In wrapping mode
sums, differences, products and negations are taken modulo 2**64, computed in 38-digit decimals, whatever the session's
mode. Division truncates toward zero; MIN / -1 is not defined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HALF, _WHOLE = "9223372036854775808", "18446744073709551616"


def _wrapped(value: Column) -> Column:
    wide, half, whole = "decimal(38,0)", F.lit(_HALF).cast("decimal(38,0)"), F.lit(_WHOLE).cast("decimal(38,0)")
    return (F.pmod((value.cast(wide) + half).cast(wide), whole).cast(wide) - half).cast("bigint")


class Expr:
    """A tree over the arguments of a function; Python's operators build larger ones."""

    def column(self, args: Sequence[Column], wrap: bool = False) -> Column:
        raise NotImplementedError

    def argument_count(self) -> int:
        raise NotImplementedError

    def __neg__(self) -> Expr:
        return Neg(self)

    def __pos__(self) -> Expr:
        return self

    def __add__(self, other: Expr | int) -> Expr:
        return Binary("+", self, lift(other))

    def __radd__(self, other: int) -> Expr:
        return Binary("+", lift(other), self)

    def __sub__(self, other: Expr | int) -> Expr:
        return Binary("-", self, lift(other))

    def __rsub__(self, other: int) -> Expr:
        return Binary("-", lift(other), self)

    def __mul__(self, other: Expr | int) -> Expr:
        return Binary("*", self, lift(other))

    def __rmul__(self, other: int) -> Expr:
        return Binary("*", lift(other), self)

    def __truediv__(self, other: Expr | int) -> Expr:
        return Binary("/", self, lift(other))

    def __rtruediv__(self, other: int) -> Expr:
        return Binary("/", lift(other), self)


def lift(value: Expr | int) -> Expr:
    return value if isinstance(value, Expr) else Const(value)


@dataclass(frozen=True)
class Const(Expr):
    value: int

    def __post_init__(self) -> None:
        if not -(1 << 63) <= self.value < 1 << 63:
            raise OverflowError(f"{self.value} has more than 64 bits")

    def column(self, args: Sequence[Column], wrap: bool = False) -> Column:
        return F.lit(self.value).cast("bigint")

    def argument_count(self) -> int:
        return 0


@dataclass(frozen=True)
class Arg(Expr):
    number: int

    def column(self, args: Sequence[Column], wrap: bool = False) -> Column:
        return args[self.number].cast("bigint")

    def argument_count(self) -> int:
        return self.number + 1


@dataclass(frozen=True)
class Neg(Expr):
    of: Expr

    def column(self, args: Sequence[Column], wrap: bool = False) -> Column:
        x = self.of.column(args, wrap)
        return _wrapped(-x.cast("decimal(38,0)")) if wrap else -x

    def argument_count(self) -> int:
        return self.of.argument_count()


@dataclass(frozen=True)
class Binary(Expr):
    operator: str
    left: Expr
    right: Expr

    def column(self, args: Sequence[Column], wrap: bool = False) -> Column:
        a, b = self.left.column(args, wrap), self.right.column(args, wrap)
        if self.operator == "/":
            return F.call_function("div", a, b)
        if wrap:
            a, b = a.cast("decimal(20,0)"), b.cast("decimal(20,0)")
        out = a + b if self.operator == "+" else a - b if self.operator == "-" else a * b
        return _wrapped(out) if wrap else out

    def argument_count(self) -> int:
        return max(self.left.argument_count(), self.right.argument_count())


def const(value: int) -> Const:
    return Const(value)


def arg(number: int) -> Arg:
    return Arg(number)


@dataclass(frozen=True)
class ExpressionFunction:
    """A named function of 64-bit integers."""

    name: str
    expr: Expr
    wrap: bool = False

    @property
    def arity(self) -> int:
        return self.expr.argument_count()

    def __call__(self, *args: Column) -> Column:
        if len(args) < self.arity:
            raise TypeError(f"{self.name} takes {self.arity} arguments")
        return self.expr.column(args, self.wrap).alias(self.name)

    def on(self, df: DataFrame, *columns: str, alias: str | None = None) -> DataFrame:
        """df with one more column."""
        return df.withColumn(alias or self.name, self(*(F.col(c) for c in columns)))


def horner(coefficients: Sequence[int], x: Expr) -> Expr:
    """The polynomial with these coefficients, the lowest first."""
    out: Expr = Const(0)
    for c in reversed(coefficients):
        out = c + x * out
    return out
