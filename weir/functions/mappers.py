"""Row mappers: one output column computed from a field and an operand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from weir.functions.predicates import resolve
from weir.plans.schema import Field


class Mapper:
    """``output = op(field, value)``; ``value`` is a literal or a :class:`Field`.

    Without ``output`` the field itself is replaced.  Subclasses give
    ``apply(left, right, integral)`` and return a column.
    """

    symbol = "?"

    def __init__(self, field: str | Field, value, output: str | Field | None = None) -> None:
        self.field = field.name if isinstance(field, Field) else field
        self.value = value
        self.output = (output.name if isinstance(output, Field) else output) or self.field

    def apply(self, left: Column, right: Column, integral: bool) -> Column:
        raise NotImplementedError

    def fields(self) -> set[str]:
        return {self.field} | ({self.value.name} if isinstance(self.value, Field) else set())

    def transform(self, df: DataFrame) -> DataFrame:
        left = resolve(df, self.field)
        kind = lambda name: isinstance(df.schema[name].dataType, T.IntegralType)
        if isinstance(self.value, Field):
            right, whole = resolve(df, self.value.name), kind(self.value.name)
        else:
            right, whole = F.lit(self.value), isinstance(self.value, int)
        return df.withColumn(self.output, self.apply(left, right, whole and kind(self.field)))

    def __str__(self) -> str:
        value = self.value.name if isinstance(self.value, Field) else repr(self.value)
        return f"{self.output} = {self.field} {self.symbol} {value}"


class Add(Mapper):
    symbol = "+"

    def apply(self, left, right, integral):
        return left + right


class Subtract(Mapper):
    symbol = "-"

    def apply(self, left, right, integral):
        return left - right


class Divide(Mapper):
    """Truncating for two integral operands, else ordinary division.

    A zero divisor raises under ANSI mode; ``safe=True`` gives null instead.
    """

    symbol = "/"

    def __init__(self, field, value, output=None, safe: bool = False) -> None:
        super().__init__(field, value, output)
        self.safe = safe

    def apply(self, left, right, integral):
        if self.safe:
            right = F.nullif(right, F.lit(0))
        return F.call_function("div", left, right) if integral else left / right


class Concat(Mapper):
    symbol = "||"

    def apply(self, left, right, integral):
        return F.concat(left, right)
