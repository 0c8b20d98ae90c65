"""Comparison predicates and their And/Or combination, as Spark columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from weir.plans.schema import Field


def resolve(df: DataFrame, name: str) -> Column:
    """The column ``name`` of ``df``; a miss is an error when the plan is built."""
    if name not in df.columns:
        raise ValueError(f"unknown field {name!r}; there are {df.columns}")
    return df[name]


class Predicate:
    """One comparison of a field with a literal or another field.

    ``p.And(q)`` and ``p.Or(q)`` return new predicates.  Whatever the order of
    the calls, the result means ``(p AND every And) OR any Or``.
    """

    symbol = "?"
    #: Whether conjuncts may change places: false where evaluation can raise.
    reorderable = True
    #: Work for a row, a comparison of numbers being 1.
    cost = 1.0

    def __init__(self, field: str | Field, value) -> None:
        self.field = field.name if isinstance(field, Field) else field
        self.value = value
        self.ands: tuple[Predicate, ...] = ()
        self.ors: tuple[Predicate, ...] = ()

    def _with(self, ands: tuple, ors: tuple) -> Predicate:
        new = object.__new__(type(self))
        new.__dict__.update(self.__dict__)
        new.ands, new.ors = ands, ors
        return new

    def And(self, other: Predicate) -> Predicate:
        return self._with((*self.ands, other), self.ors)

    def Or(self, other: Predicate) -> Predicate:
        return self._with(self.ands, (*self.ors, other))

    __and__ = And
    __or__ = Or

    def compare(self, left: Column, right: Column) -> Column:
        raise NotImplementedError

    def own(self, df: DataFrame) -> Column:
        left = resolve(df, self.field)
        right = resolve(df, self.value.name) if isinstance(self.value, Field) else F.lit(self.value)
        return self.compare(left, right)

    def column(self, df: DataFrame) -> Column:
        both = reduce(operator.and_, [p.column(df) for p in self.ands], self.own(df))
        return reduce(operator.or_, [p.column(df) for p in self.ors], both)

    def whole_cost(self) -> float:
        return self.cost + sum(p.whole_cost() for p in (*self.ands, *self.ors))

    def fields(self) -> set[str]:
        own = {self.field} | ({self.value.name} if isinstance(self.value, Field) else set())
        return own.union(*(p.fields() for p in (*self.ands, *self.ors)))

    def conjuncts(self) -> list[Predicate]:
        """Parts joined by And at the top; one part if an Or is present."""
        if self.ors:
            return [self]
        return [self._with((), ()), *(c for p in self.ands for c in p.conjuncts())]

    def movable(self) -> bool:
        return self.reorderable and all(p.movable() for p in (*self.ands, *self.ors))

    def __str__(self) -> str:
        value = self.value.name if isinstance(self.value, Field) else repr(self.value)
        text = " and ".join([f"{self.field} {self.symbol} {value}", *(f"({p})" for p in self.ands)])
        return " or ".join([text, *(f"({p})" for p in self.ors)])


class Equal(Predicate):
    symbol = "=="
    compare = staticmethod(operator.eq)


class NotEqual(Predicate):
    symbol = "!="
    compare = staticmethod(operator.ne)


class Greater(Predicate):
    symbol = ">"
    compare = staticmethod(operator.gt)


class GreaterEqual(Predicate):
    symbol = ">="
    compare = staticmethod(operator.ge)


class Less(Predicate):
    symbol = "<"
    compare = staticmethod(operator.lt)


class LessEqual(Predicate):
    symbol = "<="
    compare = staticmethod(operator.le)


class Like(Predicate):
    """Case-sensitive substring test; ``%`` and ``_`` are ordinary characters."""

    symbol = "contains"
    cost = 2.0

    def own(self, df: DataFrame) -> Column:
        kind = df.schema[self.field].dataType if self.field in df.columns else None
        if kind is not None and not isinstance(kind, T.StringType):
            raise ValueError(f"Like needs a text field; {self.field!r} is {kind.simpleString()}")
        return super().own(df)

    def compare(self, left: Column, right: Column) -> Column:
        return left.contains(right)
