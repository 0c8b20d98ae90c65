"""Declared record schemas and their Spark and packed-binary forms."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

import numpy as np
from pyspark.sql import types as T


class DataType(Enum):
    """Field types, each with its Spark type and its packed little-endian form."""

    Boolean = ("boolean", T.BooleanType(), "?")
    Char = ("char", T.StringType(), "S")
    String = ("string", T.StringType(), "S")
    Int = ("int", T.IntegerType(), "<i4")
    Long = ("long", T.LongType(), "<i8")
    Double = ("double", T.DoubleType(), "<f8")

    @property
    def spark(self) -> T.DataType:
        return self.value[1]

    @property
    def is_text(self) -> bool:
        return self.value[2] == "S"


class SourceType(Enum):
    Stream = "stream"
    Table = "table"


DEFAULT_STRING_WIDTH = 255


@dataclass(frozen=True)
class Field:
    name: str
    data_type: DataType
    size: int = 1
    source: SourceType = SourceType.Stream

    def packed(self) -> str:
        return f"S{self.size}" if self.data_type.is_text else self.data_type.value[2]

    def struct_field(self) -> T.StructField:
        meta = {"size": self.size, "source": self.source.value}
        return T.StructField(self.name, self.data_type.spark, True, meta)


@dataclass(frozen=True)
class Schema:
    """Immutable ordered list of fields; every ``add`` returns a new schema."""

    fields: tuple[Field, ...] = field(default_factory=tuple)

    @staticmethod
    def create() -> Schema:
        return Schema()

    def add_fix_size_field(self, name: str, data_type: DataType, source: SourceType = SourceType.Stream) -> Schema:
        width = DEFAULT_STRING_WIDTH if data_type is DataType.String else 1
        return self.add_var_size_field(name, data_type, width, source)

    def add_var_size_field(self, name: str, data_type: DataType, size: int, source: SourceType = SourceType.Stream) -> Schema:
        if size < 1:
            raise ValueError(f"size of field {name!r} must be at least 1")
        if size > 1 and not data_type.is_text:
            raise ValueError(f"field {name!r}: only Char and String have a width")
        if any(f.name == name for f in self.fields):
            raise ValueError(f"field {name!r} is declared twice")
        return Schema((*self.fields, Field(name, data_type, size, source)))

    addFixSizeField = add_fix_size_field
    addVarSizeField = add_var_size_field

    def get(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ValueError(f"unknown field {name!r}; the schema has {[f.name for f in self.fields]}")

    def struct(self) -> T.StructType:
        return T.StructType([f.struct_field() for f in self.fields])

    def dtype(self) -> np.dtype:
        """Packed record layout: schema order, no padding, little-endian."""
        return np.dtype([(f.name, f.packed()) for f in self.fields])

    def record_size(self) -> int:
        return self.dtype().itemsize

    def print(self) -> None:
        for f in self.fields:
            print(f"{f.name}: {f.data_type.name}" + (f"({f.size})" if f.data_type.is_text else ""))
