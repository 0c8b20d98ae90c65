"""Input kinds, each as a batch or a streaming DataFrame."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from weir.plans.config import Config
from weir.plans.schema import Schema
from weir.sources import binary


class InputType(Enum):
    BinaryFile = "fixed_binary"
    CSVFile = "csv"
    Parquet = "parquet"
    JSON = "json"
    ORC = "orc"
    Socket = "socket"
    Memory = "memory"
    Rate = "rate"


def read(spark: SparkSession, kind: InputType, path: str | None, schema: Schema | None, streaming: bool, config: Config, options: dict, columns: list[str] | None = None) -> DataFrame:
    """``schema`` is required but for Parquet, ORC, Socket and Rate batches; ``columns``: all that will be used of it, if known."""
    struct = schema.struct() if isinstance(schema, Schema) else schema
    if kind is InputType.BinaryFile:
        return binary.read(spark, path, schema, streaming, config.run_length, options, columns)
    if kind is InputType.Memory:
        return spark.createDataFrame(options.pop("rows"), struct)
    if kind in (InputType.Socket, InputType.Rate):
        if not streaming:
            raise ValueError(f"{kind.name} is a streaming input")
        return spark.readStream.format(kind.value).options(**options).load()
    reader = spark.readStream if streaming else spark.read
    if streaming:
        reader = reader.option("maxFilesPerTrigger", config.run_length)
    if struct is not None and isinstance(struct, T.StructType):
        reader = reader.schema(struct)
    elif streaming or kind is InputType.CSVFile:
        raise ValueError(f"{kind.name} needs a schema here")
    return reader.format(kind.value).options(**options).load(path)
