"""Shards with size-tiered compaction, in DataFrame operations only.

Arrivals are written as small immutable shards.  Runs of similar size (one
tier spans a factor of ``FAN_IN``) are merged as soon as a tier holds
``FAN_IN`` of them, into files of about ``target_bytes``; a run of that size is
done and not merged again.  What is live is
told by a manifest: each change writes a new numbered version, put in place by
one exclusive rename, so a reader sees the old set or the new one.  Of two
writers of a version one fails: an append then goes on from the version that
won, a merge takes its files away and raises :class:`Conflict`.  Shards that no
version of the last ``keep`` names are removed by :meth:`Shards.vacuum`.

Rows are kept as they are: nulls, empty and long texts, ties, repeated rows
and columns of any name.  An empty arrival makes no shard.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

FAN_IN = 4
#: Bytes of values of a file that compaction aims at, and of a run of the lowest tier.
TARGET_BYTES, BASE_BYTES = 128 << 20, 1 << 20


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Shards:
    """A dataset of ``schema`` under ``root`` (any store that Spark writes to)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, base_bytes: int = BASE_BYTES) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.base_bytes = target_bytes, base_bytes
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self.store = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # --- manifest ---------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self.store.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in self.store.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """``{"version": n, "shards": [...]}``; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "shards": []}
        lines = self.spark.read.option("wholetext", True).text(f"{self.root}/manifest/{version:08d}.json").collect()
        return json.loads(lines[0].value)

    def commit(self, before: dict, gone: list[str], new: list[dict]) -> dict:
        """The next version, or :class:`Conflict`."""
        after = {"version": before["version"] + 1, "shards": [s for s in before["shards"] if s["id"] not in gone] + new}
        self.store.mkdirs(self._path("manifest"))
        draft = self._path(f"manifest/.{uuid.uuid4().hex}")
        out = self.store.create(draft, False)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        final = self._path(f"manifest/{after['version']:08d}.json")
        if self.store.exists(final) or not self.store.rename(draft, final):
            self.store.delete(draft, False)
            raise Conflict(f"version {after['version']} exists")
        return after

    # --- data -------------------------------------------------------------------

    def append(self, rows: DataFrame, arrival=None) -> dict:
        """Write ``rows`` as new shards, one for each value of the column ``arrival`` (or one in all), and commit.

        One pass over ``rows``, without a shuffle.  A null value is an arrival of its own.
        """
        batch = uuid.uuid4().hex
        marked = rows.select(*self.schema.names, F.coalesce((arrival if arrival is not None else F.lit(0)).cast("string"), F.lit("none")).alias("_arrival"))
        folder = f"{self.root}/data/{batch}"
        marked.write.partitionBy("_arrival").parquet(folder)
        if not self.store.exists(self.hadoop.fs.Path(folder)):
            return self.manifest()
        new = self._measured(folder)
        while True:  # an append holds beside whatever else was committed
            try:
                return self.commit(self.manifest(), [], new)
            except Conflict:
                continue

    def _row_bytes(self) -> Column:
        """Bytes of a row's values: of text and binary as they are, of nested ones as JSON, eight of any other."""
        out = F.lit(0)
        for f in self.schema.fields:
            if isinstance(f.dataType, T.StringType | T.BinaryType):
                out = out + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
            elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
                out = out + F.octet_length(F.to_json(F.struct(f"`{f.name}`")))
            else:
                out = out + 8
        return out.cast("long")

    def _measured(self, folder: str) -> list[dict]:
        """Rows and bytes of each arrival folder just written; as many result rows as arrivals."""
        names = [s.getPath().getName() for s in self.store.listStatus(self.hadoop.fs.Path(folder)) if s.isDirectory() and s.getPath().getName().startswith("_arrival=")]
        if not names:
            return []
        whole = self.spark.read.schema(self._stored()).parquet(folder)
        octets = F.sum(self._row_bytes()).alias("bytes")
        found = {r._arrival: r for r in whole.groupBy("_arrival").agg(F.count(F.lit(1)).alias("rows"), octets).collect()}
        decode = {f"_arrival={self._escaped(k)}": r for k, r in found.items()}
        return [{"id": f"{folder.removeprefix(self.root + '/')}/{n}", "rows": decode[n].rows, "bytes": decode[n].bytes} for n in sorted(names) if n in decode]

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("_arrival", T.StringType())])

    def _escaped(self, value: str) -> str:
        return self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

    def tier(self, shard: dict) -> int:
        """0 below the base size; one more for each factor of FAN_IN above it."""
        return 0 if shard["bytes"] < self.base_bytes else 1 + int(math.log(shard["bytes"] / self.base_bytes, FAN_IN))

    def plan(self, manifest: dict) -> list[dict] | None:
        """The runs to merge next: the lowest tier with FAN_IN or more below the target size, its smallest ones first."""
        tiers: dict[int, list[dict]] = {}
        for s in manifest["shards"]:
            if s["bytes"] < self.target_bytes:
                tiers.setdefault(self.tier(s), []).append(s)
        for _, runs in sorted(tiers.items()):
            if len(runs) >= FAN_IN:
                runs = sorted(runs, key=lambda s: (s["bytes"], s["id"]))
                return runs if self.tier(runs[0]) == 0 else runs[:FAN_IN]
        return None

    def compact(self, keep: int = 4) -> dict:
        """Merge until no tier is full; each merge is committed by itself, and shards that no one of ``keep`` versions names go.

        Readers of an older version than these may find its files gone: ``keep``
        has to cover the versions made while the longest read runs.
        """
        now = self.manifest()
        while runs := self.plan(now):
            rows, octets = sum(s["rows"] for s in runs), sum(s["bytes"] for s in runs)
            files = max(1, math.ceil(octets / self.target_bytes))
            name = f"data/{uuid.uuid4().hex}"
            self.read_shards(runs).coalesce(files).write.parquet(f"{self.root}/{name}")
            try:
                now = self.commit(now, [s["id"] for s in runs], [{"id": name, "rows": rows, "bytes": octets}])
            except Conflict:
                self.store.delete(self._path(name), True)
                raise
            self.vacuum(keep)
        return now

    def vacuum(self, keep: int = 4) -> None:
        """Remove shards that only versions older than the last ``keep`` name, and those versions."""
        versions = self.versions()
        live = {s["id"] for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        for v in versions[:-keep]:
            for s in self.manifest(v)["shards"]:
                if s["id"] not in live:
                    self.store.delete(self._path(s["id"]), True)
            self.store.delete(self._path(f"manifest/{v:08d}.json"), False)

    def read_shards(self, shards: list[dict]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{s['id']}" for s in shards))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last by default."""
        return self.read_shards(self.manifest(version)["shards"])
