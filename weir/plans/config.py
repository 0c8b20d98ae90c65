"""Run settings, and the Spark settings they turn into."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Config:
    """Immutable settings; each ``with_*`` returns a changed copy.

    ``Query.execute`` runs under :meth:`applied`: ``parallelism`` is the number
    of shuffle partitions, ``buffer_size`` the rows of a batch handed to
    Python.  ``run_length`` is files of a micro-batch, ``benchmark_run_duration``
    seconds after which a stream is stopped (None: it ends by itself or runs on).
    ``filter_opt``, ``pipeline_permutation`` and ``sample_rows`` order filters.
    ``distribution_opt`` looks for keys with very many rows, in a pass of its
    own, and forms their sessions slice by slice; it is off unless asked for.
    ``numa``, ``output_buffer`` and ``compilation_delay`` are accepted and have
    no effect: placement, result buffering and compilation belong to Spark.
    """

    parallelism: int | None = None
    buffer_size: int | None = None
    run_length: int = 1
    pipeline_permutation: int = 0
    benchmark_run_duration: float | None = None
    numa: bool = False
    filter_opt: bool = True
    distribution_opt: bool = False
    compilation_delay: int = 4_000
    output_buffer: int = 0
    source_file: str | None = None
    sample_rows: int = 1_000

    @staticmethod
    def create() -> Config:
        return Config()

    def with_parallelism(self, n: int) -> Config:
        return replace(self, parallelism=n)

    def with_buffer_size(self, n: int) -> Config:
        return replace(self, buffer_size=n)

    def with_run_length(self, n: int) -> Config:
        return replace(self, run_length=n)

    def with_pipeline_permutation(self, k: int) -> Config:
        return replace(self, pipeline_permutation=k)

    def with_benchmark_run_duration(self, seconds: float | None) -> Config:
        return replace(self, benchmark_run_duration=seconds)

    def with_numa(self, on: bool) -> Config:
        return replace(self, numa=on)

    def with_filter_opt(self, on: bool) -> Config:
        return replace(self, filter_opt=on)

    def with_distribution_opt(self, on: bool) -> Config:
        return replace(self, distribution_opt=on)

    def with_compilation_delay(self, ms: int) -> Config:
        return replace(self, compilation_delay=ms)

    def with_output_buffer(self, n: int) -> Config:
        return replace(self, output_buffer=n)

    def with_sample_rows(self, n: int) -> Config:
        return replace(self, sample_rows=n)

    def with_source_file(self, path: str) -> Config:
        return replace(self, source_file=path)

    withParallelism = with_parallelism
    withBufferSize = with_buffer_size
    withRunLength = with_run_length
    withPipelinePermutation = with_pipeline_permutation
    withBenchmarkRunDuration = with_benchmark_run_duration
    withNuma = with_numa
    withFilterOpt = with_filter_opt
    withDistributionOpt = with_distribution_opt
    withCompilationDelay = with_compilation_delay
    withOutputBuffer = with_output_buffer
    setSourceFile = with_source_file

    def spark_conf(self) -> dict[str, str]:
        conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": self.buffer_size, "spark.sql.shuffle.partitions": self.parallelism}
        return {k: str(v) for k, v in conf.items() if v}

    @contextmanager
    def applied(self, spark: SparkSession) -> Iterator[None]:
        """These settings for what is run, or started, inside; a stream keeps those that it was started with."""
        before = {k: spark.conf.get(k, None) for k in self.spark_conf()}
        for k, v in self.spark_conf().items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
