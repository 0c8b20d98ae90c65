"""The fluent query: an immutable chain of steps that compiles to a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from weir.functions.aggregates import Aggregation, Merging, distinct
from weir.functions.mappers import Mapper
from weir.functions.predicates import Predicate, resolve
from weir.operators import panes, sessions
from weir.operators.countwin import count_windows, free
from weir.operators.windows import CountWindow, Window
from weir.plans import adaptive
from weir.plans.config import Config
from weir.plans.schema import Schema
from weir.sources.readers import InputType, read
from weir.streaming.listener import INPUT


@dataclass(frozen=True)
class Step:
    kind: str
    args: tuple = ()

    def __str__(self) -> str:
        parts = [x for a in self.args for x in (a if isinstance(a, tuple) else (a,))]
        return f"{self.kind}({', '.join(map(str, parts))})"


@dataclass(frozen=True)
class Query:
    """Build with :meth:`generate` (a declared source) or :meth:`over` (a DataFrame).

    ``group_by`` and ``window`` wait for the next ``aggregate``.  Every method
    returns a new query, and names resolve against the columns at that point,
    so a filter after ``aggregate`` acts on its results.
    """

    config: Config = field(default_factory=Config)
    schema: Schema | None = None
    path: str | None = None
    input_type: InputType = InputType.BinaryFile
    frame: DataFrame | None = None
    streaming: bool = False
    options: tuple = ()
    steps: tuple[Step, ...] = ()

    @staticmethod
    def generate(config: Config, schema: Schema, path: str, input_type: InputType = InputType.BinaryFile) -> Query:
        return Query(config.with_source_file(path), schema, path, input_type)

    @staticmethod
    def over(frame: DataFrame, config: Config | None = None) -> Query:
        return Query(config or Config(), frame=frame, streaming=frame.isStreaming)

    def input(self, input_type: InputType, path: str | None = None, streaming: bool = False, **options) -> Query:
        return replace(self, input_type=input_type, path=path or self.path, streaming=streaming, options=tuple(options.items()), frame=None)

    def _then(self, kind: str, *args) -> Query:
        return replace(self, steps=(*self.steps, Step(kind, args)))

    def filter(self, predicate: Predicate) -> Query:
        return self._then("filter", predicate)

    def select(self, *names) -> Query:
        flat = [n for x in names for n in (x if isinstance(x, list | tuple) else [x])]
        return self._then("select", *flat)

    def map(self, mapper: Mapper) -> Query:
        return self._then("map", mapper)

    def group_by(self, *fields: str, max_value: int | None = None) -> Query:
        """``max_value`` is a hint on the key range; Spark's aggregation needs none."""
        return self._then("group_by", *fields)

    def key_by(self, *fields: str) -> Query:
        """As ``group_by``; a count window then counts the rows of each key."""
        return self._then("key_by", *fields)

    def window(self, window: Window | CountWindow) -> Query:
        return self._then("window", window)

    def aggregate(self, *aggregations: Aggregation, include_bounds: bool = True) -> Query:
        return self._then("aggregate", aggregations, include_bounds)

    def late_rows(self) -> Query:
        """Of a stream, after ``window``: the rows that come when their window has been let go, with its ``window_start``."""
        return self._then("late")

    def print(self) -> Query:
        return self._then("print")

    def write(self, path: str) -> Query:
        return self._then("write", path)

    def to_output_buffer(self, name: str = "output") -> Query:
        return self._then("buffer", name)

    groupBy, keyBy, toOutputBuffer, lateRows = group_by, key_by, to_output_buffer, late_rows

    def source(self, spark: SparkSession) -> DataFrame:
        if self.frame is not None:
            return self.frame
        return read(spark, self.input_type, self.path, self.schema, self.streaming, self.config, dict(self.options), self.used())

    def used(self) -> list[str] | None:
        """The source's fields that the steps use; None if that is all of them, or not known."""
        found: set[str] = set()
        for step in self.steps:
            if step.kind in ("select", "group_by", "key_by"):
                found.update(step.args)
            elif step.kind == "filter":
                found.update(step.args[0].fields())
            elif step.kind == "map":
                found.update(step.args[0].fields())
            elif step.kind == "window":
                found.update(n for n in (getattr(step.args[0], "on", None), getattr(step.args[0], "order_by", None)) if n)
            elif step.kind == "aggregate":
                own = [a.field for a in step.args[0] if type(a).__module__ == Aggregation.__module__]
                if not own or len(own) < len(step.args[0]):
                    return None  # an aggregation of the user's may read any field
                return sorted(found | {f for f in own if f})
            if step.kind == "select":
                return sorted(found)
        return None

    def to_df(self, spark: SparkSession, output_mode: str = "append", counted: bool = False) -> DataFrame:
        """The plan without its sinks, for a stream's output mode; ``counted``: input rows are reported with its progress."""
        df, keys, per_key, window, run = self.source(spark), [], False, None, []
        if counted:
            df = df.observe(INPUT, F.count(F.lit(1)).alias("rows"))
        scanned = True  # what an aggregation gives is not run just to measure filters on it
        for step in [*self.steps, Step("end")]:
            if step.kind == "filter":
                run.append(step.args[0])
                continue
            if run:
                df, run = adaptive.filtered(df, run, self.config, scanned), []
            if step.kind == "select":
                df = df.select(*(resolve(df, n) for n in step.args))
            elif step.kind == "map":
                df = step.args[0].transform(df)
            elif step.kind in ("group_by", "key_by"):
                keys, per_key = list(step.args), step.kind == "key_by"
                for k in keys:
                    resolve(df, k)
            elif step.kind == "window":
                window = step.args[0]
            elif step.kind == "late":
                from weir.streaming import firing

                if not df.isStreaming or not isinstance(window, Window) or window.session:
                    raise ValueError("late rows are those of a stream's tumbling or sliding window")
                timed, time, _ = window.prepare(df)
                df, keys, window = firing.too_late(timed, df.columns, time, window, keys), [], None
            elif step.kind == "aggregate":
                df = _aggregated(df, keys, per_key, window, *step.args, output_mode, self.config.distribution_opt)
                keys, per_key, window, scanned = [], False, None, False
        return df

    def execute(self, spark: SparkSession, **options):
        """Run into the sinks; without one, the batch rows are collected.

        A stream returns its started ``StreamingQuery``, or ``Streams`` for
        several sinks; see ``writers.run`` and ``writers.start`` for options.
        """
        from weir.sinks import writers

        with self.config.applied(spark):
            df = self.to_df(spark, options.get("output_mode", "append"), bool(options.get("throughput_log")))
            sinks = [s for s in self.steps if s.kind in ("print", "write", "buffer")] or [Step("collect")]
            if df.isStreaming:
                window = next((s.args[0] for s in reversed(self.steps) if s.kind == "window"), None)
                every = window.stream_trigger() if isinstance(window, Window) else None
                return writers.start(df, sinks, every, duration=self.config.benchmark_run_duration, **options)
            return writers.run(df, sinks, **options)

    def print_query_plan(self) -> str:
        from weir.plans.explain import query_plan

        return query_plan(self)

    def print_pipeline_permutations(self) -> str:
        from weir.plans.explain import permutations

        return permutations(self)

    printQueryPlan, printPipelinePermutations = print_query_plan, print_pipeline_permutations

    def explain(self, spark: SparkSession, mode: str = "formatted") -> None:
        self.to_df(spark).explain(mode)


def _aggregated(df: DataFrame, keys, per_key: bool, window, aggregations, include_bounds: bool, output_mode: str, distribution_opt: bool) -> DataFrame:
    outputs = lambda d: distinct([c for a in aggregations for c in a.columns(d)])
    if window is None:
        return df.groupBy(*keys).agg(*outputs(df))
    if isinstance(window, CountWindow):
        if df.isStreaming:
            from weir.streaming.countwin import stream_count_aggregates

            out = stream_count_aggregates(df, window.size, keys if per_key else [], [] if per_key else keys, aggregations)
            return out if include_bounds else out.drop("window_index")
        if window.order_by is None:
            raise ValueError("a count window over finite data needs an order: on=<field>")
        if "window_index" in keys:
            raise ValueError("a count window's rows get window_index: rename the key of that name")
        (index,) = free(df, "window_index")
        rows = count_windows(df, window.size, window.order_by, keys if per_key else [], index)
        out = rows.groupBy(*keys, index).agg(*outputs(rows)).withColumnRenamed(index, "window_index")
        return out if include_bounds else out.drop("window_index")
    df, time, bucket = window.prepare(df)
    if window.refires():
        from weir.streaming import firing

        if not df.isStreaming or window.session or window.lateness.seconds_:
            raise ValueError("a tumbling or sliding window of a stream fires again; it needs no lateness beside the allowed one")
        out = firing.fired(df, time, window, keys, aggregations)
        return out if include_bounds else out.drop("window_start", "window_end")
    (span,) = free(df, "window")
    cut = window.session and not df.isStreaming and (distribution_opt or not keys)
    merging = Merging.of(df, aggregations) if cut or window.ratio() >= panes.LEAST_RATIO else None
    if cut and merging:
        gap = window.size.interval()
        hot = sessions.hot_hashes(df, keys, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if keys else []
        out = None if keys and not hot else sessions.sliced(df.filter(sessions.is_hot(keys, hot)) if keys else df, time, keys, gap, merging, span)
        if keys:
            cold = df.filter(~sessions.is_hot(keys, hot)).groupBy(*keys, bucket.alias(span)).agg(*outputs(df))
            out = cold if out is None else out.unionByName(cold)
    elif merging and not df.isStreaming:
        out = panes.slid(df, time, keys, window.size.seconds_, window.slide.seconds_, window.offset.seconds_, merging, span)
    elif merging and output_mode == "append":
        out = panes.slid_stream(df, time, keys, window.size.interval(), window.slide.interval(), window.offset.interval(), merging, span)
    else:
        out = df.groupBy(*keys, bucket.alias(span)).agg(*outputs(df))
    bounds = [F.col(span)["start"].alias("window_start"), F.col(span)["end"].alias("window_end")]
    rest = [c for c in out.columns if c not in (*keys, span)]
    return out.select(*keys, *(bounds if include_bounds else []), *rest)
