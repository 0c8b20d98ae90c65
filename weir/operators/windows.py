"""Window specifications: time, session and row-count windows with triggers."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from weir.functions.predicates import resolve
from weir.operators.countwin import free


@dataclass(frozen=True)
class Time:
    """A whole number of seconds."""

    seconds_: int

    @staticmethod
    def seconds(n: int) -> Time:
        return Time(n)

    @staticmethod
    def minutes(n: int) -> Time:
        return Time(60 * n)

    @staticmethod
    def of(value: Time | timedelta | int) -> Time:
        if isinstance(value, Time):
            return value
        seconds = value.total_seconds() if isinstance(value, timedelta) else value
        if seconds != int(seconds):
            raise ValueError(f"{value!r} is no whole number of seconds")
        return Time(int(seconds))

    def interval(self) -> str:
        return f"{self.seconds_} seconds"


@dataclass(frozen=True)
class Counter:
    """A number of rows."""

    max: int


@dataclass(frozen=True)
class ProcessingTimeTrigger:
    """Stream results are produced this often."""

    every: Time


@dataclass(frozen=True)
class CountTrigger:
    """A window closes at its n-th row."""

    max: int

    def every(self) -> int:
        return self.max

    def purges(self) -> bool:
        return False


@dataclass(frozen=True)
class PurgingTrigger:
    """State goes once emitted (append mode); what this engine always does."""

    trigger: ProcessingTimeTrigger | CountTrigger

    def every(self) -> int:
        return self.trigger.max

    def purges(self) -> bool:
        return True


@dataclass(frozen=True)
class Window:
    """A window over the rows of a key.

    ``on`` names the time field; without it the wall clock of processing is
    used.  ``lateness`` is the watermark delay of a stream.  A stream's window
    may fire before its end (``early``) and be corrected after it (``allowed``).
    """

    size: Time
    on: str | None = None
    slide: Time | None = None
    session: bool = False
    lateness: Time = Time(0)
    offset: Time = Time(0)
    trigger: ProcessingTimeTrigger | CountTrigger | PurgingTrigger | None = None
    early: CountTrigger | PurgingTrigger | None = None
    allowed: Time = Time(0)

    def with_early_firing(self, trigger: CountTrigger | PurgingTrigger) -> Window:
        """Of a stream: fires at every n-th row of its key, and at its end with what has come since.

        A ``PurgingTrigger`` around it starts anew after each firing; without
        one, each firing has all rows so far.
        """
        if not isinstance(trigger.trigger if isinstance(trigger, PurgingTrigger) else trigger, CountTrigger):
            raise ValueError("a window fires early by a count of rows")
        if trigger.every() < 1:
            raise ValueError("a firing needs at least one row")
        return replace(self, early=trigger)

    def with_allowed_lateness(self, lateness: Time) -> Window:
        """Of a stream: kept so long after its end, and fired again for late rows; ``Query.late_rows`` has those that come later still."""
        return replace(self, allowed=Time.of(lateness))

    def refires(self) -> bool:
        return self.early is not None or self.allowed.seconds_ > 0

    withEarlyFiring, withAllowedLateness = with_early_firing, with_allowed_lateness

    def with_trigger(self, trigger) -> Window | CountWindow:
        inner = trigger.trigger if isinstance(trigger, PurgingTrigger) else trigger
        if isinstance(inner, CountTrigger):
            return CountWindow(inner.max, order_by=self.on)
        return replace(self, trigger=trigger)

    withTrigger = with_trigger

    def stream_trigger(self) -> str | None:
        t = self.trigger.trigger if isinstance(self.trigger, PurgingTrigger) else self.trigger
        return t.every.interval() if isinstance(t, ProcessingTimeTrigger) else None

    def ratio(self) -> int:
        """Windows that a row is in, if the slide divides the size; else 0."""
        if self.slide is None or self.session or self.size.seconds_ % self.slide.seconds_:
            return 0
        return self.size.seconds_ // self.slide.seconds_

    def prepare(self, df: DataFrame) -> tuple[DataFrame, str, Column]:
        """``df`` with its time column ready, that column's name, and the grouping column."""
        (name,) = free(df, "_window_time")
        if self.on is None:
            df = df.withColumn(name, F.current_timestamp())
        else:
            c, kind = resolve(df, self.on), df.schema[self.on].dataType
            if isinstance(kind, T.LongType):
                c = F.timestamp_millis(c)
            elif df.isStreaming and isinstance(kind, T.TimestampNTZType):
                c = c.cast("timestamp")  # a watermark needs an instant
            df = df.withColumn(name, c)
        if df.isStreaming:
            df = df.withWatermark(name, self.lateness.interval())
        if self.session:
            return df, name, F.session_window(name, self.size.interval())
        slide = (self.slide or self.size).interval()
        return df, name, F.window(name, self.size.interval(), slide, self.offset.interval())

    def __str__(self) -> str:
        kind = "session" if self.session else "sliding" if self.slide else "tumbling"
        text = f"{kind} {self.size.interval()}" + (f" every {self.slide.interval()}" if self.slide else "")
        return f"{text} on {self.on or 'processing time'}"


@dataclass(frozen=True)
class CountWindow:
    """Windows of exactly ``size`` rows, in the order of ``order_by``.

    A trailing window that is not full is not returned.  Batch needs a total
    order; a stream counts rows as they arrive.
    """

    size: int
    order_by: str | None = None

    def with_trigger(self, trigger) -> CountWindow:
        inner = trigger.trigger if isinstance(trigger, PurgingTrigger) else trigger
        return replace(self, size=inner.max) if isinstance(inner, CountTrigger) else self

    withTrigger = with_trigger

    def __str__(self) -> str:
        return f"every {self.size} rows by {self.order_by or 'arrival'}"


def _whole(part: Time, of: Time, what: str) -> None:
    if part.seconds_ <= 0 or of.seconds_ % part.seconds_:
        raise ValueError(f"{what} ({of.seconds_} s must be a multiple of {part.seconds_} s)")


def TumblingProcessingTimeWindow(size: Time | Counter, on: str | None = None) -> Window | CountWindow:
    if isinstance(size, Counter):
        return CountWindow(size.max, order_by=on)
    return Window(Time.of(size), on)


def SlidingProcessingTimeWindow(size: Time, slide: Time, on: str | None = None) -> Window:
    size, slide = Time.of(size), Time.of(slide)
    _whole(slide, size, "the size must be a multiple of the slide")
    return Window(size, on, slide)


def SessionProcessingTimeWindow(timeout: Time, on: str | None = None) -> Window:
    return Window(Time.of(timeout), on, session=True)


def TumblingEventTimeWindow(size: Time, on: str, lateness: Time = Time(0)) -> Window:
    size, lateness = Time.of(size), Time.of(lateness)
    _whole(size, lateness, "the lateness must be a multiple of the size")
    return Window(size, on, lateness=lateness)


def SlidingEventTimeWindow(size: Time, slide: Time, on: str, lateness: Time = Time(0)) -> Window:
    size, slide = Time.of(size), Time.of(slide)
    _whole(slide, size, "the size must be a multiple of the slide")
    return Window(size, on, slide, lateness=Time.of(lateness))


def SessionEventTimeWindow(timeout: Time, on: str, lateness: Time = Time(0)) -> Window:
    timeout, lateness = Time.of(timeout), Time.of(lateness)
    if lateness.seconds_ > timeout.seconds_:
        _whole(timeout, lateness, "a lateness above the timeout must be a multiple of it")
    return Window(timeout, on, session=True, lateness=lateness)
