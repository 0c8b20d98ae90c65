"""Sinks: text lines on the console, delimited files, and memory."""

from __future__ import annotations

import hashlib
from threading import Timer

from pyspark.sql import Column, DataFrame, functions as F

from weir.plans.shared import new_path
from weir.streaming.listener import ThroughputListener


def line(df: DataFrame, sep: str, head: str) -> Column:
    """``key<head>v<sep>v<sep>``: the first column, then each of the others."""
    first, *rest = df.columns
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if not rest:
        return F.concat(text(first), F.lit(head)).alias("value")
    return F.concat(text(first), F.lit(head), F.concat_ws(sep, *map(text, rest)), F.lit(sep)).alias("value")


def run(df: DataFrame, sinks, print_limit: int | None = None):
    """Feed every sink; without one, the rows are returned.

    ``print`` writes lines on the driver, a partition at a time, at most
    ``print_limit`` of them if that is given.  A buffer is a table in the
    shared folder, run once and kept, under a temporary view.
    """
    result = None
    for sink in sinks:
        if sink.kind == "print":
            lines = df.select(line(df, "|", ":"))
            for row in (lines if print_limit is None else lines.limit(print_limit)).toLocalIterator():
                print(row.value)
        elif sink.kind == "write":
            df.write.mode("append").option("sep", ";").csv(sink.args[0])
        elif sink.kind == "buffer":
            path = new_path(df.sparkSession, "buffer")
            df.write.parquet(path)
            df.sparkSession.read.schema(df.schema).parquet(path).createOrReplaceTempView(sink.args[0])
        else:
            result = df.collect()
    return result


class Streams(list):
    """The streaming queries of several sinks, waited for and stopped together."""

    def awaitTermination(self, timeout: int | None = None) -> bool | None:  # noqa: N802
        done = [q.awaitTermination(timeout) if timeout is not None else q.awaitTermination() for q in self]
        return all(done) if timeout is not None else None

    def processAllAvailable(self) -> None:  # noqa: N802
        for q in self:
            q.processAllAvailable()

    def stop(self) -> None:
        for q in self:
            q.stop()


def start(df: DataFrame, sinks, every: str | None, checkpoint: str | None = None, available_now: bool | None = None, output_mode: str = "append", throughput_log=None, duration: float | None = None):
    """Start a streaming query for each sink; one is returned as it is, several as :class:`Streams`.

    ``every`` is the window's trigger.  Without it, or if ``available_now`` is
    asked for, what there is is read and the query ends.  Delimited files with
    a ``checkpoint`` hold every row of every batch once, restarts included: in
    append mode by the log of Spark's file sink, in other modes as each batch
    has a folder of its own (``run=.../batch=n``, so these are columns when
    read) that a batch run again replaces.  Each of several
    sinks has its own folder in ``checkpoint``, and reads the source itself.
    ``throughput_log`` is a file on the driver, or a function that is given the
    rows and the seconds of each batch; ``duration``: seconds until all stop.
    """
    listener = None
    if throughput_log:
        listener = ThroughputListener(df.sparkSession, **({"keep": throughput_log} if callable(throughput_log) else {"path": throughput_log}))
        df.sparkSession.streams.addListener(listener)
    apart = len(sinks) > 1
    queries = [_start(df, s, every, f"{checkpoint}/sink-{k}" if checkpoint and apart else checkpoint, available_now, output_mode) for k, s in enumerate(sinks)]
    if listener:
        listener.follow(queries)
    if duration is not None:
        timer = Timer(duration, Streams(queries).stop)
        timer.daemon = True
        timer.start()
    return Streams(queries) if apart else queries[0]


def _start(df: DataFrame, sink, every: str | None, checkpoint: str | None, available_now: bool | None, output_mode: str):
    writer = df.writeStream.outputMode(output_mode)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    if available_now or available_now is None and every is None:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    if sink.kind == "print":
        return writer.format("console").option("truncate", "false").start()
    if sink.kind == "write" and checkpoint and output_mode == "append":
        return writer.format("csv").option("sep", ";").start(sink.args[0])
    if sink.kind == "write" and checkpoint:
        run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
        return writer.foreachBatch(lambda rows, n: rows.write.mode("overwrite").option("sep", ";").csv(f"{sink.args[0]}/run={run}/batch={n}")).start()
    if sink.kind == "write":
        return writer.foreachBatch(lambda rows, _: rows.write.mode("append").option("sep", ";").csv(sink.args[0])).start()
    if sink.kind == "buffer":
        return writer.foreachBatch(_buffer(df, sink.args[0], checkpoint, output_mode)).start()
    return writer.format("memory").queryName("output").start()


def _buffer(df: DataFrame, name: str, checkpoint: str | None, output_mode: str):
    """Keeps a stream's batches in the shared folder (beside its checkpoint, if it has one) under the temporary view ``name``, renewed with each batch; in complete mode the last one."""
    spark, at = df.sparkSession, f"{checkpoint.rstrip('/')}/buffer" if checkpoint else new_path(df.sparkSession, "buffer")

    def show(path: str) -> None:
        spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(path).createOrReplaceTempView(name)

    def keep(rows: DataFrame, n: int) -> None:
        path = f"{at}/batch={n}"
        rows.write.mode("overwrite").parquet(path)
        show(path if output_mode == "complete" else at)

    spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(f"{at}/batch=none")
    show(f"{at}/batch=none" if output_mode == "complete" else at)
    return keep
