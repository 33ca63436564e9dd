"""Structured Streaming: the verification plan on a stream, and windowed counts of verdicts.

The plan is within a row, so a stream runs the very functions of the batch.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lookups import HISTORY, summary_counts, summary_flags
from ..plans.verify import SOURCE, verify
from ..sources.kb import KnowledgeBase


def label_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Label sources as they arrive, as Parquet files, in a folder."""
    return spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def verify_stream(labels: DataFrame, kb: KnowledgeBase | None = None) -> DataFrame:
    return verify(labels, kb)


def verdict_counts(verdicts: DataFrame, at: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """(window, label, n) over (at, label), for events no later than `late`."""
    return verdicts.withWatermark(at, late).groupBy(F.window(at, every), "label").agg(F.count("*").alias("n"))


def summaries(reports: DataFrame, out: str, checkpoint: str):
    """A summary after every micro-batch, appended as Parquet; a batch that runs again writes its own folder again."""
    def write(batch: DataFrame, number: int) -> None:
        summary_counts(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    flags = summary_flags(reports.withColumn("ok", F.lit(True)))  # before the sink, as in running_summary
    return flags.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _place(x) -> tuple:
    """Where a value stands in Spark's order: null, numbers and texts, not a number."""
    return (0,) if x is None else (2,) if x != x else (1, x)


class Ring(StatefulProcessor):
    """A key's newest rows as a list state: `most` of (at, tie), the rows of a batch merged into them. Rows that repeat count each, null times are oldest."""

    def __init__(self, key: str, at: str, tie: str, kinds: dict[str, str], most: int, ttl_ms: int | None):
        self.key, self.at, self.tie, self.kinds, self.most, self.ttl_ms = key, at, tie, kinds, most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", f"`{self.at}` {self.kinds[self.at]}, `{self.tie}` {self.kinds[self.tie]}", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for r in rows:
            held.append((r[self.at], r[self.tie]))
            if len(held) > 50 * self.most:
                held = self._newest(held)
        held = self._newest(held)
        self.rows.put(held)
        for place, (at, tie) in enumerate(held, 1):
            yield Row(**{self.key: key[0], "place": place, self.at: at, self.tie: tie})

    def _newest(self, held: list[tuple]) -> list[tuple]:
        return sorted(held, key=lambda x: (_place(x[0]), _place(x[1])), reverse=True)[: self.most]

    def close(self) -> None:
        pass


class Latest(StatefulProcessor):
    """A key's last request as a value state: of a batch the newest row comes out, if no newer one has been seen; the others are stale."""

    def __init__(self, key: str, request: str, columns: list[str]):
        self.key, self.request, self.columns = key, request, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "request long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        best = None
        for r in rows:
            if r[self.request] is not None and (best is None or r[self.request] > best[self.request]):
                best = r
        if best is not None and (not self.last.exists() or best[self.request] > self.last.get()[0]):
            self.last.update((best[self.request],))
            yield Row(**{c: best[c] for c in self.columns})

    def close(self) -> None:
        pass


_STORE = "spark.sql.streaming.stateStore.providerClass"


def _stateful(rows: DataFrame) -> None:
    """List and value states need the RocksDB store; a session that has chosen none gets it.

    The processors travel whole, not by their module's name: the worker that reads their state's schema on the driver does
    not see shipped files, only its working folder and PYTHONPATH.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    conf = rows.sparkSession.conf
    if "RocksDB" not in conf.get(_STORE, ""):
        conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _kinds(rows: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in rows.schema.fields}


def ring(rows: DataFrame, key: str, at: str, tie: str, most: int = HISTORY, ttl_ms: int | None = None) -> DataFrame:
    """(key, place, at, tie) after each micro-batch: the newest `most` rows of every key that the batch touched, newest first.

    The state of a key is these rows and no more, so it stays bounded however long the stream runs; with ttl_ms a key's rows
    go so long after they came. It equals operators.lookups.newest over all rows so far.
    """
    _stateful(rows)
    kinds = _kinds(rows)
    out = f"`{key}` {kinds[key]}, place int, `{at}` {kinds[at]}, `{tie}` {kinds[tie]}"
    return rows.select(key, at, tie).groupBy(key).transformWithState(Ring(key, at, tie, kinds, most, ttl_ms), out, "Update", "None" if ttl_ms is None else "ProcessingTime")


def latest(rows: DataFrame, key: str, request: str) -> DataFrame:
    """The rows of a stream that are not stale when their micro-batch comes: of each key the one of the greatest request id, if that is greater than all before.

    Rows of null request id are stale; of equal ones the first that is met comes out.
    """
    _stateful(rows)
    kinds = _kinds(rows)
    own = rows.withColumn(request, F.col(request).cast("long"))
    out = ", ".join(f"`{c}` {'bigint' if c == request else kinds[c]}" for c in rows.columns)
    return own.groupBy(key).transformWithState(Latest(key, request, rows.columns), out, "Update", "None")


def keep(rows: DataFrame, out: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Every micro-batch's rows in a folder of its own, batch=N; one that runs again is written again. It takes what is there and ends."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_COUNTS = ("total", "ok", "failed", "inconsistent", "high_risk", "low_confidence")


def running_summary(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A queue of (ok, error, report columns): a summary of everything so far after each micro-batch, and what failed apart.

    `out`/total/batch=N holds the totals up to batch N: those of the batch before with the batch's own added, so a batch that
    runs again after a failure changes nothing. `out`/failed/batch=N holds the failed rows' label_id and error; a row that
    fails does not stop the others.

    A sink gets its batch as rows that are made anew, whole, for each job over them, whatever the job takes from them. So only
    what is counted and kept reaches it, and these few bytes a row are held for its two jobs.
    """
    spark = results.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            own = summary_counts(batch).select(*_COUNTS)
            if number:
                own = own.unionByName(spark.read.parquet(f"{out}/total/batch={number - 1}").select(*_COUNTS)).agg(*(F.sum(c).alias(c) for c in _COUNTS))
            share = F.when(F.col("ok") > 0, F.floor(F.col("inconsistent") * 100 / F.col("ok") + 0.5)).otherwise(F.lit(0)).cast("long")
            own.withColumn("inconsistent_pct", share).write.mode("overwrite").parquet(f"{out}/total/batch={number}")
            batch.where("NOT ok").select("label_id", "error").write.mode("overwrite").parquet(f"{out}/failed/batch={number}")
        finally:
            batch.unpersist()

    return summary_flags(results, "label_id", "error").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Tells a callback (event, query name, rows of the micro-batch) of a session's streams; what the callback raises is ignored, so it cannot stop a stream."""

    def __init__(self, tell: Callable[[str, str | None, int], None]):
        self.tell = tell

    def _say(self, event: str, name: str | None, rows: int = 0) -> None:
        try:
            self.tell(event, name, rows)
        except Exception:  # noqa: BLE001
            pass

    def onQueryStarted(self, event):  # noqa: N802
        self._say("started", event.name)

    def onQueryProgress(self, event):  # noqa: N802
        self._say("progress", event.progress.name, event.progress.numInputRows)

    def onQueryIdle(self, event):  # noqa: N802
        self._say("idle", None)

    def onQueryTerminated(self, event):  # noqa: N802
        self._say("ended" if event.exception is None else "failed", None)


def stop(query: StreamingQuery, wait: float = 60.0) -> bool:
    """Stop a stream and wait for its end; whether it has ended. What it has committed stays, and it can start again from its checkpoint."""
    query.stop()
    return bool(query.awaitTermination(wait))
