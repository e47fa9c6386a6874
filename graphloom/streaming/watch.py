"""Change events to rebuilds: debounced by session, one rebuild at a time, state by path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues

from graphloom.functions.paths import language
from graphloom.functions.ship import ship
from graphloom.operators.analysis import latest_by
from graphloom.sources import facts


def debounced(events: DataFrame, gap: str = "120 milliseconds", late: str = "1 second") -> DataFrame:
    """Sessions of a stream of (ts, root, path): one row per burst, when no event can join it any more."""
    wanted = events.filter(language(F.col("path")).isNotNull() & ~F.col("path").rlike(r"(^|/)\.(git|graphloom)(/|$)"))
    burst = wanted.withWatermark("ts", late).groupBy("root", F.session_window("ts", gap).alias("burst")).agg(F.count("*").alias("changes"), F.max("ts").alias("last"))
    return burst.select("root", "changes", F.col("burst.start").alias("first"), "last")


def rebuild_on_change(events: DataFrame, rebuild: Callable[[str], None], checkpoint: str, gap: str = "120 milliseconds", trigger: dict | None = None) -> StreamingQuery:
    """Call ``rebuild`` once for each root with bursts in a batch. Batches don't overlap, and what comes meanwhile is the next one."""

    def batch(frame: DataFrame, _: int) -> None:
        for row in frame.select("root").distinct().orderBy("root").collect():  # as many rows as repositories
            rebuild(row["root"])

    return debounced(events, gap).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


CHANGE = "path string, change string, seq long, content binary, content_hash string"


class Changed(StatefulProcessor):
    """The last hash of each path; what comes with the same hash again is no change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hash = handle.getValueState("hash", "content_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = None  # of several events in a batch the last counts
        for frame in rows:
            for row in frame[["seq", "content", "content_hash"]].itertuples(index=False):
                if last is None or row.seq >= last.seq:
                    last = row
        known = self.hash.get()[0] if self.hash.exists() else None
        now = last.content_hash if isinstance(last.content_hash, str) else None
        if now == known:
            return
        if now is None:
            self.hash.clear()
        else:
            self.hash.update((now,))
        change = "removed" if now is None else "added" if known is None else "changed"
        yield pd.DataFrame({"path": [key[0]], "change": [change], "seq": [last.seq], "content": [last.content if now is not None else None], "content_hash": [now]})

    def close(self) -> None:
        pass


def changes(events: DataFrame) -> DataFrame:
    """(path, change, seq, content, content_hash) of a stream of (path, seq, content): added, changed or removed (null content).

    State is a hash a path. Of a path's events in one batch that with the
    highest seq counts; one whose content is what it was gives nothing. The
    session must use the RocksDB state store.
    """
    ship(events.sparkSession)
    hashed = events.select("path", F.col("seq").cast("long").alias("seq"), "content", F.when(F.col("content").isNotNull(), F.sha2("content", 256)).alias("content_hash"))
    return hashed.groupBy("path").transformWithStateInPandas(Changed(), CHANGE, "Update", "None")


def record_changes(events: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Extract what changes and append it to a table in ``folder``, a part for each batch; a batch that is run again writes the same part."""

    def batch(frame: DataFrame, number: int) -> None:
        found = facts.extract(frame.filter("change != 'removed'").select("path", language(F.col("path")).alias("language"), "content", "content_hash"))
        told = frame.select("path", "seq", "change").join(found, "path", "left")
        told.write.mode("overwrite").parquet(f"{folder}/batch={number:012}")

    return changes(events).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def current_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all paths that are there, as a build from scratch would extract them."""
    last = latest_by(spark.read.option("basePath", folder).parquet(f"{folder}/batch=*"), ["path"], [F.col("batch").desc()])
    return last.filter("change != 'removed'").drop("seq", "change", "batch")
