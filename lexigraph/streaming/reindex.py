"""Re-indexing as revisions arrive.

The revision log is the stream. Each micro-batch is a burst of writes that is
indexed once; the trigger's interval is the debounce, and Structured Streaming
runs one batch at a time and picks up what arrived meanwhile in the next.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import TABLES


def revision_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(TABLES["note_revisions"])
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.parquet(path)


def latest_writes(batch: DataFrame) -> DataFrame:
    """Of a burst's writes to one note the last one."""
    row = F.struct(*[c for c in batch.columns if c != "note_id"])
    return batch.groupBy("note_id").agg(F.max_by(row, "rev").alias("r")).select("note_id", "r.*")


def start(stream: DataFrame, checkpoint: str, index: Callable[[DataFrame, int], None], export: Callable[[DataFrame, int], None] | None = None, interval: str | None = "30 seconds") -> StreamingQuery:
    """Calls index, then export, with each burst's latest writes. Batches are
    numbered: an index that stores the number with its output can skip one that
    comes again after a failure."""

    def each(batch: DataFrame, number: int) -> None:
        writes = latest_writes(batch).persist()
        try:
            if not writes.isEmpty():
                index(writes, number)
                if export is not None:
                    export(writes, number)
        finally:
            writes.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def write_bursts(revisions: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of an author's writes with no gap between them, and how many notes
    each wrote: exactly, on a stream too (which knows no distinct counts, so the
    burst's notes are a set; a burst is bounded by its gaps). On a stream those
    later than the watermark are dropped by Structured Streaming."""
    timed = revisions.withWatermark("created_at", late) if revisions.isStreaming else revisions
    notes = F.size(F.collect_set("note_id")).cast("long") if revisions.isStreaming else F.count_distinct("note_id")
    return timed.groupBy("author", F.session_window("created_at", gap).alias("s")).agg(F.count(F.lit(1)).alias("writes"), notes.alias("notes")).select("author", F.col("s.start").alias("began"), F.col("s.end").alias("ended"), "writes", "notes")


def stream_bursts(revisions: DataFrame, out: str, checkpoint: str, gap: str = "10 minutes", late: str = "1 hour", interval: str | None = None) -> StreamingQuery:
    """write_bursts of a stream, appended to Parquet as they close: a burst is final
    once the watermark (the latest time seen less late) is past its end. A write
    whose own burst would end before the watermark is dropped and counted by the
    query's progress. The file sink commits each batch once, whatever is retried."""
    writer = write_bursts(revisions, gap, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class Pool:
    """Tables of the projects used last, kept in memory while their data's
    fingerprint stays, and until nobody has used them for idle seconds."""

    def __init__(self, size: int = 4, idle: float = 900, clock: Callable[[], float] = time.monotonic):
        self.size, self.idle, self.clock, self._held = size, idle, clock, {}

    def get(self, name: str, mark: str, make: Callable[[], DataFrame]) -> DataFrame:
        held = self._held.pop(name, None)
        if held is None or held[0] != mark:
            if held is not None:
                held[1].unpersist()
            held = (mark, make().persist())
        self._held[name] = (*held[:2], self.clock())
        while len(self._held) > self.size:
            self._held.pop(next(iter(self._held)))[1].unpersist()
        return held[1]

    def evict_idle(self) -> list[str]:
        """Lets go what was not used for a while; its names."""
        due = [n for n, held in self._held.items() if self.clock() - held[2] >= self.idle]
        for n in due:
            self.release(n)
        return due

    def release(self, name: str) -> None:
        held = self._held.pop(name, None)
        if held is not None:
            held[1].unpersist()
