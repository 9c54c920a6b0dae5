"""Event-time windows over streams of answers, and a sink that adds each micro-batch once.

Rows may arrive late by ``delay``: the watermark follows the latest time seen, less the delay.  A
window is given out once, when the watermark has passed its end, and rows that come for it later are
left out; state is held for open windows only, however long the stream runs.  Counts are combined
map-side, so a producer with most of the rows moves one row for each task and window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from qaloom.sources.snapshots import SnapshotTable

ERROR = "coalesce(error, '') <> ''"


def totals() -> list[Column]:
    """What status and spending reports need of each group: all answers, errors, cost of both."""
    return [F.count("*").alias("n"), F.count_if(F.expr(ERROR)).alias("errors"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent")]


def _ends(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return rows.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *values)


def _named(aggregates: Sequence[Column], grouped: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in grouped.columns if c not in (*keys, "window")]


def by_window(answers: DataFrame, width: str, slide: str | None = None, delay: str = "0 seconds", time: str = "ts", keys: Sequence[str] = ("producer",), aggregates: Sequence[Column] | None = None) -> DataFrame:
    """(keys, start, end, aggregates) of tumbling windows, or of sliding ones; of a table or a stream."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = answers.withWatermark(time, delay).groupBy(*keys, window.alias("window")).agg(*(aggregates or totals()))
    return _ends(grouped, keys, _named(aggregates or (), grouped, keys))


def by_session(answers: DataFrame, gap: str | Column, delay: str = "0 seconds", time: str = "ts", keys: Sequence[str] = ("producer",), aggregates: Sequence[Column] | None = None) -> DataFrame:
    """(keys, start, end, aggregates) of sessions: rows with less than ``gap`` between neighbours; end is a gap after the last."""
    grouped = answers.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("window")).agg(*(aggregates or totals()))
    return _ends(grouped, keys, _named(aggregates or (), grouped, keys))


def into_table(rows: DataFrame, table: SnapshotTable, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run the stream over all that is there now; each batch is one commit, and one that is run again adds nothing."""

    def add(batch: DataFrame, n: int) -> None:
        if SnapshotTable(batch.sparkSession, table.path).append(batch, (name, n)) is None:
            batch.write.format("noop").mode("append").save()  # its state is still to be committed

    table.create(rows.schema)
    return rows.writeStream.queryName(name).outputMode(mode).foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def on_disk(spark: SparkSession) -> None:
    """State in RocksDB, beyond the heap, with changelogs in the checkpoint: for state of any size."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
