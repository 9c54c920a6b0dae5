"""The append log as a stream sink: each micro-batch adds only keys that the log lacks.

A batch that is run again after a failure adds nothing twice, so delivery is once per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from qaloom.sources.records import exists


def append_new(batch: DataFrame, path: str, key: Sequence[str]) -> None:
    """Add the batch's rows whose keys are new; of a key's rows in one batch any one."""
    new = batch.dropDuplicates(list(key))
    if exists(batch.sparkSession, path):
        new = new.join(batch.sparkSession.read.parquet(path).select(*key), list(key), "left_anti")
    new.write.mode("append").parquet(path)


def start(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str]) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
