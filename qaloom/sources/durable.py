"""Tables written to the shared folder of ``spark.checkpoint.dir``: they cut lineage and outlive executors."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
from collections.abc import Iterable
from itertools import batched

from pyspark.sql import DataFrame, SparkSession


FILE_ROWS = 1_000_000  # of a table whose rows are counted beforehand


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="qaloom-"))
    return sc.getCheckpointDir().rstrip("/")


class Tables:
    """Intermediate tables of one run; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``df`` written and read again.  ``rows``, about how many there are, keeps small tables from being many tiny files."""
        if rows is not None:
            df = df.coalesce(max(self.spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
        path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def of_rows(self, rows: Iterable[dict], schema: str) -> DataFrame:
        """Rows that the driver made, as a table of JSON lines: the plan of a query holds its path, not the rows."""
        path = f"{shared_dir(self.spark)}/table-{uuid.uuid4().hex}.json"
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
        for part in batched(rows, 10_000):
            out.write(bytearray("".join(json.dumps(r) + "\n" for r in part).encode()))
        out.close()
        made = self.spark.read.schema(schema).json(path)
        self.paths[id(made)] = (made, path)
        return made

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if found := self.paths.pop(id(df), None):
                jvm = self.spark.sparkContext._jvm
                path = jvm.org.apache.hadoop.fs.Path(found[1])
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all(self) -> None:
        self.drop(*[df for df, _ in self.paths.values()])


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have run and are no longer held: it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Let the executors' JVMs return heap that earlier stages made them grow to.

    An executor's Python workers live beside its JVM in one container, and a heap shrinks in a full
    collection only.  One short task for each executor, which idle ones share out evenly; results
    never depend on it.
    """
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is one of them
    spark.range(0, executors, 1, executors).selectExpr("java_method('java.lang.System', 'gc') AS done").where("done is not null").count()
