"""Tables and checkpoints in the folder that driver and executors share.

The cluster names that folder in ``spark.checkpoint.dir``. Only where the setting is missing and all
of Spark runs in one process, as in tests, a temporary folder takes its place.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables; sets a local one only for a local master that names none."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="factlake-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table read back.

    Cuts the lineage: a lost executor costs a re-read, not a re-computation. The files go by
    ``discard``, or when the application's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``written`` returned and no later plan reads."""
    files, target = _file_system(table.sparkSession, table._written_to)
    files.delete(target, True)
    files.cancelDeleteOnExit(target)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over enough tasks for work that costs much a row, such as parsing.

    A small Parquet file comes in one partition, however many rows it has and however much is made of
    each. The tasks are a few for each core, so that all are busy to the end, and more where each would
    get above 20,000 rows. The rows are counted, so ``df`` should be cheap to read.
    """
    rows = df.count()
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, rows // 20_000)
    return df.repartition(min(tasks, rows // 32 + 1), *keys)


class Growing:
    """A table in the shared folder that rounds of a loop add to; it is read by one scan, however many rounds there are."""

    def __init__(self, name: str):
        self.name = name
        self._batches: list[DataFrame] = []

    def add(self, rows: DataFrame) -> DataFrame:
        """Write more rows, and return them read back."""
        if self._batches:
            rows = rows.select(*self._batches[0].columns)
        self._batches.append(written(rows, self.name))
        return self._batches[-1]

    def table(self) -> DataFrame:
        """All rows that have been added so far."""
        first = self._batches[0]
        return first.sparkSession.read.schema(first.schema).parquet(*(b._written_to for b in self._batches))
