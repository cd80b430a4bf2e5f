"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster that is an error, as executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextlib.contextmanager
def measured_broadcasts(spark: SparkSession):
    """What is planned within is broadcast where a side has been measured (after its shuffle) or a hint asks for it, not by the size of files.

    Files of few distinct values hold a hundred times their size in rows, so an estimate from them sends tables through the driver that do not fit it.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    least, measured = spark.conf.get(static), spark.conf.get(adaptive, None)
    spark.conf.set(adaptive, measured or least)
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        spark.conf.set(static, least)
        if measured:
            spark.conf.set(adaptive, measured)
        else:
            spark.conf.unset(adaptive)


def written(df: DataFrame, name: str) -> str:
    """Write to a new place in the shared folder, which is returned."""
    path = f"{new_folder(df.sparkSession)}/helixloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, survives the loss of executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def stored_by_size(df: DataFrame, name: str) -> DataFrame:
    """As stored, with measured broadcasts on the way: for joins of tables whose files say little of their size."""
    with measured_broadcasts(df.sparkSession):
        return stored(df, name)


class Log:
    """A stored table that grows by the rows of each round.

    A round writes what it adds and nothing else. Whenever eight tables of one size have come together they are written as one, so rows are written again
    as often as the number of rounds has digits in base eight, and a read opens few files however many rounds there were.
    """

    MERGE = 8

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema, self.name = first.sparkSession, first.schema, name
        self.levels: list[list[str]] = [[self._write(first)]]

    def _write(self, df: DataFrame) -> str:
        with measured_broadcasts(self.spark):
            return written(df, self.name)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rows(self) -> DataFrame:
        return self._read([p for level in self.levels for p in level])

    def add(self, df: DataFrame) -> None:
        self.levels[0].append(self._write(df))
        for k, level in enumerate(self.levels):
            if len(level) < self.MERGE:
                break
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(self._read(level)))
            self.levels[k] = []
