"""State of iterative algorithms: kept in memory or on executors' disks for a few rounds, then as a table in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

EVERY = 5  # rounds between tables: a lost executor costs so many rounds of its partitions at most


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where it is unset and the driver and its executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vertexloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str = "round") -> DataFrame:
    """Writes df to the shared folder and reads it back: the plan stays short and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Holds the tables of an iteration; every `EVERY`th is settled, which frees those before it."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []
        self.rounds = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed once by whatever reads it first."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def turn(self, df: DataFrame) -> DataFrame:
        """df as the state after a round."""
        self.rounds += 1
        return self.keep(df) if self.rounds % EVERY else self.end(df)

    def end(self, df: DataFrame) -> DataFrame:
        """df as a table; nothing held before is needed for it."""
        out = settle(df)
        self.free()
        return out

    def free(self) -> None:
        for old in self.held:
            old.unpersist()
        self.held.clear()
