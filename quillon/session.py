"""Session helpers that respect whatever the cluster has already configured."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLON_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or what the session was told since.

    Only a local session may do without: it gets a folder of its own. On a cluster a machine's own folder would lose what is written, so that none is made.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-checkpoint-"))
    return sc.getCheckpointDir().rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a table comes in fewer pieces than there are cores; a table of more pieces isn't shuffled.

    For small files before a heavy step: a Parquet file isn't read by more tasks than it has row groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


PART_ROWS = 1 << 20


def by_key(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows by their keys in partitions of about PART_ROWS of `rows` rows (those of the table), so that what a task sorts or aggregates doesn't grow with the table.

    Adaptive execution merges partitions by their compressed bytes, of which narrow rows take few; these stay as they are.
    """
    n = -(-(df.count() if rows is None else rows) // PART_ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir of the session; only where none is set (local sessions), make one."""
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one query, as Parquet in the shared folder: made once, read by column, lost with no executor.

    The shuffle files of a step go as soon as its table is written, and a table goes when it is dropped. What a lazily
    returned result still reads stays under quillon-<application id> of the shared folder until the application's owner removes it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/quillon-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, name: str) -> str:
        """Writes the rows and gives the path."""
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return path

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, read from a written table."""
        path = self.write(df, name)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                self.remove(path)

    def remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
