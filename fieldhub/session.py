"""Session helpers: a sensible local session and durable lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldhub")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the one the cluster names in spark.checkpoint.dir, or
    else the one given to SparkContext.setCheckpointDir.

    Only a local session (tests, laptops) may name none; it gets a temporary folder, which
    is recorded in the session and removed when the process ends.  A cluster's executors
    could not see such a folder, so there the lack of a shared one is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("fieldhub.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fieldhub-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("fieldhub.checkpoint.dir", root)
    return root.rstrip("/")


def small_table(spark: SparkSession, rows: list[tuple], schema: dict[str, str]) -> DataFrame:
    """A handful of parameter rows as a local relation (no job, no Python worker)."""

    def cell(value, kind: str) -> str:
        if isinstance(value, str):
            value = "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        elif isinstance(value, float):
            value = f"{value!r}D"
        return f"CAST({value} AS {kind})"

    kinds = list(schema.values())
    text = ", ".join("(" + ", ".join(map(cell, row, kinds)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(schema)})")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all cores by their keys, for work that a file of one split would leave to one task."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)


_MADE: list[str] = []  # folders of this process, for drop_scratch


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every table that lineage cuts of this process have left.

    Results that read them must be written or collected before.
    """
    while _MADE:
        _remove(spark, _MADE.pop())


class Scratch:
    """Tables written to the checkpoint folder to cut the lineage of iterative jobs.

    A written table is computed once, is read back columnar, and survives the loss of
    executors.  ``keep`` generations stay readable; older ones are dropped as the loop
    moves on, so a loop of any length holds a bounded amount of storage.
    """

    def __init__(self, spark: SparkSession, label: str, keep: int = 2):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        _MADE.append(self.base)
        self.keep = keep
        self.generation = 0

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/g{self.generation}"
        df.write.mode("overwrite").parquet(path)
        if self.generation >= self.keep:
            self._drop(f"{self.base}/g{self.generation - self.keep}")
        self.generation += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def stored(self) -> bool:
        """Whether the latest generation is still there."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/g{self.generation - 1}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _drop(self, path: str) -> None:
        _remove(self.spark, path)
