"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Largest table sent to every task, by the size it was found to have.
BROADCAST_LIMIT = "10MB"


def broadcast_by_measured_size(spark: SparkSession) -> None:
    """Let joins broadcast a side only by its size at run time, never by a guess from file sizes.

    Compressed files, exploded rows and dropped columns make that guess too small by any factor, and
    what is broadcast passes through the driver. Explicit broadcasts (one-row aggregates) stay.
    """
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST_LIMIT)


def build_session(master: str | None = None, app: str = "cellgraph", shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Session with the settings the operators rely on (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    broadcast_by_measured_size(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; make a private one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: iterative operators cut lineage there")
        configured = tempfile.mkdtemp(prefix="spark-cellgraph-")
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from the written table.

    Survives executor loss, and the next plan sees the table's true size: a checkpointed RDD
    keeps the size guess of the plan before it, which multiplies from join to join in a loop.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Spool:
    """Rounds of an iteration appended to one written table in the checkpoint folder.

    Reading it back is a single scan, however many rounds there were.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{ensure_checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"
        self.rounds, self.schema = 0, None

    def append(self, df: DataFrame) -> DataFrame:
        part = f"{self.path}/round={self.rounds}"
        self.schema = self.schema or df.schema
        df.write.parquet(part)
        self.rounds += 1
        return self.spark.read.schema(self.schema).parquet(part)

    def read(self) -> DataFrame:
        paths = [f"{self.path}/round={i}" for i in range(self.rounds)]
        return self.spark.read.schema(self.schema).parquet(*paths)
