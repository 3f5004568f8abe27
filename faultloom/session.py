"""Session defaults and the shared folder for materialised tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffled bytes that one task reads.
TASK_BYTES = "8m"
#: Measured bytes up to which a side of a join is broadcast; its hash table takes a multiple.
BROADCAST_BYTES = "1m"
#: The same where only the size of its files is known.
FILE_BYTES = "256k"


def build_session(app: str = "faultloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return measured(builder.getOrCreate())


def measured(spark: SparkSession) -> SparkSession:
    """Settings for tables of any size, on any session.

    A side of a join is broadcast by the bytes it is measured to have after its
    shuffle; by file sizes only where these are far smaller, as a compressed
    file holds many times its size, and such guesses would pass through the driver.
    A task after a shuffle reads a few MB, as its sorts and hash tables hold a
    multiple of them each.
    """
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    if conf.get("spark.sql.adaptive.enabled") != "true":
        return spark
    if conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1":
        conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST_BYTES)
        conf.set("spark.sql.autoBroadcastJoinThreshold", FILE_BYTES)
    conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without ``spark.checkpoint.dir`` gets a temporary
    folder; on a cluster that would be a folder one machine sees.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="faultloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """A fresh sub-folder of the shared folder for one run."""
    return f"{shared_folder(spark)}/faultloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = run_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages survive the loss of executors and
    see fixed rows in fixed partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
