"""Session helpers: a local session for tests, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL = 50_000  # rows of a table that stays in the files it has
MOST = 500_000  # rows of a task in a dealt table


def local_session(cores: int | str = 8, app: str = "panelspark", shuffle: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; a cluster without a
    shared folder is an error, because a machine-local one dies with its machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def new_shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder, for a table other jobs will read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the checkpoint folder once; later jobs read the columns they need."""
    path = new_shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A written table in even parts for every core, for fits that scan it many times.

    The files of a join are few and uneven, and each pass of a fit would wait for the longest.
    """
    rows = df.count()
    if rows <= SMALL:
        return df
    return materialize(df.repartition(even_parts(df.sparkSession, rows), *keys))


def even_parts(spark: SparkSession, rows: int) -> int:
    """Parts of at most about MOST rows, as many for every core; scans of a table in so many files read each alone.

    Spark puts files together until a task has its core's share of the bytes or 128 MB, which are millions of rows of
    flags. A lower limit on a scan's parts keeps them apart; it is only ever raised, and only beyond one part a core.
    """
    cores = spark.sparkContext.defaultParallelism
    parts = cores * -(-rows // (MOST * cores))
    name = "spark.sql.files.minPartitionNum"
    if parts > int(spark.conf.get(name, None) or cores):
        spark.conf.set(name, parts)
    return parts
