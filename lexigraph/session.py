"""Session helpers shared by all operators: tables, lineage cuts, sized joins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder; columns and filters are pushed into its scan."""
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_unions(spark: SparkSession) -> None:
    """Let unions promise no partitioning: where adaptive execution changes the partitions of one arm, Spark 4.1 fails to zip them."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def drop_shuffles(spark: SparkSession) -> None:
    """Let the frames made from here on drop their shuffle files when an action on them ends, not when the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``. There is no fallback: a folder of one machine would lose data with it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared checkpoint folder, so that a lost executor loses nothing."""
    plain_unions(df.sparkSession)
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bare(checkpointed: DataFrame) -> DataFrame:
    """The rows of a checkpoint without what its plan knew of their order and partitioning.

    In a loop of joins the equal orders that every checkpoint hands on double with each round, until planning takes
    longer than the work.
    """
    spark = checkpointed.sparkSession
    rows = checkpointed._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, checkpointed._jdf.schema(), False), spark)


#: A side of a join is broadcast only when it has been counted and has at most so many rows.
BROADCAST_ROWS = 100_000


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``right`` broadcast only if it was counted to be small.

    ``right`` should be cheap to count (a checkpoint or a bare scan). Beyond ``max_rows`` the join is a
    shuffled one, where adaptive execution splits skewed keys of ``left``.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        right = F.broadcast(right)
    return left.join(right, on, how)


def default_parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_session(cpus: str | int = "*", app: str = "lexigraph") -> SparkSession:
    """A local session with the settings used in tests and in the bench; on one machine a temporary folder is shared by all."""
    import tempfile

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("LEXIGRAPH_SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEXIGRAPH_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="lexigraph-checkpoint-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
