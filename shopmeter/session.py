"""Session settings and the durable cut of a lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Everything here is a runtime re-planning switch: partition counts and join
# strategies come from measured sizes, not from constants tuned on a laptop.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Files of a durable cut go when nothing refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Recording a Python call site for every column expression slows planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "shopmeter",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the engine's settings.

    On a cluster leave ``master`` unset and give ``shuffle_partitions`` high
    (thousands): adaptive execution merges the small ones after the shuffle.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data, which driver and executors share.

    It is the one named in ``spark.checkpoint.dir``; where that is unset, as in a test,
    a folder beside the session's warehouse, which is shared as well.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(folder or f"{warehouse.rstrip('/')}/checkpoints")
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and cuts that no DataFrame refers to any more.

    Its cleaner only learns of them when the driver collects garbage, which a driver with
    memory to spare may not do in a whole job: long jobs call this between their steps.
    """
    spark.sparkContext._jvm.System.gc()
