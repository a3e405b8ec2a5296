"""Session settings and the few helpers that touch the session."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings worth having on a cluster; none of them changes a result.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("gridquill")
    settings = RECOMMENDED | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A temporary folder of our own is used only in local mode, where the setting
    is absent and no checkpoint folder has been set, as in tests; on a cluster
    that is an error, since executors would not share it.  Checkpoints that this
    package starts are deleted when the application ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured is None:
        present = context._jsc.sc().getCheckpointDir()
        if not present.isDefined() and not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = present.get() if present.isDefined() else tempfile.mkdtemp(prefix="gridquill-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(configured)
        _delete_at_end(spark, context._jsc.sc().getCheckpointDir().get())
    return configured


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/gridquill-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    _delete_at_end(spark, folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application; Python workers import it.

    In local mode they share the driver's path already.
    """
    context = spark.sparkContext
    if _is_local(spark) or getattr(context, "_gridquill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gridquill-")) / "gridquill.zip"  # read by the driver's own file server
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._gridquill_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df``, written to the shared folder so that later stages can be retried from it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """``df``, for a Python map, with enough partitions to keep every core busy.

    Few large row groups leave most cores idle in CPU-bound Python maps; only
    then are the rows moved (round robin, so no key can make it uneven).
    """
    ship(df.sparkSession)
    wanted = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
