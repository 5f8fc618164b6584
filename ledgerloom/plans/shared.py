"""The shared folder of the cluster: where lineage is cut and staged tables are written."""

import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_staged: dict[tuple, str] = {}
REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# For large staged tables: their texts take about two thirds of the room that they take by default.
SMALL_FILES = {"compression": "zstd"}


def runs_in_tasks(module: str) -> None:
    """Send the functions of a module along with the tasks that call them, so workers need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. A session on one machine may leave it unset and gets a folder of its own;
    on a cluster that would scatter the parts over the executors' disks, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors, unlike a local one."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def removing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside the block lets go of its shuffle files when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(REMOVES_SHUFFLES, None)
    spark.conf.set(REMOVES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(REMOVES_SHUFFLES) if before is None else spark.conf.set(REMOVES_SHUFFLES, before)


def over_all_cores(scan: DataFrame) -> DataFrame:
    """A scan that yields fewer partitions than there are cores (a small file) spread over all of them.

    Large inputs have more splits than cores and stay where they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def staged(df: DataFrame, label: str, key: str | None = None, options: dict | None = None) -> DataFrame:
    """Write `df` once as a Parquet table in the shared folder, with the writer's `options`, and read it back.

    With `key`, later calls of the same application reuse the table already written for that key.
    """
    spark = df.sparkSession
    ready = already_staged(spark, label, key) if key else None
    if ready is not None:
        return ready
    path = new_folder(spark, label)
    with removing_shuffles(spark):
        df.write.options(**options or {}).parquet(path)
    if key:
        _staged[(spark.sparkContext.applicationId, label, key)] = path
    return spark.read.parquet(path)


def already_staged(spark: SparkSession, label: str, key: str) -> DataFrame | None:
    """The table staged under a key, unless there is none or its folder has been cleared since."""
    path = _staged.get((spark.sparkContext.applicationId, label, key))
    try:
        return spark.read.parquet(path) if path else None
    except AnalysisException:
        return None
