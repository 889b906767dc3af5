"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(app: str, cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(scan: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Give a scan with fewer splits than there are cores one split per core.

    For work that is much heavier than reading: a single small file would keep it on
    one core. A table with enough splits, that is any large one, is left alone. Only
    for plain scans, whose number of splits is known without running anything.

    With ``rows`` the table is counted and dealt out so that a task has about as many: a
    scan's splits may be many and still leave all rows to the few that hold a row group.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if rows:
        return scan.repartition(max(cores, -(-scan.count() // rows)), *keys)
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


@cache
def _process_folder() -> str:
    """Temporary folder of a local session, removed when the process ends."""
    root = tempfile.mkdtemp(prefix="flowlens-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: it gets a temporary folder
    that lives as long as the process. A cluster without it is an error, because
    a machine-local folder would not be seen by the other executors.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    return _process_folder()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark)}/flowlens/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts the lineage, so that a lost executor re-reads files instead of repeating
    the work, and lets several later passes prune columns of one stored result.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(stored: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once nothing reads it any more."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored.scratch)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
