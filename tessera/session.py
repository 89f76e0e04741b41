"""Session helpers: a local session for tests/bench and a shared scratch folder.

Library code never creates its own session; it takes the caller's. The only
path it writes to on its own is below ``spark.checkpoint.dir`` (the shared
folder the cluster names), which is read from the session. A local default is
set only when the setting is missing and the master is local.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tessera") -> SparkSession:
    """Session used by tests and bench: AQE on, UI off, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoints that no plan refers to any more are deleted
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a local one only when unset on a local master."""
    path = spark.conf.get(_CKPT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if path:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_CKPT_KEY} must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tessera-ckpt-")
    spark.conf.set(_CKPT_KEY, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder written below the shared one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Rounds:
    """Tables of an iteration: each is written and read back, and one that the next made needless is
    dropped by the caller. Unlike checkpoints they are columnar, and gone when dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "round")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, df: DataFrame) -> None:
        _, path = self.paths.pop(id(df))
        drop_path(self.spark, path)


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Hash-partition a bare file scan by ``key`` when its files give fewer
    tasks than the session has cores (a table stored as one row group).

    ``scan`` must be a scan, optionally filtered or projected: its task count
    is known from the file listing, so nothing runs here. Larger inputs already
    scan in many tasks and do not move. The rows are the same either way."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n, key)


def ship_by_value(module_name: str) -> None:
    """Have PySpark pickle the functions of ``module_name`` by value, so the
    Python workers that run them (pandas functions) need not import this
    package from their own path."""
    import sys

    from pyspark import cloudpickle
    try:
        cloudpickle.register_pickle_by_value(sys.modules[module_name])
    except (ValueError, KeyError):
        pass
