"""Session helpers.

Library code never builds its own cluster session; it takes the one it is
given.  ``local_session`` exists for tests, the bench and the examples.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIPPED: set[str] = set()
_SCRATCH: dict[str, SparkSession] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "strata") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("STRATA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    On a cluster this is ``spark.checkpoint.dir`` (a shared file system).  Only
    when the session names none (local tests) a fresh temporary folder is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: checkpoints and intermediate "
                               "tables must survive the loss of any one machine")
        configured = tempfile.mkdtemp(prefix="strata-ckpt-")  # local sessions (tests) only
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder, for written tables."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/strata-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH[path] = spark
    return path


def drop_scratch(path: str | None = None) -> None:
    """Delete one scratch table, or all that this process has written.

    Frames that still read a dropped table can no longer be computed.  All are
    dropped when the process ends; a long-lived session calls this between
    requests.
    """
    for p in [path] if path else list(_SCRATCH):
        spark = _SCRATCH.pop(p, None)
        if spark is None or spark.sparkContext._jsc is None:
            continue
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(p)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_at_exit() -> None:
    try:
        drop_scratch()
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def ship_package(spark: SparkSession) -> None:
    """Let Python workers on other machines import this package (once per application)."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="strata-code-"), "strata.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def num_partitions(spark: SparkSession) -> int:
    """Partition count for explicit range partitioning (cluster setting)."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in equal parts, two for every core, and read back: for rows that many costly passes read.

    Adaptive execution deals rows out by their bytes, while passes that fit many models take long over few bytes; and a
    checkpoint reads every row back as a Java object, a table reads columns.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    untyped = {f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    parts = 2 * max(1, spark.sparkContext.defaultParallelism)
    df.withColumns(untyped).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)
