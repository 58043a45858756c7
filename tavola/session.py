"""Session helpers.

Library code never creates a session; it takes the caller's.  ``local_session``
is for tests, the benchmark and local runs only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tavola") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TAVOLA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, local_fallback=True)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, local_fallback: bool = False) -> str | None:
    """Return the checkpoint directory the cluster names.

    Reads ``spark.checkpoint.dir`` from the session.  A local scratch folder is
    only created when ``local_fallback`` is set (tests, local benchmark) and
    nothing is configured.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if local_fallback and spark.conf.get("spark.master", sc.master).startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tavola-ckpt-", dir="/tmp"))
        return sc.getCheckpointDir()
    return None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once for the rest of the plan.

    With a checkpoint folder configured (``spark.checkpoint.dir``, the shared
    folder of the cluster) this is a reliable checkpoint: the lineage is cut,
    so a lost executor re-reads the checkpoint instead of replaying upstream
    joins and iterations.  Without one, the data is persisted (memory and
    disk) and the lineage is kept, which is still correct after executor loss.
    """
    spark = df.sparkSession
    if ensure_checkpoint_dir(spark) is None:
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        out.count()
        return out
    df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def materialize_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Later queries then scan parquet: filters are pushed into the scan and only
    the columns a query needs are read.  Without a configured folder the
    DataFrame is persisted instead.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    if base is None:
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        out.count()
        return out
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
