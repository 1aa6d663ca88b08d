"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_KEPT: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a frame that is read more than once (e.g. fitted on, then
    transformed) - memory first, spilling to disk; lost blocks are recomputed
    from lineage.  Released by ``release_intermediates``."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _KEPT.append(kept)
    return kept


def release_intermediates() -> int:
    """Unpersist every frame kept so far (call once the results that depend on
    them have been written).  Returns how many were released."""
    n = len(_KEPT)
    while _KEPT:
        _KEPT.pop().unpersist(blocking=False)
    return n


def get_spark(app: str = "revisit", cores: str | int = "*",
              shuffle_partitions: int | None = None,
              driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the bench.

    On a cluster the session comes from the platform; nothing in the library
    depends on the settings here except ``spark.sql.session.timeZone`` (all
    timestamps are zone-free, so it only matters for literal parsing).
    """
    parts = shuffle_partitions or (int(cores) if str(cores).isdigit() else os.cpu_count() or 8)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def one_machine(master: str) -> bool:
    """Whether the driver runs the tasks itself (``local`` or ``local[...]``)."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Where it is absent a local session (one machine: tests, the bench) gets a
    fresh scratch folder; on a cluster that raises, since executors would each
    write to their own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not one_machine(sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="revisit-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str, schema: StructType | None = None) -> DataFrame:
    """Write a frame as Parquet into the shared checkpoint folder and read it
    back: lineage ends at files that every executor sees.  ``schema`` reads the
    same columns as other types of equal storage (an ML vector from its
    struct)."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
