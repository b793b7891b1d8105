"""Arrow maps over DataFrames, with this package given to executors that do not have it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Add this package to the session's files, once for a context."""
    context = spark.sparkContext
    if getattr(context, "_clausemill_core_shipped", False):
        return
    context._clausemill_core_shipped = True
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="clausemill-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/clausemill.zip", "w") as out:
        for p in sorted([*top.rglob("*.py"), *top.rglob("*.toml")]):
            out.write(p, str(p.relative_to(top.parent)))
    context.addPyFile(f"{folder}/clausemill.zip")


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


#: An input that gives each core less than this is dealt out evenly before it is scanned.
WAVE_BYTES = 32 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal a small input to all cores: a small file is often one row group, which one task would scan alone.

    By the optimizer's size estimate; inputs of more than a wave of tasks, or of unknown size, stay where they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) <= cores * WAVE_BYTES else df


def shared_root(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, else the context's checkpoint folder, else (local masters, as in tests) a folder removed at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="clausemill-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{root}")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; where that is a local or mounted folder, what is there is removed at exit."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    if path.startswith(("/", "file:")):
        atexit.register(shutil.rmtree, "/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
    return path
