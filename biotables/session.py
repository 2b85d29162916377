"""Session settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Joins on a key that holds a large part of all rows are split at run time.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_CLEANED: set[str] = set()
_SENT: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    send_package(spark)
    return spark


def send_package(spark: SparkSession) -> None:
    """Give the executors this package, unless it is installed or on the PYTHONPATH that they inherit.

    Functions of the package reach Python workers by name, so every worker has to import it.
    """
    package = Path(__file__).resolve().parent
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    context = spark.sparkContext
    if "site-packages" in package.parts or str(package.parent) in known or context.applicationId in _SENT:
        return
    _SENT.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="biotables-code-")) / "biotables.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session without the setting (unit tests) gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="biotables-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def run_dir(spark: SparkSession) -> str:
    """One folder per application under the shared one; it goes when the driver's Python ends."""
    folder = f"{shared_dir(spark)}/biotables-{spark.sparkContext.applicationId}"
    if folder not in _CLEANED:
        _CLEANED.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    if context._jsc is None:  # stopped before: only a local folder can still be reached
        if folder.startswith(("/", "file:")):
            shutil.rmtree(folder.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs; a lost executor re-reads files instead of
    replaying every earlier round.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession, wanted: int | None = None) -> int:
    """Tasks for CPU-heavy work: ``wanted``, at most the shuffle width of the session.

    Such work is small in bytes, so the adaptive merge of small partitions must not apply.
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(width, spark.sparkContext.defaultParallelism)
    return most if wanted is None else max(1, min(int(wanted), most))
