"""What a Spark session needs before it runs this package's Python code, and tables in the folder that executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_strandweave_shipped", False):
        return
    top = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="strandweave-"), "strandweave.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(archive)
    sc._strandweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a local master, as in tests, may go without that setting; it then
    gets a temporary folder, which driver and executors share by being one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="strandweave-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _folder(spark: SparkSession) -> str:
    """This application's folder below the shared one; it goes when the interpreter ends."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark).rstrip('/')}/strandweave-{sc.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session can delete nothing
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files behind df go once it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before) if before is not None else spark.conf.unset(_DROP_SHUFFLES)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandweave_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no later result reads."""
    for t in tables:
        _delete(t.sparkSession, t._strandweave_path)
