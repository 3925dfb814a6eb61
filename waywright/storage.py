"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset a temporary one, but only in a single process, as in tests."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='waywright-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that Python workers can import it."""
    context = spark.sparkContext
    if not getattr(context, "_waywright_sent", False):
        target = Path(tempfile.mkdtemp(prefix="waywright-")) / f"{PACKAGE.name}-routes.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for path in sorted(PACKAGE.rglob("*.py")):
                archive.write(path, path.relative_to(PACKAGE.parent))
        context.addPyFile(str(target))
        context._waywright_sent = True


def stored(df: DataFrame, name: str = "round", by: str | None = None) -> DataFrame:
    """df written to the shared folder, in a folder for each value of by, and read back: its lineage ends there, and lost executors
    lose nothing.

    The folder is deleted by dropped(), or when the driver's Python ends."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    owned(spark, path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.stored_path = path
    return out


_paths: dict[str, SparkSession] = {}


def owned(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver's Python ends, if it is still there."""
    if not _paths:
        atexit.register(_at_end)
    _paths[path] = spark


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _paths.pop(path, None)


def _at_end() -> None:
    for path, spark in list(_paths.items()):
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended before
            return


def dropped(*frames: DataFrame | None) -> None:
    """Delete the files of stored frames that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "stored_path", None):
            _delete(df.sparkSession, path)
