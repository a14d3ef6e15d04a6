"""Intermediate tables in the folder that driver and executors share, safe against lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a session in one process (tests) has a temporary folder; on a
    cluster that is an error, as no other node would see its files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = getattr(shared_dir, "own", None)
        if own is None:
            own = shared_dir.own = tempfile.mkdtemp(prefix="juriloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
    return path.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_juriloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="juriloom-code-")) / "juriloom-code.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    context._juriloom_shipped = True


_paths: dict[int, tuple[DataFrame, str]] = {}  # what written() made and nothing has released, with its place


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder: lineage is cut, and nothing is computed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/juriloom-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = table, path
    return table


def made() -> list[DataFrame]:
    """The tables of written() that nothing has released."""
    return [table for table, _ in _paths.values()]


def release(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for table in tables:
        _, path = _paths.pop(id(table), (None, None))
        if path:
            _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def delete_tables(spark: SparkSession) -> None:
    """Remove all that written() has left in the shared folder; results that read these tables are gone with them."""
    _paths.clear()
    _delete(spark, f"{shared_dir(spark)}/juriloom-tables")
