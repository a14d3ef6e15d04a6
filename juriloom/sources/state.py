"""The state of documents as versioned tables: written whole, then made current by one rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
RECORD = (
    "id string, source string, source_label string, title string, category string, published_date string, source_url string, "
    "filename string, extension string, absolute_path string, relative_path string, requires_review boolean, present boolean, "
    "status string, page_count int, character_count long, size_bytes long, mtime_ns long, sha256 string, extracted_path string, "
    "extracted_sha256 string, metadata_hash string, superseded_note string, duplicate_of string, error string"
)


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD)


def _system(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version: that of the newest mark of this format's version."""
    files, root = _system(spark, path)
    if not files.exists(root):
        return None
    names = sorted(f.getPath().getName() for f in files.listStatus(root) if f.getPath().getName().startswith(f"current-{VERSION}-"))
    return names[-1].split("-", 2)[2] if names else None


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The current records; none where there is no state, one of another version, or one that cannot be read."""
    name = _current(spark, path)
    files, table = _system(spark, f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}") if name and files.exists(table) else empty_state(spark)


def save_state(records: DataFrame, path: str, keep: int = 2) -> None:
    """Write all records beside the current ones and make them current by the mark that follows; readers see one version or the
    other, never parts. Versions before the last keep ones go."""
    spark = records.sparkSession
    before = _current(spark, path)
    number = int(before.split("-")[0]) + 1 if before else 1
    name = f"{number:012d}-{uuid.uuid4().hex}"
    records.write.parquet(f"{path}/{name}")
    files, mark = _system(spark, f"{path}/current-{VERSION}-{name}")
    _, waiting = _system(spark, f"{path}/.mark-{name}")
    files.create(waiting).close()
    if not files.rename(waiting, mark):
        raise OSError(f"{mark} could not be made current")
    names = sorted({f.getPath().getName() for f in files.listStatus(_system(spark, path)[1])})
    tables = [n for n in names if n[:12].isdigit()]
    for old in tables[:-keep]:
        for gone in (f"current-{VERSION}-{old}", old):
            files.delete(_system(spark, f"{path}/{gone}")[1], True)
