"""What the operators share: Arrow batch bounds, joins of skewed keys, sums over partitions and small helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import delete_tables, release, ship, written  # noqa: F401  the operators take them from here

# Rows an Arrow batch may hold; texts are long, so far fewer than Spark's 10,000.
ARROW_ROWS = 512
# Bytes that a batch may hold.
ARROW_BYTES = 16 << 20
# White space of the word rules: space and \x09-\x0D.
SPACE = "[\\x20\\x09-\\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep the Arrow batches handed to Python small, in rows and in bytes, as their rows are whole texts: the session's
    limits are lowered where they are higher. And see to it that workers have the code."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key, "64m").lower()
    if not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def hub_join(rows: DataFrame, key: str, side: DataFrame, count: int, how: str = "inner", least: int = 128) -> DataFrame:
    """rows joined (inner or left) with side, whose rows are few for each value of key. Values that more than max(least, count / 50,000) of
    the count rows share are dealt to several tasks, and their row of side with them; at most 50,000 such values are broadcast."""
    limit = max(least, count // 50_000)
    hubs = F.broadcast(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(hubs, key, "left").withColumn("__part", F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), parts).cast("int")).drop("__parts")
    copied = side.join(hubs, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt.join(copied, [key, "__part"], how).drop("__part")


def text_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text under fixed names, so that no other column can clash; null text is empty text."""
    return df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))


def same_dtype(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into ones whose buffers hold about size bytes at most (single rows may hold more)."""
    for batch in batches:
        rows = batch.num_rows
        if rows:
            step = max(1, min(rows, rows * size // max(1, batch.nbytes)))
            for at in range(0, rows, step):
                yield batch.slice(at, step)


def grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Join batches into ones of about size bytes (single batches may hold more)."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if held and total + batch.nbytes > size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
        held.append(batch)
        total += batch.nbytes
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def give_back() -> None:
    """At the end of a task whose caches are gone: free memory returns to the system, as Python workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def rare_gc() -> None:
    """Caches of many small tuples make Python's cycle collector walk them again and again; let it run seldom."""
    gc.set_threshold(200_000, 50, 1000)


def one_thread() -> None:
    """Tokenizer libraries otherwise start as many threads as the machine has CPUs in every Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def tree_sum(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], kind: type = np.float64) -> np.ndarray:
    """The sum of the vectors that partial() makes of each partition. Vectors are added in rounds on the executors, so that
    the driver receives one however many partitions there are; they are compressed on the way."""
    pack = lambda v: pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.ascontiguousarray(v, kind).tobytes(), 1)], pa.binary())], ["v"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(pack, partial(batches))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                v = np.frombuffer(zlib.decompress(x), kind)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pack(total)

    sums = df.mapInArrow(first, "v binary")
    parts = max(1, df.rdd.getNumPartitions())
    while parts > 1:
        parts = -(-parts // 16)
        sums = sums.repartition(parts).mapInArrow(add, "v binary")
    return np.sum([np.frombuffer(zlib.decompress(r["v"]), kind) for r in sums.collect()], axis=0)
