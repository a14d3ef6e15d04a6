"""Embedding near-duplicates (operator 7) by an epsilon grid order join.

Unit vectors are put on their leading principal directions and sorted by the grid cells, epsilon wide, of these
coordinates. Consecutive vectors form sequence intervals with bounding boxes, intervals form longer ones. The join goes
down from pairs of long intervals to pairs of short ones and skips a pair whose boxes lie further apart than epsilon; the
projection never lengthens a distance, so that nothing is lost. What is left is compared in double precision.

Equal vectors are one vector with a weight. Intervals that are near in the sequence form tiles; an interval is sent once to
each pair of tiles in which it has a partner left. A pair of intervals gives back at most one row per vector: how many
vectors it is linked with there, and one vector of its group there. No pairs are emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .runtime import bound_batches, hub_join, release, tree_sum, written

BLOCK = 2048  # vectors of an interval that is moved as one row
LEAF = 128  # vectors below which the recursion compares
FANOUT = 8  # intervals that form the next longer one
TILE = 8  # intervals that are compared with those of another tile in one task
LEADING = 6  # principal directions with grid cells


def _valid(column: str) -> Column:
    x = F.col(column)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return x.isNotNull() & F.forall(x, finite) & F.exists(x, lambda v: v != 0)


def _units(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for i in range(len(column)):
        v = values[offsets[i] : offsets[i + 1]]
        v = v / np.abs(v).max()  # no overflow or underflow of squares
        out[i, : len(v)] = v / math.sqrt(float(v @ v))
    return out


def _pairs_within(a: dict, b: dict, epsilon: float, same: bool) -> Iterator[tuple[slice, slice]]:
    """The pairs of short stretches of two intervals that may hold links."""

    def box(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x.min(0), x.max(0)

    def go(i0: int, i1: int, j0: int, j1: int) -> Iterator[tuple[slice, slice]]:
        if same and j1 <= i0:
            return
        (alo, ahi), (blo, bhi) = box(a["coords"][i0:i1]), box(b["coords"][j0:j1])
        gap = np.maximum(0, np.maximum(alo - bhi, blo - ahi))
        if gap @ gap > epsilon * epsilon or a["sizes"][i0:i1].max() < b["sizes"][j0:j1].min() or b["sizes"][j0:j1].max() < a["sizes"][i0:i1].min():
            return
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            yield slice(i0, i1), slice(j0, j1)
            return
        halves = lambda s, e: [(s, e)] if e - s <= LEAF else [(s, (s + e) // 2), ((s + e) // 2, e)]
        for p in halves(i0, i1):
            for q in halves(j0, j1):
                yield from go(*p, *q)

    yield from go(0, len(a["coords"]), 0, len(b["coords"]))


def _links(a: dict, b: dict, same: bool, threshold: float, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cls, a cls of its group in this pair of intervals, weight of its links here) of the vectors with links."""
    n, m = len(a["cls"]), len(b["cls"])
    linked = np.zeros((n, m), bool)
    for i, j in _pairs_within(a, b, epsilon, same):
        linked[i, j] = (a["units"][i] @ b["units"][j].T >= threshold) & (a["sizes"][i][:, None] == b["sizes"][j][None])
    if same:
        linked |= linked.T  # the recursion leaves out one of two mirrored stretches
        np.fill_diagonal(linked, False)
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    part = linked[np.ix_(rows, cols)]
    x, y = a["cls"][rows].copy(), b["cls"][cols].copy()
    far = np.iinfo(np.int64).max
    while True:
        new_y = np.minimum(y, np.where(part, x[:, None], far).min(0))
        new_x = np.minimum(x, np.where(part, new_y[None, :], far).min(1))
        if (new_x == x).all() and (new_y == y).all():
            break
        x, y = new_x, new_y
    count_x = part.astype(np.float64) @ b["weight"][cols]
    if same:
        return a["cls"][rows], x, count_x.astype(np.int64)
    count_y = part.T.astype(np.float64) @ a["weight"][rows]
    return np.concatenate([a["cls"][rows], b["cls"][cols]]), np.concatenate([x, y]), np.concatenate([count_x, count_y]).astype(np.int64)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept (id = component_id).

    Two vectors are linked if their cosine is at least the threshold. A vector that is null, empty or zero, or holds null
    or non-finite components, is linked with nothing, nor are vectors of unlike length with each other. Each row is a
    vector: equal rows are linked, and rows with one id but unlike vectors are one vertex, whose links join. A row with a null id is
    linked with nothing, has a null component_id and is kept. An empty table gives an empty table; other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    plain = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + 0.0)  # no negative zeros
    source = vectors.select(F.col(id_col).alias("__id"), plain.alias("v"))
    floats = vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>"
    usable = F.col("__id").isNotNull() & _valid("v")
    good = source.filter(usable)
    classes = written(good.groupBy("v").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("weight")).withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    size = classes.agg(F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("n"), F.sum("weight").alias("rows")).first()
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    if not size["n"]:
        return source.select(F.col("__id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("__id").alias("component_id"), F.lit(True).alias("kept"))
    width = size["width"]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros((width + 1, width))
        for b in batches:
            if b.num_rows:
                u = _units(b.column(0), width)
                total[:width] += u.T @ u
                total[width] += u.sum(0)
        yield total.ravel()

    total = tree_sum(classes.select("v"), moments).reshape(width + 1, width)
    mean = total[width] / size["n"]
    leading = np.linalg.eigh(total[:width] / size["n"] - np.outer(mean, mean))[1][:, ::-1][:, : min(LEADING, width)]

    def coordinates(u: np.ndarray) -> np.ndarray:
        """The leading coordinates, and the length of what they leave out."""
        p = u @ leading
        return np.column_stack([p, np.sqrt(np.maximum(0, 1 - (p * p).sum(1)))])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                grid = np.floor(coordinates(_units(b.column(0), width)) / epsilon).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(grid), pa.list_(pa.int32()))], [*b.schema.names, "cell"])

    placed = classes.select("v", "cls", "weight").mapInArrow(cells, "v array<double>, cls bigint, weight bigint, cell array<int>").withColumn("length", F.size("v"))
    parts = max(1, -(-size["n"] // (4 * BLOCK)))
    order = ["length", "cell", "cls"]
    ordered = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            v = t.column(0)
            u = _units(v, width)
            c = coordinates(u)
            sizes = np.diff(v.offsets.to_numpy()).astype(np.int64)
            values = v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[-1].as_py()]
            blobs = [x.tobytes() for x in (t.column(1).to_numpy(), t.column(2).to_numpy(), sizes, values.astype(np.float32) if floats else values)]
            return pa.RecordBatch.from_arrays([pa.array([(pid << 32) + number]), pa.array([len(u)]), pa.array([c.min(0).tolist()], pa.list_(pa.float64())), pa.array([c.max(0).tolist()], pa.list_(pa.float64())), *(pa.array([x], pa.binary()) for x in blobs)], ["block", "n", "lo", "hi", "cls", "weight", "sizes", "vectors"])

        waiting = 0
        for b in batches:
            while b.num_rows:
                take = b.slice(0, BLOCK - waiting)
                held.append(take)
                waiting += take.num_rows
                b = b.slice(take.num_rows)
                if waiting == BLOCK:
                    yield block(held)
                    number, held, waiting = number + 1, [], 0
        if held:
            yield block(held)

    blocks = written(ordered.mapInArrow(intervals, "block bigint, n bigint, lo array<double>, hi array<double>, cls binary, weight binary, sizes binary, vectors binary"), "intervals")
    # Longer intervals over the sequence: the dense number of a block comes from the number of blocks of each partition.
    pid = F.shiftright("block", 32).alias("pid")
    per_part = blocks.select(pid).groupBy("pid").agg(F.count(F.lit(1)).alias("c"))
    earlier = per_part.select("pid", F.coalesce(F.sum("c").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    dense = blocks.select("block", "lo", "hi", pid).join(earlier, "pid").select((F.col("start") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))).alias("k"), "block", "lo", "hi")
    levels = [written(dense, "level")]
    count = levels[0].count()
    dims = len(leading[0]) + 1
    while count > 1:
        up = levels[-1].groupBy(F.floor(F.col("k") / FANOUT).alias("k")).agg(F.array(*(F.min(F.col("lo")[d]) for d in range(dims))).alias("lo"), F.array(*(F.max(F.col("hi")[d]) for d in range(dims))).alias("hi"))
        levels.append(written(up, "level"))
        count = -(-count // FANOUT)
    near = F.lit(0.0)
    for d in range(dims):
        gap = F.greatest(F.lit(0.0), F.col("a.lo")[d] - F.col("b.hi")[d], F.col("b.lo")[d] - F.col("a.hi")[d])
        near = near + gap * gap
    pairs = levels[-1].select(F.col("k").alias("x"), F.col("k").alias("y"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("up", F.floor(F.col("k") / FANOUT))
        pairs = pairs.join(child.alias("a"), F.col("x") == F.col("a.up")).join(child.alias("b"), F.col("y") == F.col("b.up"))
        pairs = pairs.filter((F.col("a.k") <= F.col("b.k")) & (near <= epsilon * epsilon)).select(F.col("a.k").alias("x"), F.col("b.k").alias("y"))
    tile = lambda c: F.floor(F.col(c) / TILE)
    met = pairs.select(tile("x").alias("tx"), tile("y").alias("ty"), "x", "y")
    sent = met.select("tx", "ty", F.col("x").alias("k"), F.col("y").alias("partner")).unionByName(met.select("tx", "ty", F.col("y").alias("k"), F.lit(None).cast("bigint").alias("partner")))
    sent = sent.groupBy("tx", "ty", "k").agg(F.array_sort(F.collect_list("partner")).alias("partners"))  # a tile's intervals at most
    work = sent.join(levels[0].select("k", "block"), "k").join(blocks.select("block", "cls", "weight", "sizes", "vectors"), "block")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for k, cls, weight, sizes, data in zip(frame.k, frame.cls, frame.weight, frame.sizes, frame.vectors, strict=True):
            sizes = np.frombuffer(sizes, np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.frombuffer(data, np.float32 if floats else np.float64).astype(np.float64)
            u = _units(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), width)
            held[k] = {"cls": np.frombuffer(cls, np.int64), "weight": np.frombuffer(weight, np.int64), "sizes": sizes, "units": u, "coords": coordinates(u)}
        found = [_links(held[k], held[p], k == p, threshold, epsilon) for k, partners in zip(frame.k, frame.partners, strict=True) for p in partners]
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pd.DataFrame(dict(zip(["cls", "to", "n"], columns, strict=True)))

    found = written(work.groupBy("tx", "ty").applyInPandas(compare, "cls bigint, to bigint, n bigint"), "vector-links")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    groups = connected(found.select("cls", "to"), "cls", "to").select(F.col("id").alias("cls"), "component")
    placed = written(classes.select("v", "cls", "first", "weight").join(groups, "cls", "left").join(counts, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "placed")
    # An id with several vectors joins their components.
    mark = F.xxhash64("v")
    several = good.groupBy("__id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).filter("lo != hi").select("__id")
    of_ids = good.join(several, "__id", "left_semi").withColumn("h", mark).join(placed.select(mark.alias("h"), F.col("v").alias("w"), "component"), "h").filter("v = w")
    of_ids = written(of_ids.select("__id", "component").distinct(), "vectors-of-ids")
    by_id = of_ids.join(of_ids.groupBy("__id").agg(F.min("component").alias("lo")), "__id").filter("component != lo")
    joined = connected(by_id, "component", "lo").select(F.col("id").alias("component"), F.col("component").alias("c2"))
    whole = written(hub_join(placed, "component", joined, size["n"], "left").withColumn("component", F.coalesce("c2", "component")).drop("c2"), "joined")
    least = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    answer = hub_join(whole, "component", least, size["n"]).select(F.col("v").alias("w"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"), "component_id")
    answer = written(answer.withColumn("h", F.xxhash64("w")), "vector-answers")
    # Copies of one vector may be a large share of all rows: their join is dealt to several tasks.
    mine = hub_join(good.withColumn("h", F.xxhash64("v")), "h", answer, size["rows"]).filter("v = w").select("__id", "n_links", "component_id")
    other = source.filter(~F.coalesce(usable, F.lit(False))).select("__id", F.lit(0).cast("bigint").alias("n_links"), F.col("__id").alias("component_id"))
    out = mine.unionByName(other)
    release(classes, blocks, *levels, found, placed, of_ids, whole)
    return out.select(F.col("__id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(True)).alias("kept"))


def oracle_sql(threshold: float = 0.9) -> str:
    """DuckDB SQL for near_vectors() over embeddings: all pairs."""
    return f"""
WITH RECURSIVE s AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT * FROM s WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.rid AS x, b.rid AS y, a.vec_id AS i, b.vec_id AS j FROM g a JOIN g b ON a.rid <> b.rid AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {threshold}),
e AS (SELECT DISTINCT i, j FROM l),
r AS (SELECT i AS id, i AS c FROM e UNION SELECT e.j, r.c FROM r JOIN e ON e.i = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.c, vec_id)::BIGINT AS component_id, coalesce(coalesce(m.c, vec_id) = vec_id, true) AS kept
FROM s LEFT JOIN n ON n.x = s.rid LEFT JOIN m ON m.id = s.vec_id"""
