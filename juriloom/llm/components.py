"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import release, written

HUB = 128  # neighbours from which on an id is a hub, whose edges are not moved to meet its least neighbour
HUBS = 50_000  # the hub bound rises with the edges so that there are never more hubs than this


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (a, b) with m, the least neighbour of a by the table least (a, m, n neighbours). Hubs have more than
    max(HUB, 2 * edges / HUBS) of the 2 * edges neighbours in all, so that at most HUBS of them are broadcast and their
    rows stay where they are; no other id gathers more rows than that in one task."""
    hub = F.col("n") > max(HUB, 2 * edges // HUBS)
    known = rows.join(F.broadcast(least.filter(hub).select("a", F.col("m").alias("h"))), "a", "left")
    rest = known.filter("h is null").select("a", "b").join(least.filter(~hub).select("a", "m"), "a")
    return known.filter("h is not null").select("a", "b", F.col("h").alias("m")).unionByName(rest.select("a", "b", "m"))


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id that has a link to another id, with the smallest id reachable.

    Each round hangs the neighbours of an id onto the least of them; the minimum is aggregated before the shuffle, and the
    edges of hubs are not shuffled. The number of rounds grows with the logarithm of the longest chain; the loop ends at the
    fix-point. Rounds are written to the shared folder and released by the round after. Null ids and loops give no
    link; repeated links count once; no links give an empty table.
    """
    known = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    edges = written(links.filter(known).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    count, before = edges.count(), None
    while count:
        # Large star: larger neighbours go to the least of the neighbourhood.
        both = _both(edges)
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = written(_with_least(both.filter("b > a"), least, count).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct(), "edges")
        # Small star: an id and its smaller neighbours go to the least of these.
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, lower, count).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(lower.select("a", F.col("m").alias("b")))
        following = written(small.distinct(), "edges")
        release(edges, large)
        edges = following
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state["n"], state["h"]) == before:
            break
        before, count = (state["n"], state["h"]), state["n"]
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionByName(roots)
