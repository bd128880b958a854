"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored

#: Nodes of fewer edges than this are never treated as hubs.
HUB = 100_000


def _tied(both: DataFrame, least: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Edges with the least of their first node's neighbourhood; hubs' (10,000 at most) go to every task, as their edges would meet in one."""
    if hubs is None:
        return both.join(least, "u")
    at = F.broadcast(least.join(F.broadcast(hubs), "u", "left_semi"))
    return both.join(at, "u").unionByName(both.join(F.broadcast(hubs), "u", "left_anti").join(least, "u"))


def _star(edges: DataFrame, large: bool, hubs: DataFrame | None = None) -> DataFrame:
    """Large: each node ties its larger neighbours to the least of its neighbourhood. Small: it ties its smaller ones and itself."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = _tied(both, least, hubs)
    if large:
        out = tied.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _hubs(edges: DataFrame, n: int, hub: int) -> DataFrame | None:
    """Nodes with over `hub` of the n edges and over a five-thousandth of them, if there are any."""
    if n <= hub:
        return None
    ends = edges.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count("*").alias("c"))
    found = stored(ends.where(F.col("c") > max(hub, n / 5_000)).select("u"), "hubs")
    return found if found.limit(1).count() else None


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(u, root) for every node of the edges (u, v) but the roots; root is the least node that u reaches.

    Rounds go on until an iteration changes nothing, a logarithmic number in the size of the largest component; each
    is written to the shared folder. Least neighbours are partial minima, and edges of hubs do not meet in one task.
    """
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return e.select("u", F.col("v").alias("root"))
        mark = now
        wide = _star(e, True, _hubs(e, now[0], hub))
        if now[0] > hub:
            wide = stored(wide, "edges")
            e = stored(_star(wide, False, _hubs(wide, wide.count(), hub)), "edges")
        else:
            e = stored(_star(wide, False), "edges")
