"""Bounded crawling over a stored link graph (ITR1, ITR2, J16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltweave.session import cut


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int = 20, max_pages: int | None = None) -> DataFrame:
    """(page, depth): pages reached from ``seeds`` over ``edges`` (source, target), least depth first.

    Edges are made and partitioned by their source once. Each level joins the frontier with the links, drops what was visited by an anti-join and cuts
    the lineage by a reliable checkpoint. Only counts come to the driver. ``max_pages`` is the crawl's
    budget: the level that would pass it (the seeds are one) is taken in page order up to it.
    """
    edges = cut(edges.select("source", "target").where("source is not null and target is not null").distinct().repartition("source"))
    seeds = seeds.select("page").where("page is not null").distinct()
    if max_pages is not None:
        seeds = seeds.orderBy("page").limit(max_pages)
    visited = cut(seeds.withColumn("depth", F.lit(0)))
    frontier, total = visited.select("page"), visited.count()
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier, edges.source == frontier.page).select(F.col("target").alias("page")).where("page is not null").distinct()
        fresh = step.join(visited.select("page"), "page", "left_anti")
        if max_pages is not None:
            fresh = fresh.orderBy("page").limit(max(0, max_pages - total))
        fresh = cut(fresh)
        n = fresh.count()
        if not n:
            break
        total += n
        visited = visited.unionByName(fresh.withColumn("depth", F.lit(depth)))
        if depth % 8 == 0:
            visited = cut(visited)
        frontier = fresh
    return visited
