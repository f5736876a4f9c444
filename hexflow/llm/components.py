"""Connected components of a links table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexflow.llm.scratch import Scratch, files_for

#: Edges of a file; a round has no more edges than the one before.
_EDGES = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).union(moved).distinct()


def components(scratch: Scratch, links: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b) that is not its component's smallest.

    Rounds end when the edge set no longer changes; it is then one star per component around the
    smallest node.  Every round is written to the shared folder, in as many files as its edges need;
    only a few numbers reach the driver.  ``links`` is counted first, so it should lie on disk.  An empty table gives an empty result; self links and repeated links change nothing.
    """
    files = files_for(links.count(), _EDGES)
    edges = scratch.save(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), f"{name}-0", files=files)
    seen = None
    for k in range(1, max_rounds + 1):
        edges = scratch.save(_small_star(_large_star(edges)), f"{name}-{k}", files=files)
        scratch.drop(f"{name}-{k - 1}")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen, files = now, files_for(now[0], _EDGES)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
