"""Connected components of a link table by alternating large-star and small-star steps.

Every step is an aggregate (minimum of the neighbours, combined map-side) and a join, so a node
with very many links is never gathered in one place.  The number of rounds grows with the
logarithm of the longest path.  Each round is written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthkit.llm.base import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
        least.select("u", F.col("m").alias("v"))).distinct()


#: Links that a task writes in a round, and tasks that write at least.  Every file costs a few calls to its store (on a local
#: disk even processes of its own), and a round's rows are few and narrow.
ROWS, TASKS = 50_000, 8


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Null ends, self links and repeated links are ignored; an empty table gives none."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = cut_lineage(edges, "links"), None
    most = edges.count()  # no step makes more links than it is given
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)).coalesce(max(TASKS, -(-most // ROWS))), "links")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFF)))).first()
        if state == before or not state[0]:
            break
        before, most = state, state[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
