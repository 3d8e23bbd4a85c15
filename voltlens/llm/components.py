"""Connected components of an edge table by alternating star contraction.

Only joins and aggregates on edges: hubs with many edges are reduced by map-side minima and their
join partitions can be split, no adjacency list is ever gathered.  Each round is written to the
shared folder, so the plan stays short and a lost executor costs one round at most.  The write itself
observes whether a round has changed anything, and edges that come later are contracted among the
roots known so far: the driver plans each round anew, and what that leaves there follows the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from voltlens.llm.common import clear_up, discard, stored

ROUNDS = 60


def star_edges(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b)`` of longs -> one row ``(node, root)`` per node that is not its root.

    ``root`` is the smallest node of the component; nodes without edges and roots have no row.
    Loops, repeated edges and empty tables are fine.  ``known`` is the result for edges that came before:
    components of both are returned.  Only links between its roots are contracted then.
    """
    now, state = observed((edges if known is None else between_roots(edges, known)).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).where("a <> b").distinct())
    before = None
    for _ in range(ROUNDS):
        if state == before or not state[0]:
            clear_up(now.sparkSession)
            found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return found if known is None else moved_roots(known, found)
        before = state
        after, state = observed(small_star(large_star(now)))
        discard(now)
        now = after
    raise RuntimeError(f"components did not settle within {ROUNDS} rounds")


def observed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a stored table, and their number and sum of hashes, taken as they are written."""
    seen = Observation()
    table = stored(edges.observe(seen, F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("mark")), "edges")
    return table, (seen.get["n"], seen.get["mark"])


def between_roots(edges: DataFrame, known: DataFrame) -> DataFrame:
    """The edges between the roots of their ends."""
    of_a, of_b = (known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    return edges.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")
    )


def moved_roots(known: DataFrame, found: DataFrame) -> DataFrame:
    """``known`` with the roots that ``found`` gives its roots, and the rows of ``found``, which has none of its nodes."""
    onward = found.select(F.col("node").alias("root"), F.col("root").alias("onward"))
    return known.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root")).union(found)


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node among the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.where("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; ``a > b`` in every edge."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
