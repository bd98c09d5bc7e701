"""Connected components of the graph in a logarithmic number of rounds, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import counted, materialise

#: Doublings within a round: a node goes up to 2 ** JUMPS steps along smallest neighbours.
JUMPS = 2


def component_labels(edges: DataFrame) -> DataFrame:
    """``(node_id, component)`` for every node that has an edge: nodes are connected if and only if they share a label.

    In a round every node goes to its smallest neighbour (or stays, if none is smaller), that one to its own, and so on
    for ``JUMPS`` doublings; the edges are then carried over to the nodes they arrive at, and the next round has only
    those. Smallest is meant by a hash that differs in each round, so that no naming of the nodes makes long descents:
    on a path one node in three is smaller than its neighbours, and nearly all others reach one of these. So nodes
    shrink to about a third and rounds grow with the logarithm of their number. Every round is written, and is
    geometrically smaller than the one before; in the end the rounds are put together, the smallest first.

    Neighbours' minima combine on the map side and the joins are of stored tables, where AQE splits the partition of a
    hub. Self-loops and repeated edges do no harm; a null end is no edge.
    """
    here = edges.select(F.col("src_node_id").alias("a"), F.col("dst_node_id").alias("b"))
    here = here.where("a IS NOT NULL AND b IS NOT NULL")
    rounds: list[DataFrame] = []
    while True:
        both = here.selectExpr("inline(array(named_struct('u', a, 'v', b), named_struct('u', b, 'v', a)))")
        place = lambda c: f"struct(xxhash64({c}, {len(rounds)}) AS h, {c} AS id)"  # noqa: B023, E731
        ends = both.groupBy("u").agg(F.expr(f"least(min({place('v')}), {place('u')}).id").alias("to"))
        for _ in range(JUMPS):
            step = ends.select(F.col("u").alias("at"), F.col("to").alias("next"))
            ends = ends.join(step, F.col("to") == F.col("at")).select("u", F.col("next").alias("to"))
        ends = materialise(ends, f"round-{len(rounds)}")
        rounds.append(ends)
        left = ends.select(F.col("u").alias("a"), F.col("to").alias("p"))
        right = ends.select(F.col("u").alias("b"), F.col("to").alias("q"))
        moved = here.join(left, "a").join(right, "b").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
        here, n = counted(moved.distinct(), f"edges-{len(rounds)}")
        if not n:
            break
    labels = rounds.pop()
    while rounds:  # a place without an edge left keeps its label
        onward = labels.select(F.col("u").alias("at"), F.col("to").alias("last"))
        labels = rounds.pop().join(onward, F.col("to") == F.col("at"), "left").select("u", F.coalesce("last", "to").alias("to"))
    return labels.select(F.col("u").alias("node_id"), F.col("to").alias("component"))
