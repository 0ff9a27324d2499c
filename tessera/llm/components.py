"""Connected components by repeated hooking and contraction.

Every round hooks each node to its smallest neighbour, shortens the chains by
pointer jumping and contracts the edges. All state is in DataFrames that are
cut by checkpoints; no links or components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, scratch

#: Pointer jumps in a round: chains get 2**JUMPS times shorter.
JUMPS = 2


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``, one row for each node of an edge.

    Self loops, repeated edges and either direction are fine; nodes without an
    edge to another node are not in the result. Rows with a null end are
    dropped. An empty table gives an empty result.
    """
    with scratch(edges.sparkSession):
        left = cut(
            edges.where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        rounds: list[DataFrame] = []
        while not rounds or not left.isEmpty():
            both = left.union(left.select("b", "a"))
            up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
            for _ in range(JUMPS):
                higher = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
                up = up.join(higher, "root").select("node", F.col("top").alias("root"))
            up = cut(up)
            rounds.append(up)
            a = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
            b = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            left = cut(
                left.join(a, "a").join(b, "b").where("ra <> rb")
                .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                .distinct()
            )
        out = rounds[0]
        for up in rounds[1:]:
            higher = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            out = cut(out.join(higher, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        return cut(out, outside=True)
