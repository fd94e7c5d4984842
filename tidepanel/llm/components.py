"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("src", "dst"), F.lit(1 << 40)))).first()
    return tuple(row)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (src, dst), component being its smallest node.

    Self loops and repeated edges are fine, an empty table gives an empty result. Each round
    relinks every node to the smallest node it sees, written to the shared folder; the rounds
    are logarithmic in the longest path. Hot centres are joined as (node, neighbour) rows,
    never gathered in one row.
    """
    node = edges.schema["src"].dataType.simpleString()
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").cast(node).alias("dst")).where("src <> dst").distinct()
    edges = materialize(edges, "cc-edges")
    seen = _fingerprint(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
        large = materialize(large, "cc-large")
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst")
        small = small.unionByName(low.select("src", F.col("low").alias("dst"))).distinct()
        edges = materialize(small, "cc-small")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
