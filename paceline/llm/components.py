"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm._spark import materialise

MAX_ROUNDS = 60


def _min_neighbour(links: DataFrame) -> DataFrame:
    """Each node's least neighbour, in an exchange of its own, so that adaptive execution may split the links of a hub that they are joined with."""
    return links.groupBy("a").agg(F.min("b").alias("m")).repartition("a")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row ``(node, component)`` for each node of ``links``; component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every round is two
    joins against a pre-aggregated minimum, so no neighbourhood is gathered in one row or
    task, and long chains shrink by a factor each round.  Loops and repeated links do no
    harm; rows with a null end are ignored; no links give no rows.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    state = materialise(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if state.isEmpty():
        return nodes.select("node", F.col("node").alias("component"))
    seen = None
    for _ in range(MAX_ROUNDS):
        both = state.union(state.select(F.col("b"), F.col("a")))
        large = (
            both.join(_min_neighbour(both), "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
            .distinct()
        )
        small = _min_neighbour(large)
        state = materialise(
            large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .union(small.select("a", F.col("m").alias("b")))
            .distinct(),
            "links",
        )
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return nodes.join(state.groupBy("a").agg(F.min("b").alias("m")), F.col("node") == F.col("a"), "left").select("node", F.coalesce("m", "node").alias("component"))
