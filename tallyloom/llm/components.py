"""Connected components by randomised contraction, all in DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import discard, materialize


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); component is one of its nodes.

    Each round points a node at the neighbour (or itself) with the smallest salted hash and
    contracts the graph along these pointers. The hash changes per round, so a path, a star and
    a clique all lose a constant share of their nodes a round whatever the ids: rounds grow with
    the logarithm of the graph. Neighbours are reduced by a map-side minimum, so a hub costs one
    row a task; nothing is collected to the driver but the emptiness of the edge set.
    Null ends and self-loops are dropped; repeated edges count once.
    """
    live = materialize(
        edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(),
        "cc-edges",
    )
    steps: list[DataFrame] = []
    for i in range(rounds):
        if live.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(i), c).alias("h"), F.col(c).alias("n"))
        both = live.select("u", "v").unionAll(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy(F.col("u").alias("node")).agg(F.min(rank("v")).alias("m")).select(
            "node", F.least(F.struct(F.xxhash64(F.lit(i), "node").alias("h"), F.col("node").alias("n")), F.col("m"))["n"].alias("to")
        )
        step = materialize(step, "cc-step")
        steps.append(step)
        a, b = step.toDF("u", "a"), step.toDF("v", "b")
        before, live = live, materialize(
            live.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(),
            "cc-edges",
        )
        discard(before)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)
    discard(live)
    last, whole = steps[-1], steps[-1].toDF("node", "component")
    for step in reversed(steps[:-1]):
        whole = materialize(
            step.join(whole.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("component", "to").alias("component")), "cc-map"
        )
        discard(last, step)
        last = whole
    return whole
