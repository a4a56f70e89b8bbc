"""Distributed union-find: connected components by alternating star contractions.

Every round hangs each node's larger neighbours, then its smaller ones, on the
smallest node in reach, until only stars are left. All steps are groupings
that combine on the map side and equi-joins, whose hot sides adaptive execution
splits; each round is written to the checkpoint folder, so a lost executor costs
one round. Neither edges nor components ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.session import materialize

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1_000_000_007), F.lit(0)).alias("s")
    ).first()
    return row["n"], row["s"]


def _least(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))


def _arcs(node: str, low: str) -> list:
    return [F.col(node).alias("a"), F.col(low).alias("b")]


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes on edges (a, b) of one integer type.

    Loops and repeated edges change nothing; edges with a null end are left
    out; without edges the result is empty.
    """
    current = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _state(current)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        # Large star: every node's larger neighbours go to the least node next to it.
        both = current.union(current.select(*_arcs("b", "a")))
        large = both.join(_least(both), "a").where("b > a").select(*_arcs("b", "low")).distinct()
        # Small star: every node and its smaller neighbours go to the least of these.
        least = _least(large)
        small = large.join(least, "a").where("b <> low").select(*_arcs("b", "low"))
        current = materialize(small.union(least.select(*_arcs("a", "low"))).distinct())
        before, state = state, _state(current)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
