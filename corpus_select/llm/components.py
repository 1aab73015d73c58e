"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's least node and is listed too.

    Each round links every node to the least neighbour of its neighbours, then
    all lower neighbours of a node to the least of them. The number of edges never
    grows, minima are partially aggregated before they move, and a round's table is
    written to the shared folder. Rounds grow with the logarithm of the size.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    state = _state(e)
    while state[0]:
        least = e.groupBy("hi").agg(F.min("lo").alias("m"))
        large = e.join(least.select(F.col("hi").alias("lo"), "m"), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        last, e = e, stored(small.select("e.*").where("hi <> lo").distinct(), name)
        forget(last)
        state, before = _state(e), state
        if state == before:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
