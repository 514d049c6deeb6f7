"""Connected components of a table of links, by alternating large and small stars.

Every round joins each link with its vertex's smallest neighbour, so that links turn into stars around the
smallest vertex of each component in a logarithmic number of rounds. Links stay in tables; the driver sees
one count and one checksum a round. A hub with very many links is a partial aggregate and the splittable side
of a join, never one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, ws: Workspace, left: str = "u", right: str = "v") -> DataFrame:
    """u, v: every vertex that has a link and isn't the smallest of its component, and that smallest one."""
    cols = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v")
    now = ws.table(small_star(cols), "stars")
    state = _state(now)
    while state[0]:
        after = ws.table(small_star(large_star(now)), "stars")
        ws.drop(now)
        before, state, now = state, _state(after), after
        if state == before:
            break
    return now
