"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two groupings with map-side minima and two joins, which Spark can
split where a node has very many edges. Rounds are written to the shared folder,
so lineage stays short and lost executors cost one round. Nothing but two
numbers per round (a count and a checksum) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granella.llm.common import discard, written


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _distinct(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _distinct(down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another: root is the component's smallest node.

    Null ends and edges from a node to itself are ignored; repeated edges don't
    matter; no edges give no rows.
    """
    now = written(_distinct(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges", tasks_per_slot=4)
    state = _state(now)
    for _ in range(most_rounds if state[0] else 0):
        last, now = now, written(_small_star(_large_star(now)), "edges", tasks_per_slot=4)
        discard(last)
        if (next_state := _state(now)) == state:
            break
        state = next_state
    else:
        if state[0]:
            raise RuntimeError("components did not settle")
    stars = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    return stars.union(stars.select("root", "root")).distinct()
