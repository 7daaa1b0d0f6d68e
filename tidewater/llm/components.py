"""Connected components of a distributed edge list by alternating large and small stars.

Both stars keep the components and only re-hang edges on smaller ids, and end in one star
for each component after a logarithmic number of rounds. Each round works on edges alone,
with a partial minimum before every shuffle; nothing goes to the driver but whether it is the last. The
minima are staged: joined as tables of known size they are broadcast if small, and otherwise
Spark can split the edges of a star's centre over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import staged, unstaged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex hangs its larger neighbours on the least of its own."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    hung = staged(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "hung")
    unstaged(least)
    return hung


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex hangs its smaller neighbours, and itself, on the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    hung = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    stars = staged(hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
    unstaged(least, edges)
    return stars


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no vertex hangs on two others, and none that hangs on another has one hanging on it."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) to (id, component): the smallest id reachable from each id that has an edge.

    Null ends and self-loops are ignored; an empty edge list gives an empty result.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        earlier, now = now, _small_star(_large_star(now))
        unstaged(earlier)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
