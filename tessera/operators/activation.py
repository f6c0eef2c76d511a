"""Spreading activation over a graph."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut

INHIBITION = "inhibition"
INHIBITION_POWER, FATIGUE = 0.55, 0.15


@dataclass
class Fatigue:
    """Ids that answered lately; the session carries it from query to query."""

    tired: set[int] = field(default_factory=set)

    def after(self, hit: list[int], marked: int = 15) -> None:
        """Tired ids that were hit recover; of the others the first `marked` get tired."""
        rested = self.tired.intersection(hit)
        self.tired -= rested
        self.tired.update([i for i in hit if i not in rested][:marked])


def spread(
    edges: DataFrame, seeds: DataFrame, depth: int, teleport: float = 0.0, inverse_inhibition: bool = False, lateral: int = 0, tired: set[int] | None = None
) -> DataFrame:
    """id, score. Each hop sends an id's energy along its edges, times 1 - teleport and the edge's weight (negative for inhibition), over the target's
    in-degree^0.55 and times 0.15 for tired targets where asked. Energies add up; only positive ones go on, the `lateral` strongest if set."""
    e = edges.select("src", "dst", (F.when(F.col("label") == INHIBITION, -F.abs("weight")).otherwise(F.col("weight")) * (1 - teleport)).alias("w"))
    if inverse_inhibition:
        degree = edges.groupBy(F.col("dst").alias("d")).agg(F.count("*").alias("n"))
        e = e.join(degree, e["dst"] == degree["d"]).select("src", "dst", (F.col("w") / F.pow("n", F.lit(INHIBITION_POWER))).alias("w"))
    if tired:
        e = e.withColumn("w", F.when(F.col("dst").isin(list(tired)), F.col("w") * FATIGUE).otherwise(F.col("w")))
    front = seeds.groupBy("id").agg(F.sum("score").alias("score"))
    total = front
    for _ in range(depth):
        front = front.where("score > 0")
        if lateral:
            front = front.orderBy(F.desc("score"), "id").limit(lateral)
        front = front.join(e, front["id"] == e["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("w")).alias("score"))
        front = cut(front)
        total = total.unionByName(front)
    return total.groupBy("id").agg(F.sum("score").alias("score"))
