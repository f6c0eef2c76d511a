"""Connected components of link tables, by joins only; no links reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise


def components(links: DataFrame) -> DataFrame:
    """id, root for every id in links (a, b): root is the smallest id of its component. Each round hooks every id to the smallest root
    around it and then takes the root's root, so that long chains shrink by a factor a round. Each round is a written table."""
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.distinct(), "edges")
    roots = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")), "roots")
    while True:
        # the smallest root among neighbours, for the id and for the root it had
        around = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        seen = roots.join(around, "id").select("id", "root", F.least("root", "near").alias("near"))
        hooks = seen.groupBy(F.col("root").alias("r")).agg(F.min("near").alias("hook"))
        hooked = seen.join(hooks, seen["root"] == hooks["r"]).select("id", "root", F.least("near", "hook").alias("new"))
        up = hooked.select(F.col("id").alias("new"), F.col("new").alias("upper"))
        after = materialise(hooked.join(up, "new", "left").select("id", F.col("root").alias("old"), F.least("new", F.coalesce("upper", "new")).alias("root")), "roots")
        changed = after.where("old <> root").limit(1).count()
        drop(roots)
        roots = after.select("id", "root")
        if not changed:
            drop(both)
            return roots
