"""Connected components of an edge table, by joins alone.

Each round gives every node the least label among its own and its neighbours', then lets
labels jump to their label's label, until a round changes nothing. Long chains halve in
each round through the jumps. No edge or label reaches the driver but counts of changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (a, b) -> (node, label): the least node that each node of an edge reaches. Labels are of the nodes' type."""
    both = scratch.table(edges.select("a", "b").unionAll(edges.selectExpr("b as a", "a as b")).filter("a is not null and b is not null").distinct(), "both")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("low"), F.col("label").alias("was"))
        # A label that is lowered passes it on to all that hold the old label (hooking), and each takes its label's label (jumping).
        hook = low.filter("low < was").groupBy(F.col("was").alias("label")).agg(F.min("low").alias("to"))
        hooked = low.join(hook.withColumnRenamed("label", "was"), "was", "left").select("node", "was", F.least("low", F.coalesce("to", "low")).alias("low"))
        hooked = scratch.table(hooked, "hooked")
        up = hooked.select(F.col("node").alias("low"), F.col("low").alias("up"))
        new = scratch.table(hooked.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("label"), "was"), "labels")
        changed = new.filter("label <> was").limit(1).count()
        scratch.drop(hooked, labels)
        labels = new.select("node", "label")
        scratch.paths[id(labels)] = scratch.paths.pop(id(new))
        if not changed:
            scratch.drop(both)
            return labels
