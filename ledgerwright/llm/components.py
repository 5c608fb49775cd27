"""Connected components of an undirected graph, as a DataFrame loop.

Labels start at the smallest neighbour and fall by neighbour minimum and pointer
jumping until nothing changes; each round is written to the shared folder and deleted
when the loop ends. Nothing but one changed/unchanged flag comes to the driver. The
neighbours of a node are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def connected_components(edges: DataFrame, tables: Scratch | None = None) -> DataFrame:
    """``id``, ``component`` (the smallest id reached) for every id in ``edges`` (a, b long); no rows for no edges.

    Self-loops and repeated edges are allowed; edges with a null end are ignored. The
    result is a table of ``tables`` where given.
    """
    with Scratch(edges.sparkSession) as rounds:
        ends = edges.where("a is not null and b is not null")
        both = rounds.written(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(ends.select("b", "a")).distinct(), "cc-edges")
        labels = rounds.written(both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("src"), F.min("dst")).alias("c")), "cc-labels")
        while True:
            near = both.join(labels, both["src"] == labels["id"]).groupBy("dst").agg(F.min("c").alias("m"))
            lower = labels.join(near, labels["id"] == near["dst"]).select("id", F.least("c", "m").alias("c1"), F.col("c").alias("old"))
            to = labels.select(F.col("id").alias("at"), F.col("c").alias("jump"))
            step = rounds.written(lower.join(to, lower["c1"] == to["at"], "left").select("id", F.least("c1", "jump").alias("c"), "old"), "cc-labels")
            labels = step.select("id", "c")
            if step.where("c <> old").limit(1).count() == 0:
                return written(labels.withColumnRenamed("c", "component"), "cc-components") if tables is None else tables.written(labels.withColumnRenamed("c", "component"), "cc-components")
