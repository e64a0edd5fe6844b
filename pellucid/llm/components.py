"""Connected components of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pellucid.llm._common import Stored


def components(links: DataFrame) -> Stored:
    """links: a, b (ids, in any direction, repeats allowed). A stored table of id, component (smallest id reachable).

    Labels spread to the smallest of a node's neighbours and then jump to the label of the label, until none
    changes; stars and copies settle in two or three rounds. Nulls link nothing. Only the number of changes
    comes to the driver.
    """
    both = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = Stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = Stored(edges.df.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.df.join(labels.df.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
        moved = labels.df.join(near, "id").select("id", F.least("component", "other").alias("to"), (F.least("component", "other") < F.col("component")).alias("moved"))
        root = labels.df.select(F.col("id").alias("to"), F.col("component").alias("root"))
        new = Stored(moved.join(root, "to").select("id", F.least("to", "root").alias("component"), (F.col("moved") | (F.col("root") < F.col("to"))).alias("moved")), "labels")
        changed = new.df.where("moved").limit(1).count()
        labels.drop()
        labels = new
        if not changed:
            break
    edges.drop()
    labels.df = labels.df.select("id", "component")
    return labels
