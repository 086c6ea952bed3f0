"""Connected components of links between numbered nodes, by minimum labels and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subjectseries.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it reaches.

    Every round each node takes the smallest label around it, and its label's label; long chains
    halve in each round. Rounds are written, so a lost executor repeats one round at most.
    """
    both = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "component-links",
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")),
        "component-labels",
    )
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        onward = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = materialize(
            labels.join(around, "node", "left")
            .join(onward, "label", "left")
            .select(
                "node",
                F.col("label").alias("before"),
                F.least("label", "near", "further").alias("label"),
            ),
            "component-labels",
        )
        labels = stepped.drop("before")
        if stepped.where("label < before").isEmpty():
            return labels.withColumnRenamed("label", "component")
