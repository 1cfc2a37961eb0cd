"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b. -> node, component (the least node that it is linked to), one row for each node that occurs.

    Every round each node takes the least label among its neighbours' and its own, and then that
    label's own label, so chains shorten by half; groups of copies, which are stars, take two
    rounds. Labels are summed up before they are shuffled, so a node with very many links does not
    gather them; what a round ends with is a stored table.
    """
    ways = F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("b").alias("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = stored(links.where(F.col("a") != F.col("b")).select(ways.alias("way")).select("way.*").distinct(), "links", few=True)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")), "labels", few=True)
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        nearer = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        roots = nearer.select(F.col("node").alias("at"), F.col("mid").alias("root"))
        new = nearer.join(roots, F.col("mid") == F.col("at"), "left").select("node", "old", F.least("mid", "root").alias("component"))
        new = stored(new, "labels", few=True)
        labels = new.select("node", "component")
        if new.where(F.col("old") != F.col("component")).limit(1).count() == 0:
            return labels
