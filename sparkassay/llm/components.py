"""Connected components of a link table by minimum labels and pointer jumping; every round is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of the links ``a, b``; self links are allowed.

    Each round gives a node the smallest label among its neighbours' and then the label of that label, so the rounds
    grow with the logarithm of a component's diameter. A hub's rows may fill one join key; both sides of each join are
    stored tables, which lets adaptive execution split such a key. Minima are combined before the shuffle.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.filter("a <> b").distinct(), "links")
    labels = materialize(links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                         .select("node", F.col("node").alias("component")), "labels")
    while True:
        offered = edges.join(labels, edges.a == labels.node).groupBy("b").agg(F.min("component").alias("offer"))
        hooked = labels.join(offered, labels.node == offered.b, "left").select(
            "node", F.col("component").alias("was"), F.least("component", "offer").alias("component"))
        hooked = materialize(hooked, "labels")
        above = hooked.select(F.col("node").alias("_p"), F.col("component").alias("_c"))
        jumped = materialize(hooked.join(above, F.col("component") == F.col("_p"), "left").select(
            "node", "was", F.least("component", "_c").alias("component")), "labels")
        labels = jumped.select("node", "component")
        if jumped.filter("component <> was").isEmpty():
            return labels
