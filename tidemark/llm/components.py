"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that can be reached) of every node in `edges` (src, dst; any direction, repeats allowed).

    Each round takes the smallest label of all neighbours and then follows that label's own label, so
    a chain shortens by half or more; labels are written to the shared folder after each round. A
    node with very many neighbours is met by partial aggregation and by adaptive skew joins only.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = cut(both.where("src <> dst").distinct(), "edges")
    labels = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("root")), "labels")
    while True:
        near = both.join(labels, both["dst"] == labels["node"]).groupBy(F.col("src").alias("node")).agg(F.min("root").alias("near"))
        lower = cut(labels.join(near, "node").select("node", F.least("root", "near").alias("new"), "root"), "labels")
        jump = lower.select(F.col("node").alias("via"), F.col("new").alias("target"))
        after = cut(lower.join(jump, lower["new"] == jump["via"]).select("node", F.least("new", "target").alias("root"), (F.least("new", "target") < F.col("root")).alias("moved")), "labels")
        labels = after.select("node", "root")
        if after.where("moved").isEmpty():
            return labels
