"""Connected components of an edge table, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_table, heavy_split, skew_safe_lookup, write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that label;
    the labels are written to the shared folder after each round, until none changes. Where there are
    hubs, they meet their many edges by a skew-safe lookup.
    """
    both = write_table(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    n_edges = both.count()
    degrees = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("degree"))
    labels = write_table(degrees.select("node", F.least("node", "least").alias("comp"), "degree"), "cc-labels", rows=n_edges)
    n_nodes = labels.count()
    hubs = not heavy_split(labels, "degree", n_edges)[0].isEmpty()
    while True:
        of_b = labels.select(F.col("node").alias("b"), "comp", "degree")
        heard = skew_safe_lookup(both, of_b, ["b"], "degree", n_edges) if hubs else both.join(of_b, "b")
        near = heard.groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "degree", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        up = labels.where("node <> comp").select(F.col("node").alias("up"), F.col("comp").alias("over"))  # a root's label is its own
        jumped = step.join(up, step["comp"] == up["up"], "left").select("node", F.least("comp", F.coalesce("over", "comp")).alias("comp"), "degree", "old")
        moved = Observation()  # counted while the labels are written: one query for each round
        new = write_table(jumped.observe(moved, F.count(F.when(F.col("comp") != F.col("old"), True)).alias("n")).select("node", "comp", "degree"), "cc-labels", rows=n_nodes)
        drop_table(labels)
        labels = new
        if not moved.get["n"]:
            drop_table(both)
            return labels.select("node", "comp")


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, comp) with the components that edges (a, b) join made one. Nodes without a label are components of their own. The files of labels go."""
    own = labels.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    across = edges.join(own, "a", "left").join(own.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left")
    joined = connected_components(across.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    met = joined.select(F.col("node").alias("comp"), F.col("comp").alias("whole"))
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("held"))
    table = sizes.join(met, "comp", "left").select("comp", F.coalesce("whole", "comp").alias("whole"), "held")
    moved = skew_safe_lookup(labels, table, ["comp"], "held", labels.count()).select("node", F.col("whole").alias("comp"))
    new = met.join(own, met["comp"] == own["a"], "left_anti").select(F.col("comp").alias("node"), F.col("whole").alias("comp"))
    whole = write_table(moved.union(new), "cc-labels")
    for done in (labels, joined):
        drop_table(done)
    return whole
