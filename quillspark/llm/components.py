"""Connected components of a link table by minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, materialise, new_path


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node that each reaches.

    Every round takes the least label among a node's neighbours, then the
    label's own label, so long chains shrink by doubling.  Labels live in
    tables in the shared folder; the driver sees only counts.  Self links and
    links with a null end are ignored; an empty table gives an empty result.
    """
    spark = links.sparkSession
    places = [new_path(spark, "edges"), new_path(spark, "labels")]
    pairs = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = materialise(pairs.union(pairs.select("b", "a")).distinct(), "edges", places[0])
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"))
    labels = materialise(labels, "labels", places[1])
    for _ in range(max_rounds):
        far = labels.select(F.col("node").alias("b"), F.col("label").alias("far"))
        near = edges.join(far, "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(up, "label").select("node", F.least("label", "up").alias("label"), (F.least("label", "up") != F.col("old")).alias("moved"))
        place = new_path(spark, "labels")
        labels = materialise(step, "labels", place)
        delete(spark, places.pop())
        places.append(place)
        if labels.where("moved").isEmpty():
            delete(spark, places[0])
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
