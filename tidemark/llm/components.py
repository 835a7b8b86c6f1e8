"""Connected components of a link table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(links: DataFrame) -> DataFrame:
    """Table (id, label) of every id in ``links`` (u, v); label is the least id of its component.

    Each round gives a node the least label of its neighbours and then the label of its label, so
    the number of rounds grows with the logarithm of the longest path. Labels are written at each
    step; the joins on hot labels and hubs read two written tables and can be split.
    An empty link table gives an empty result. Repeated and self links do no harm.
    """
    edges = materialize(
        links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(),
        "edges",
    )
    labels = materialize(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.v == labels.id).groupBy(F.col("u").alias("n")).agg(F.min("label").alias("m"))
        hooked = materialize(
            labels.join(near, F.col("id") == F.col("n"), "left").select(
                "id", F.least("label", F.coalesce("m", "label")).alias("label"), (F.col("m") < F.col("label")).alias("moved")
            ),
            "hooked",
        )
        moved = hooked.where("moved").limit(1).count()
        if not moved:
            release(edges, labels)
            return hooked.select("id", "label")
        roots = hooked.select(F.col("id").alias("r"), F.col("label").alias("root"))
        jumped = materialize(hooked.join(roots, F.col("label") == F.col("r")).select("id", F.col("root").alias("label")), "labels")
        release(labels, hooked)
        labels = jumped
