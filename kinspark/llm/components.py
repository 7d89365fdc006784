"""Connected components of document links: the package's own, on doc_ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.graph import rooted

__all__ = ["components", "rooted"]


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex that an edge (a, b) joins to another; component is the smallest vertex reached."""
    return graph.components(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")))
