"""Connected components of an edge table by neighbour minima and pointer jumping, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayflow.llm.common import aside, cut, narrow


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(u, v) edges of long ids -> (node, label), label the smallest id reachable; nodes without edges are not listed.
    ``rows``: the number of edges at most, if it is known; few are dealt over few tasks.

    Each round a node takes the smallest label among its neighbours, then the label of its label.  Labels of
    few nodes are broadcast; else a hub's rows are split by the skew handling of the join.  They are reduced by partial
    aggregation.  Repeated edges and loops do no harm.
    """
    few = (lambda df: df) if rows is None else lambda df: narrow(df, 2 * rows)
    both = cut(few(edges.select("u", "v").union(edges.select("v", "u")).filter("u is not null and v is not null").distinct()))
    labels = cut(few(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"))))
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    before, nodes = labels.agg(total, F.count(F.lit(1))).first()
    while before is not None:
        held = aside(labels.withColumnRenamed("node", "at"), nodes)
        near = both.join(held, both["u"] == held["at"]).groupBy("v").agg(F.min("label").alias("m"))
        step = labels.join(aside(near, nodes), labels["node"] == near["v"], "left").select("node", F.least("label", "m").alias("label"))
        up = step.select(F.col("node").alias("up_node"), F.col("label").alias("up_label"))
        labels = cut(narrow(step.join(aside(up, nodes), step["label"] == up["up_node"]).select("node", F.col("up_label").alias("label")), nodes))
        after = labels.agg(total).first()[0]
        if after == before:
            break
        before = after
    return labels
