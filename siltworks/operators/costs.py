"""Costs of networks given as graphs of layers: shapes flow along the edges in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.scratch import scratch_table

#: What layers do: convolutions, transposed ones, joining of channels, sums, and resizing by ``stride`` (finer or coarser).
OPS = ("input", "conv", "deconv", "concat", "add", "up", "down")


def graph_shapes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``model, node, op, height, width, channels, macs, parameters`` of every layer that the inputs reach.

    ``nodes``: ``model, node, op, c_out, kernel, stride, groups``, inputs with ``height, width``; ``edges``: ``model, src, dst``. A layer is
    ready once all that leads to it is; each round takes all layers of all models that are ready, so there are as many rounds as the longest
    path has layers. Layers on a cycle, or behind a layer that is missing, never get ready and are left out. Repeated edges
    count as often as they are there. Channels of several inputs add up for ``concat``; sizes must agree, the largest counts.
    """
    nodes, edges = scratch_table(nodes, "graph-nodes"), scratch_table(edges.select("model", "src", "dst"), "graph-edges")
    needs = scratch_table(edges.groupBy("model", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("needs")), "graph-needs")
    zero = F.lit(0).cast("double")
    begin = nodes.where("op = 'input'").select(
        "model", "node", "op", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"),
        F.col("c_out").cast("long").alias("channels"), zero.alias("macs"), F.lit(0).cast("long").alias("parameters"),
    )
    front = scratch_table(begin, "graph-front")
    done, arrived = front, None
    while front.head(1):
        new = edges.join(front.select("model", F.col("node").alias("src"), "height", "width", "channels"), ["model", "src"])
        new = new.groupBy("model", F.col("dst").alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.max("height").alias("h"), F.max("width").alias("w"), F.sum("channels").alias("c_sum"), F.max("channels").alias("c_max")
        )
        waiting = new if arrived is None else arrived.unionByName(new)
        whole = waiting.groupBy("model", "node").agg(F.sum("n").alias("n"), F.max("h").alias("h"), F.max("w").alias("w"), F.sum("c_sum").alias("c_sum"), F.max("c_max").alias("c_max"))
        whole = scratch_table(whole.join(needs, ["model", "node"]), "graph-arrived")
        ready = whole.where("n = needs").join(nodes.drop("height", "width").where("op <> 'input'"), ["model", "node"])
        front = scratch_table(_layers(ready), "graph-front")
        arrived = whole.where("n < needs").drop("needs")
        done = done.unionByName(front)
    return done


def _layers(ready: DataFrame) -> DataFrame:
    """Shape and cost of layers whose inputs' shapes are known."""
    op, stride = F.col("op"), F.coalesce(F.col("stride"), F.lit(1)).cast("long")
    c_in = F.when(op == "concat", F.col("c_sum")).otherwise(F.col("c_max"))
    finer, coarser = op.isin("deconv", "up"), op.isin("conv", "down")
    side = lambda s: F.when(finer, F.col(s) * stride).when(coarser, F.ceil(F.col(s) / stride)).otherwise(F.col(s)).cast("long")
    weighs = op.isin("conv", "deconv")
    channels = F.when(weighs, F.col("c_out")).otherwise(c_in).cast("long")
    each = c_in * F.col("c_out") * F.col("kernel") * F.col("kernel") / F.coalesce("groups", F.lit(1))
    cells = F.when(op == "deconv", F.col("h") * F.col("w")).otherwise(side("h") * side("w"))
    return ready.select(
        "model", "node", "op", side("h").alias("height"), side("w").alias("width"), channels.alias("channels"),
        F.when(weighs, cells * each).otherwise(0.0).cast("double").alias("macs"), F.when(weighs, each + F.col("c_out")).otherwise(0).cast("long").alias("parameters"),
    )


def graph_costs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``model, layers, gmac, parameters`` over the layers of ``graph_shapes``."""
    shapes = graph_shapes(nodes, edges)
    return shapes.groupBy("model").agg(F.count(F.lit(1)).alias("layers"), (F.sum("macs") / 1e9).alias("gmac"), F.sum("parameters").alias("parameters"))
