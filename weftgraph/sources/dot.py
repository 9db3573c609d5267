"""Graphs as DOT text: one row for each node and edge, and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import kmers as K
from weftgraph.operators import graph as G
from weftgraph.operators.durable import keep


def _port(node: Column, edge: Column, k: int) -> Column:
    side = K.side(node, edge, k)
    return F.when(side == "L", "w").when(side == "R", "e").otherwise("s")


def dot_nodes(nodes: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """(node, line): name, left and right ends, grey where reads end, a diamond where duplex edges can be."""
    rows = nodes.select("node").distinct().join(ends, "node", "left").na.fill(0, ["left_ends", "right_ends"])
    name = K.unpack(F.col("node"), k - 1)
    colour = F.when(F.col("left_ends") + F.col("right_ends") > 0, "grey").otherwise("white")
    shape = F.when(K.packed_can_have_duplex_edges(F.col("node"), k), "diamond").otherwise("ellipse")
    line = F.format_string('  %s[ label="%s\\n(%d, %d)", style=filled, fillcolor=%s, shape=%s ];', name, name, "left_ends", "right_ends", colour, shape)
    return rows.select(name.alias("node"), line.alias("line"))


def dot_edges(edges: DataFrame, k: int) -> DataFrame:
    """(edge, line): from left to right node, labelled with k-mer and count, ports by side."""
    e, left, right = F.col("edge"), F.col("l"), F.col("r")
    edges = edges.select("edge", "cnt", K.left_node(e, k).alias("l"), K.right_node(e, k).alias("r"))
    line = F.format_string('  %s -> %s[ label="(%s, %d)", tailport=%s, headport=%s ];', K.unpack(left, k - 1), K.unpack(right, k - 1), K.unpack(e, k), "cnt", _port(left, e, k), _port(right, e, k))
    return edges.select(K.unpack(e, k).alias("edge"), line.alias("line"))


def dot_lines(name: str, nodes: DataFrame, edges: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """(part, line) of a whole digraph; order by both."""
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, f"digraph {name} {{"), (3, "}")], "part int, line string")
    return head.unionByName(dot_nodes(nodes, ends, k).select(F.lit(1).alias("part"), "line")).unionByName(dot_edges(edges, k).select(F.lit(2).alias("part"), "line"))


def dot_balls(seeds: DataFrame, inc: DataFrame, edges: DataFrame, ends: DataFrame, k: int, depth: int = 6) -> DataFrame:
    """(seed, part, line): the digraph around each seed node, for a look at single faults; order by all three.

    A node has eight edges at most, so a seed has a bounded number of lines; seeds are meant to be few.
    """
    near = keep(G.balls(seeds, inc, depth), "balls")
    nodes = dot_nodes(near.select("node").distinct(), ends, k).withColumnRenamed("node", "name")
    inside = G.edges_of(near.select("node").distinct(), edges, k)
    arcs = dot_edges(inside, k).join(inside.select(K.unpack(F.col("edge"), k).alias("edge"), K.unpack(K.left_node(F.col("edge"), k), k - 1).alias("name")), "edge")
    named = near.select("seed", K.unpack(F.col("node"), k - 1).alias("name"))
    lines = nodes.select("name", F.lit(1).alias("part"), "line").unionByName(arcs.select("name", F.lit(2).alias("part"), "line"))
    return named.join(lines, "name").select("seed", "part", "line")


def write_dot_balls(path: str, balls: DataFrame, k: int) -> None:
    """A folder seed=<node> for each seed, with the lines of its digraph in order."""
    seeds = balls.select("seed").distinct()
    head = seeds.select("seed", F.lit(0).alias("part"), F.concat(F.lit("digraph "), K.unpack(F.col("seed"), k - 1), F.lit(" {")).alias("line"))
    tail = seeds.select("seed", F.lit(3).alias("part"), F.lit("}").alias("line"))
    rows = balls.unionByName(head).unionByName(tail).withColumn("seed", K.unpack(F.col("seed"), k - 1))
    rows.repartition("seed").sortWithinPartitions("seed", "part", "line").select("seed", "line").write.mode("overwrite").partitionBy("seed").text(path)


def write_dot(path: str, name: str, nodes: DataFrame, edges: DataFrame, ends: DataFrame, k: int) -> None:
    """Text files that make a digraph in the order of their names."""
    dot_lines(name, nodes, edges, ends, k).orderBy("part", "line").select("line").write.mode("overwrite").text(path)
