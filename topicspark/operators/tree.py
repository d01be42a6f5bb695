"""The topic tree: ancestor expansion, closure, activation, rollups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.functions import text as T
from topicspark.shared import written


def prefixes(path: Column) -> Column:
    """Every ancestor path, root first, and the path itself."""
    parts = T.path_parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def expanded(leaves: DataFrame) -> DataFrame:
    """One row a node of the tree under the given (path, tags), with parent, names of children and type; tags only where given."""
    nodes = leaves.select(F.explode(prefixes(F.col("path"))).alias("path")).distinct()
    children = nodes.withColumn("parent", T.parent_path(F.col("path"))).filter("parent IS NOT NULL").groupBy("parent").agg(F.sort_array(F.collect_set(T.leaf(F.col("path")))).alias("children"))
    tags = leaves.groupBy("path").agg(F.first("tags").alias("tags"))
    df = nodes.join(children, nodes.path == children.parent, "left").drop("parent").join(tags, "path", "left")
    none = F.array().cast("array<string>")
    return df.select("path", T.parent_path(F.col("path")).alias("parent"), F.coalesce("children", none).alias("children"), T.node_type(F.col("path")).alias("node_type"), F.coalesce("tags", none).alias("tags"))


def child_links(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant) of every child that a node's `children` name, each once: the child's path is the node's path and
    the name. Null and empty names lead nowhere."""
    named = nodes.select(F.col("path").alias("ancestor"), F.explode("children").alias("_name")).filter("_name <> ''")
    return named.select("ancestor", F.concat_ws("/", "ancestor", "_name").alias("descendant")).distinct()


def dangling_children(nodes: DataFrame) -> DataFrame:
    """(path, child): children that are named but have no node. A walk that must be whole is an error if there is one."""
    missing = child_links(nodes).join(nodes.select(F.col("path").alias("descendant")), "descendant", "left_anti")
    return missing.select(F.col("ancestor").alias("path"), F.col("descendant").alias("child"))


def closure(nodes: DataFrame, with_self: bool = True) -> DataFrame:
    """(ancestor, descendant), each once, for all that a walk through `children` (names) reaches from each node.

    A node that its parent doesn't name is reached by none of its ancestors, nor is what lies below it, whatever its path
    says; named children without a node are left out (dangling_children tells them). A child's path is longer than its
    parent's, so there is no cycle, and a walk has fewer steps than the longest path has segments: each round joins the
    pairs of up to k steps to themselves, which gives those of up to 2 k, so that rounds are the logarithm of the depth.
    """
    nodes = written(nodes.select("path", "children"), "nodes")  # read several times
    pairs = child_links(nodes).join(nodes.select(F.col("path").alias("descendant")).distinct(), "descendant", "left_semi").select("ancestor", "descendant")
    deepest = nodes.agg(F.max(F.size(T.path_parts(F.col("path"))))).first()[0] or 1
    for r in range(math.ceil(math.log2(max(1, deepest - 1)))):
        if r:
            pairs = written(pairs, "closure")
        on = pairs.select(F.col("ancestor").alias("_at"), F.col("descendant").alias("_below"))
        further = pairs.join(on, F.col("descendant") == F.col("_at")).select("ancestor", F.col("_below").alias("descendant"))
        pairs = pairs.unionByName(further).distinct()
    if not with_self:
        return pairs
    own = nodes.select(F.col("path").alias("ancestor"), F.col("path").alias("descendant")).filter("ancestor IS NOT NULL").distinct()
    return own.unionByName(pairs)


def activated(topics: DataFrame, ingests: DataFrame) -> DataFrame:
    """Topics with an ingest (path, actor) become active and gain its actors, each once, in order after their own."""
    new = ingests.groupBy("path").agg(F.sort_array(F.collect_set("actor")).alias("_new"))
    df = topics.join(new, "path", "left")
    status = F.when(F.col("_new").isNotNull(), "active").otherwise(F.col("status"))
    return df.withColumn("status", status).withColumn("actors", F.array_union("actors", F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")


def rollup(nodes: DataFrame, measures: DataFrame, *aggregates: Column, with_self: bool = True) -> DataFrame:
    """Aggregates of measures (by path) over each node's subtree."""
    return closure(nodes, with_self).join(measures.withColumnRenamed("path", "descendant"), "descendant").groupBy(F.col("ancestor").alias("path")).agg(*aggregates)
