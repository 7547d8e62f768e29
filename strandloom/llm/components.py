"""Connected components by alternating large and small stars, each a shuffle with partial minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.skew import join_counted
from strandloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), in any order and repeated at will -> (node, component_id): the least node of its component, for every node of an edge."""
    e = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _star(both, both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("c")), F.col("v") > F.col("u"), False)
        e = _star(e, e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), F.lit(True), True)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component_id"))).distinct()


def _star(links: DataFrame, least: DataFrame, far, own: bool) -> DataFrame:
    """Ties the neighbours v of u (and u, if own) to the least of them."""
    least = materialise(least, "least")
    joined = join_counted(links, least, ["u"], "c", links.count()).where(far)
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        out = out.unionByName(joined.select("u", F.col("m").alias("v")))
    return materialise(out.where("u <> v").distinct(), "stars")


def _stars(e: DataFrame) -> bool:
    """Has every u one v that is itself no u?"""
    return e.groupBy("u").count().where("count > 1").isEmpty() and e.select("u").join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()
