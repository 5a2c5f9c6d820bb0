"""Connected components of a link table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.store import Store


def components(spark: SparkSession, links: DataFrame, store: Store | None = None) -> DataFrame:
    """(id, component) for every id in ``links(a, b)``: the smallest id reachable.

    Each round hooks every vertex to its smallest neighbour, flattens the
    resulting forest by pointer jumping and contracts the links; the number of
    vertices at least halves, so rounds grow with the logarithm of the input.
    Hot vertices are met only by partial minima and by joins that AQE can split.
    """
    store = store or Store(spark, "components")
    edges = store.put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    result: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = store.put(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("p")))
        while True:
            up = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = store.put(parent.join(up, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            store.drop(parent)
            parent = jumped
            if parent.where("moved").isEmpty():
                break
        root = parent.select("u", "p")
        shrunk = (
            edges.join(root, "u")
            .select(F.col("p").alias("x"), F.col("v").alias("u"))
            .join(root, "u")
            .select(F.col("x"), F.col("p").alias("y"))
            .where("x <> y")
            .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
            .distinct()
        )
        edges_next = store.put(shrunk)
        store.drop(edges)
        edges = edges_next
        if result is None:
            result = root.select(F.col("u").alias("id"), F.col("p").alias("component"))
        else:
            step = root.select(F.col("u").alias("component"), F.col("p").alias("next"))
            result = result.join(step, "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    if result is None:
        return spark.createDataFrame([], "id long, component long")
    return store.put(result)


def merged(spark: SparkSession, part: DataFrame, links: DataFrame, store: Store) -> DataFrame:
    """``part(id, component)`` with further ``links(a, b)``: only the components that these join are met again, not the links before."""
    side = lambda end: part.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    step = components(spark, between, store)
    moved = part.join(step.select(F.col("id").alias("component"), F.col("component").alias("next")), "component", "left").select("id", F.coalesce("next", "component").alias("component"))
    return store.put(moved.unionByName(step.join(part.select("id"), "id", "left_anti")))
