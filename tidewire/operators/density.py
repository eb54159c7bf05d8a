"""Density clusters of vectors: a hierarchy over near neighbours, cut where clusters last longest.

Distances are straight ones between vectors of length one. The core distance of
a vector is that to its ``core``-th other vector; two vectors of which one is among the
``neighbours`` nearest of the other are linked from the largest of their distance and both core
distances on. Link distances are rounded up to the levels ``FLOOR * ratio ** i``, so the hierarchy
has as many steps as there are levels with a link, 22 at most by default, whatever the number of vectors. At
each level the links of that level are contracted; where components of
``least`` members or more meet, their clusters end and that of all begins, smaller ones join or
are nothing yet. A cluster's stability is, summed over its members, the inverse distance at which each leaves it
less the one at which it begins; a cluster is taken if its stability is
no less than that of all taken below it. Parts that nothing links begin at an
inverse distance of 0; where there is but one, it holds everything and isn't a cluster.

Links, components and members are written tables, one for each level, and their numbers are all
that the driver sees. Equal vectors are one row with a number, so a vector with many copies
is in no hot key and no pair of copies is ever made.

Defined cases: vectors that are null, all zeros or hold a null or NaN are
outliers. A vector with fewer others than ``core`` takes the farthest. Equal
stabilities (to ``PLACES``) go to the larger cluster. No vectors give no rows.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import with_index
from ..sources.workspace import scratch, written
from . import cells
from .graph import components

FLOOR, RATIO = 0.02, 1.25
NEIGHBOURS, CORE, LEAST = 10, 2, 2
#: Stabilities are rounded to so many places before they are compared.
PLACES = 9
#: Parts in which the copies of a vector look up their representative.
SALTS = 16


def inverse(level: int, ratio: float = RATIO) -> float:
    """One over the distance of a level."""
    return 1 / (FLOOR * ratio**level)


def distinct(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, size, embedding)``, each vector once with its smallest id, and ``(id, node)`` of all that are usable."""
    usable = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        "embedding is not null and forall(embedding, x -> x is not null and not isnan(x)) and exists(embedding, x -> x <> 0)"
    )
    rows = usable.withColumn("digest", F.sha2(F.array_join("embedding", ","), 256))
    nodes = written(rows.groupBy("digest").agg(F.min("id").alias("node"), F.count("*").alias("size"), F.first("embedding").alias("embedding")), "distinct")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    keys = nodes.select("digest", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return nodes.select("node", "size", "embedding"), rows.select("id", "digest", salt).join(keys, ["digest", "salt"]).select("id", "node")


def links(nodes: DataFrame, neighbours: int = NEIGHBOURS, core: int = CORE, ratio: float = RATIO) -> DataFrame:
    """``(a, b, level)`` with a <= b of the distinct vectors; a = b where copies of one are linked."""
    index = cells.build(nodes, id_col="node")
    found = cells.nearest(index, nodes.select(F.col("node").alias("query_id"), "embedding"), neighbours + 1).where("query_id <> id")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    near = found.select("query_id", "id", F.sqrt(F.greatest(2 * F.col("distance"), F.lit(0.0))).alias("apart"), F.row_number().over(order).alias("position")).where(F.col("position") <= neighbours)
    near = written(near.join(nodes.select(F.col("node").alias("id"), F.col("size").alias("others")), "id"), "near")
    # Others met up to a neighbour: its copies, those before it, and the vector's own.
    met = near.withColumn("met", F.sum("others").over(Window.partitionBy("query_id").orderBy("position")))
    reached = met.join(nodes.select(F.col("node").alias("query_id"), "size"), "query_id").groupBy("query_id").agg(
        F.min(F.when(F.col("met") + F.col("size") - 1 >= core, F.col("apart"))).alias("first"), F.max("apart").alias("last")
    )
    at_core = F.when(F.col("size") > core, 0.0).otherwise(F.coalesce("first", "last", F.lit(0.0)))
    cores = written(nodes.select("node", "size").join(reached.withColumnRenamed("query_id", "node"), "node", "left").select("node", "size", at_core.alias("core")), "cores")
    of = lambda node: cores.select(F.col("node").alias(node), F.col("core").alias(f"core_{node}"))
    pairs = near.join(of("query_id"), "query_id").join(of("id"), "id").select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), F.greatest("apart", "core_query_id", "core_id").alias("apart"))
    copies = cores.where("size > 1").select(F.col("node").alias("a"), F.col("node").alias("b"), F.col("core").alias("apart"))
    # A little below the level itself, so that rounding doesn't lift a distance that lies on it.
    level = F.greatest(F.ceil(F.log(F.greatest("apart", F.lit(FLOOR)) / FLOOR) / math.log(ratio) - 1e-6), F.lit(0)).cast("int")
    return pairs.union(copies).groupBy("a", "b").agg(F.min(level).alias("level"))


def hierarchy(nodes: DataFrame, edges: DataFrame, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """``(child, parent, taken)``: every stage of a component, the last one of a cluster marked if
    the cluster is taken. Stages are named by level and component, those of vectors by ``v`` and node.
    ``nodes(node, size)``, ``edges`` as of ``links``."""
    spark = nodes.sparkSession
    edges = written(edges, "links")
    levels = sorted(r.level for r in edges.select("level").distinct().collect())
    state = nodes.select("node", F.concat(F.lit("v:"), "node").alias("stage"), "size", F.lit(False).alias("cluster"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("below"))
    steps: list[DataFrame] = []

    for level in levels:
        with scratch(spark):
            now = inverse(level, ratio)
            met = edges.where(F.col("level") == level)
            groups = components(met)
            alone = met.where("a = b").select(F.col("a").alias("node")).join(groups, "node", "left_anti")
            moved = groups.union(alone.select("node", F.col("node").alias("component")))
            touched = written(state.join(moved, "node").withColumn("stability", F.round(F.col("mass") - F.col("size") * now, PLACES)), "touched", keep=True)
            inside = lambda x: F.sum(F.when(F.col("cluster"), x).otherwise(0))
            sums = touched.groupBy("component").agg(
                F.sum("size").alias("all"), inside(F.lit(1)).alias("met"), inside(F.col("size")).alias("inside"), F.sum("mass").alias("mass"), F.sum("below").alias("below"), inside(F.greatest("stability", "below")).alias("taken")
            )
            goes_on, begins = F.col("met") == 1, (F.col("met") != 1) & (F.col("all") >= least)
            joined = written(
                sums.select(
                    F.col("component").alias("node"),
                    F.concat(F.lit(f"{level}:"), "component").alias("stage"),
                    F.col("all").alias("size"),
                    (goes_on | begins).alias("cluster"),
                    F.when(goes_on, F.col("mass") + (F.col("all") - F.col("inside")) * now).when(begins, F.col("all") * now).otherwise(0.0).alias("mass"),
                    F.when(goes_on, F.col("below")).when(begins, F.col("taken")).otherwise(0.0).alias("below"),
                    "met",
                ),
                "joined",
                keep=True,
            )
            up = joined.select(F.col("node").alias("component"), F.col("stage").alias("parent"), "met")
            steps.append(touched.join(up, "component").select(F.col("stage").alias("child"), "parent", (F.col("cluster") & (F.col("met") > 1) & (F.col("stability") >= F.round("below", PLACES))).alias("taken")))
            state = written(state.join(touched.select("node"), "node", "left_anti").union(joined.drop("met")), "state", keep=True)
            left = edges.where(F.col("level") > level)
            for end in ("a", "b"):
                left = left.join(touched.select(F.col("node").alias(end), F.col("component").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            pairs = left.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("level").alias("level"))
            # Links of a component with itself say nothing any more, but copies not yet linked wait for their level.
            waiting = pairs.where("a = b").join(touched.select(F.col("component").alias("a")), "a", "left_anti")
            edges = written(pairs.where("a <> b").union(waiting), "links", keep=True)

    last = state.where("cluster")
    several = last.limit(2).count() > 1
    tops = state.select(F.col("stage").alias("child"), F.lit(None).cast("string").alias("parent"), (F.lit(several) & F.col("cluster") & (F.round("mass", PLACES) >= F.round("below", PLACES))).alias("taken"))
    return written(functools.reduce(DataFrame.union, steps, tops), "stages")


def topmost(stages: DataFrame) -> DataFrame:
    """``(child, label)``: the highest stage taken among a stage and those above it, if any.

    Each round looks twice as far up, so the rounds are the logarithm of the depth, which is at most the number of levels.
    """
    now = stages.select("child", F.col("parent").alias("up"), F.when(F.col("taken"), F.col("child")).alias("label"))
    while now.where("up is not null").limit(1).count():
        above = now.select(F.col("child").alias("up"), F.col("up").alias("next"), F.col("label").alias("higher"))
        now = written(now.join(above, "up", "left").select("child", F.col("next").alias("up"), F.coalesce("higher", "label").alias("label")), "above")
    return now.select("child", "label")


def clusters_of(vectors: DataFrame, neighbours: int = NEIGHBOURS, core: int = CORE, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """``(id, topic_id)`` of ``vectors(id, embedding)`` that belong to a cluster,
    numbered by falling size from 0, ties by smallest id; outliers have no row."""
    if core > neighbours:
        raise ValueError("core distances need as many neighbours")
    with scratch(vectors.sparkSession):
        nodes, copies = distinct(vectors)
        stages = topmost(hierarchy(nodes.select("node", "size"), links(nodes, neighbours, core, ratio), least, ratio)).where("label is not null")
        placed = nodes.select("node", F.concat(F.lit("v:"), "node").alias("child")).join(stages, "child").select("node", "label")
        rows = written(copies.join(placed, "node").select("id", "label"), "placed")
        sizes = rows.groupBy("label").agg(F.count("*").alias("size"), F.min("id").alias("first"))
        numbered = with_index(sizes, F.desc("size"), F.col("first"), name="number")
        return written(rows.join(numbered, "label").select("id", F.col("number").cast("int").alias("topic_id")), "topics", keep=True)
