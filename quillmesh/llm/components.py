"""Connected components by alternating large-star and small-star rounds.

Each round is written to the shared folder, so a lost executor costs one round at most and lineage
stays short; nothing is gathered on the driver but whether work is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, drop_folder, new_folder

MAX_ROUNDS = 60


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every id points to one id and no id that is pointed to points on: nothing is left to do."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("source"), F.lit(0).alias("target")), F.struct(F.col("b").alias("id"), F.lit(0).alias("source"), F.lit(1).alias("target"))))
    per_id = edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.source").alias("sources"), F.max("e.target").alias("target"))
    return per_id.filter("sources > 1 or (sources > 0 and target > 0)").isEmpty()


def _with_min(pairs: DataFrame) -> DataFrame:
    """(u, v, m): neighbours v of u with the smallest m of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    return pairs.join(least, F.col("u") == F.col("k")).drop("k")


def connected_components(edges: DataFrame, scratch: Scratch | None = None, rounds: int | None = None) -> DataFrame:
    """(id, component) for every id on an edge (columns a, b); the component is its smallest id.

    Self-loops, repeated and reversed edges are allowed; ids without an edge to another id are not
    returned. An empty table gives an empty result. ``scratch`` takes over the result's folder.
    After ``rounds``, where that is given, the work stops: equal components then still mean connected
    ids, but ids of one component may have several.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    now = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_folder(spark, "components")
        df.write.parquet(path)
        return spark.read.schema(f"a {kind.simpleString()}, b {kind.simpleString()}").parquet(path), path

    now, path = keep(now)
    whole = _is_star_forest(now)
    for _ in range(MAX_ROUNDS if rounds is None else rounds):
        if whole:
            break
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        large = _with_min(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        down = large.filter(F.col("a") != F.col("b")).select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _with_min(down)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u"), F.col("m"))).filter(F.col("a") != F.col("b")).distinct()
        after, after_path = keep(small)
        drop_folder(spark, path)
        now, path = after, after_path
        whole = _is_star_forest(now)
    if scratch is not None:
        scratch.paths.append(path)
    if whole:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
    if rounds is None:
        raise RuntimeError(f"no star forest after {MAX_ROUNDS} rounds")
    to = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = now.select(F.col("b").alias("id")).distinct().join(to.select("id"), "id", "left_anti")
    return to.union(roots.select("id", F.col("id").alias("component")))
