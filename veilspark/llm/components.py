"""Connected components by alternating large-star and small-star rounds, each cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import drop_path, new_path


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and its neighbours. e: (u, v) with u < v."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lower = both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u")
    return e.join(lower, "u", "left").select(F.coalesce("m", "u").alias("u"), "v")


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of v, and v, are linked to the least of them. e: (u, v) with u < v."""
    least = e.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
    links = e.join(least.filter("n > 1").drop("n"), "v").filter("m < u").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return least.select(F.col("m").alias("u"), "v").unionByName(links)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node reachable. Only nodes with an edge to another node appear.

    Edges may repeat, run in either direction or join a node to itself; rows with a null end are left out.
    An empty table gives an empty result. Hubs are met by partial aggregation and by AQE's skew join.
    """
    spark = edges.sparkSession
    at: list[str] = []

    def cut(df: DataFrame) -> DataFrame:
        at.append(new_path(spark, "components"))
        df.write.parquet(at[-1])
        return spark.read.schema(df.schema).parquet(at[-1])

    e = cut(
        edges.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        e = cut(_small_star(_large_star(e).distinct()).distinct())
        for p in at[:-1]:
            drop_path(spark, p)
        at = at[-1:]
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("u").distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
