"""Drill-down of unknown depth through a causal graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.sources.files import store_folder


def drill_down(edges: DataFrame, start: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, reached, probability, hops, path): of every start id the most
    probable path to each node that it reaches, however deep; of equally
    probable ones the shortest, then the first by name.  A path's probability
    is the product of its edges'.

    Edges are (source, target, type, probability).  Parallel edges count as
    their most probable one; a probability over 1 counts as 1, and edges with
    none, none over 0 or a null end lead nowhere.  Cycles end, as going round
    never gives a better path.  A start reaches itself by no hop.  An empty
    graph leaves the starts alone; null starts take no part.

    A fixpoint: only paths that became better in a round go on in the next,
    and a round writes only these.  There is a round for each hop of the
    longest best path.
    """
    spark = edges.sparkSession
    folder = store_folder(spark, "drilldown")
    known = edges if kind is None else edges.where(F.col("type") == kind)
    p = F.col("probability").cast("double")
    known = known.where((p > 0) & ~F.isnan(p) & F.col("source").isNotNull() & F.col("target").isNotNull())
    ends = [F.col("source").cast("string").alias("_s"), F.col("target").cast("string").alias("_t")]
    known.groupBy(*ends).agg(F.max(F.least(p, F.lit(1.0))).alias("_p")).write.parquet(f"{folder}/steps")
    steps = spark.read.parquet(f"{folder}/steps")

    ident = F.col("id").cast("string")
    # a smaller struct is a better path
    best = F.struct(F.lit(-1.0).alias("minus"), F.lit(0).alias("hops"), ident.alias("path")).alias("best")
    first = start.where("id is not null").select(ident.alias("id")).distinct()
    level = first.select("id", F.col("id").alias("reached"), best)
    schema = level.schema
    depth = 0
    while True:
        level.write.parquet(f"{folder}/level={depth}")
        levels = [f"{folder}/level={k}" for k in range(depth + 1)]
        found = spark.read.schema(schema).parquet(*levels).groupBy("id", "reached").agg(F.min("best").alias("best"))
        last = spark.read.schema(schema).parquet(levels[-1])
        if last.isEmpty():
            return found.select("id", "reached", (-F.col("best.minus")).alias("probability"), F.col("best.hops").alias("hops"), F.col("best.path").alias("path"))
        on = F.struct((F.col("best.minus") * F.col("_p")).alias("minus"), (F.col("best.hops") + 1).alias("hops"), F.concat("best.path", F.lit(" > "), "_t").alias("path"))
        ahead = last.join(steps, F.col("reached") == F.col("_s")).select("id", F.col("_t").alias("reached"), on.alias("best"))
        ahead = ahead.groupBy("id", "reached").agg(F.min("best").alias("best"))
        before = found.select("id", "reached", F.col("best").alias("_before"))
        level = ahead.join(before, ["id", "reached"], "left").where(F.col("_before").isNull() | (F.col("best") < F.col("_before"))).select("id", "reached", "best")
        depth += 1
