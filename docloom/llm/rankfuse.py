"""One ranking from several scores of different scales, by Borda count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._plan import cut

BUCKETS = 64


def _ranks(scores: DataFrame) -> DataFrame:
    """_name, _value, _rank (1 is the highest; ties share their mean) from _name, _value.

    Equal values are counted before anything is sorted, and the distinct ones are
    ranked within buckets of neighbouring values, so no task holds a whole score.
    """
    values = scores.groupBy("_name", "_value").agg(F.count(F.lit(1)).alias("_n"))
    bounds = values.groupBy("_name").agg(F.percentile_approx("_value", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("_bounds"))
    values = values.join(F.broadcast(bounds), "_name").withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col("_value")))).drop("_bounds")
    sums = values.groupBy("_name", "_bucket").agg(F.sum("_n").alias("_in"))  # at most BUCKETS rows a score
    above = Window.partitionBy("_name").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_higher", F.coalesce(F.sum("_in").over(above), F.lit(0))).drop("_in")
    within = Window.partitionBy("_name", "_bucket").orderBy(F.desc("_value")).rowsBetween(Window.unboundedPreceding, -1)
    better = F.col("_higher") + F.coalesce(F.sum("_n").over(within), F.lit(0))
    return values.join(F.broadcast(sums), ["_name", "_bucket"]).select("_name", "_value", (better + (F.col("_n") + 1) / 2).alias("_rank"))


def borda_ranking(df: DataFrame, id_col: str, weights: dict[str, float]) -> DataFrame:
    """id_col, points, position (1 is best) of each id.

    Higher scores are better. Within each score an item has its competition rank,
    ties sharing the mean of theirs; a missing score (null or NaN) has the middle
    rank; ranks among fewer items are stretched to the number of all. An item's
    points are the weighted sum of how many it is ahead of; equal points are
    ordered by id. Null ids are left out; an id that occurs again counts once,
    with its highest value of each score. Infinite scores rank as any others.
    """
    names = list(weights)
    base = df.select(F.col(id_col).alias("_id"), *(F.col(c).cast("double").alias(f"_s{i}") for i, c in enumerate(names))).filter(F.col("_id").isNotNull())
    base = base.groupBy("_id").agg(*(F.max(F.when(~F.isnan(f"_s{i}"), F.col(f"_s{i}"))).alias(f"_s{i}") for i in range(len(names))))
    base = cut(base)
    entries = F.array(*(F.struct(F.lit(i).alias("_name"), F.col(f"_s{i}").alias("_value")) for i in range(len(names))))
    scores = base.select("_id", F.explode(entries).alias("_e")).select("_id", "_e.*")
    present = scores.filter(F.col("_value").isNotNull())
    ranked = present.join(_ranks(present), ["_name", "_value"])
    counts = base.agg(F.count(F.lit(1)).alias("_all"), *(F.count(f"_s{i}").alias(f"_m{i}") for i in range(len(names)))).first()
    everyone, present_in = counts["_all"], [counts[f"_m{i}"] for i in range(len(names))]
    weight = reduce(lambda acc, i: acc.when(F.col("_name") == i, F.lit(float(weights[names[i]]))), range(len(names)), F.when(F.lit(False), F.lit(0.0)))
    stretch = reduce(lambda acc, i: acc.when(F.col("_name") == i, F.lit((everyone + 1) / (present_in[i] + 1))), range(len(names)), F.when(F.lit(False), F.lit(0.0)))
    middle = (everyone - 1) / 2
    gained = ranked.select("_id", (weight * (F.lit(everyone) - F.col("_rank") * stretch)).alias("_p"))
    lost = scores.filter(F.col("_value").isNull()).select("_id", (weight * F.lit(middle)).alias("_p"))
    points = gained.unionByName(lost).groupBy("_id").agg(F.round(F.sum("_p"), 6).alias("points"))
    return positions(points, [F.desc("points"), F.asc("_id")]).select(F.col("_id").alias(id_col), "points", "position")


def positions(df: DataFrame, order: list) -> DataFrame:
    """The rows with their position (from 1) in a total order, sorted in ranges."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return placed.join(F.broadcast(sizes), "_part").withColumn("position", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")
