"""De-duplication, stratified samples and resuming, as windows and anti joins.

Random order is a keyed hash of the row's key, so a sample can be drawn again on any
cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each combination of keys, the last in the given total order."""
    return _keep(df, keys, order, reverse=True)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return _keep(df, keys, order, reverse=False)


def _keep(df: DataFrame, keys: list[str], order: list, reverse: bool) -> DataFrame:
    """By an aggregate instead of a window: rows are thinned before the shuffle, and a frequent key fills no task."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    place = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(columns)))
    rest = [c for c in df.columns if c not in keys]
    picked = (F.max_by if reverse else F.min_by)(F.struct(*(F.col(c) for c in rest)) if rest else F.lit(1), place)
    kept = df.groupBy(*keys).agg(picked.alias("_row"))
    return kept.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


def shuffle_key(seed: int, *keys: str) -> Column:
    """A hash that puts rows in an order that depends on the seed and their key only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def stratified_take(df: DataFrame, group: list[str], strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group, taken in turn from its strata, each in random order."""
    stratum = F.concat_ws("||", *(F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata))
    drawn = Window.partitionBy(*group, "_stratum").orderBy("_key", key)
    turn = Window.partitionBy(*group).orderBy("_turn", "_stratum", key)
    rows = df.withColumn("_stratum", stratum).withColumn("_key", shuffle_key(seed, key)).withColumn("_turn", F.row_number().over(drawn)).filter(F.col("_turn") <= n)
    return rows.withColumn("pick", F.row_number().over(turn)).filter(F.col("pick") <= n).drop("_stratum", "_key", "_turn")


def balanced_sample(df: DataFrame, group: list[str], topic: str, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group: one of each topic first, the rest in turn from the strata."""
    one = Window.partitionBy(*group, topic).orderBy("_key", key)
    keyed = df.withColumn("_key", shuffle_key(seed, key))
    first = keyed.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n", "_key").withColumn("_round", F.lit(0)).withColumn("pick", F.lit(0))
    rest = df.join(first.select(*group, key), [*group, key], "left_anti")
    more = stratified_take(rest, group, strata, key, n, seed + 100).withColumn("_round", F.lit(1))
    place = Window.partitionBy(*group).orderBy("_round", "pick", topic, key)
    return first.unionByName(more).withColumn("pick", F.row_number().over(place)).filter(F.col("pick") <= n).drop("_round")


def audit_sheet(df: DataFrame, blanks: list[str]) -> DataFrame:
    """The rows with empty columns to fill in."""
    return df.select("*", *(F.lit("").alias(b) for b in blanks))


def complete_rows(done: DataFrame, keys: list[str], metrics: list[str], error: str | None = None) -> DataFrame:
    """The finished rows of an earlier run: all metrics there, no error, the last of each key by its ordinal."""
    whole = done.dropna(subset=metrics)
    if error is not None:
        whole = whole.filter(F.col(error).isNull())
    return keep_last(whole, keys, ["ordinal"])


def pending(cases: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The cases that are not done."""
    return cases.join(done.select(*keys), keys, "left_anti")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, low, high, rows over equal bins of the column's range; nulls are left out."""
    value = F.col(column).cast("double")
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.when(width > 0, F.floor((value - F.col("_lo")) / width)).otherwise(0), F.lit(bins - 1))
    rows = df.select(value.alias(column)).dropna().crossJoin(F.broadcast(ends)).withColumn("bin", at.cast("long"))  # one row
    return rows.groupBy("bin").agg(F.first(F.col("_lo") + F.col("bin") * width).alias("low"), F.first(F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), F.count(F.lit(1)).alias("rows"))
