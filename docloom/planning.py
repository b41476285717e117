"""How plans are kept from repeating work or growing with the data: barriers, checked broadcasts, split keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
SALTS = 32


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each worked out once a row.

    A generator of one row stands between them and what uses them, so the optimiser
    does not write their expressions out again at each use.
    """
    row = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select(*(c for c in df.columns if c not in columns), F.inline(F.array(row)))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of stored files, dealt out to all cores if it comes in fewer partitions than there are.

    Rules over texts take far longer than moving them, and so few partitions are
    small ones; a scan of many partitions stays as it is and is not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def in_place(function, kind: str):
    """A function over Arrow arrays as a column function that a plan calls once a row.

    A filter on its result would otherwise be pushed below the projection that
    computes it, and both would call it. It is said to be not deterministic, which
    keeps it in its place; the functions given here return the same values each time.
    """
    return F.arrow_udf(function, kind).asNondeterministic()


def width(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    size = F.lit(16 + 8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array<float", "array<double", "array<int", "array<bigint")):
            size = size + 8 * F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return size


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes; it is read for that."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(width(df)).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """left joined with a table of distinct keys: by broadcast if it is small enough, else by a shuffle with split keys.

    spread: a column of left whose hash splits the rows of a frequent key.
    """
    if small_enough(right):
        return left.join(F.broadcast(right), keys, how)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")
