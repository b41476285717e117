"""Planning helpers of the operators: shared storage and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Where none is named, a temporary one of this machine if everything runs on it;
    on a cluster that is an error, since no executor could read another's parts.
    What is written there is deleted once nothing refers to it any more.
    """
    context = spark.sparkContext._jsc.sc()
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR, None)
    current = context.getCheckpointDir()
    if current.isDefined():
        return current.get()
    if named is None:
        if not context.isLocal():
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "docloom-checkpoints")
    if not context.conf().contains(CLEAN):
        context.conf().set(CLEAN, "true")
    spark.sparkContext.setCheckpointDir(named)
    return named


def arrow_once(kind: str):
    """A decorator: a function over Arrow arrays whose values a plan works out once.

    A filter on its result would otherwise be pushed below the projection that
    computes it, and both would call it. It is said to be not deterministic, which
    keeps it in its place; the functions here do give the same values each time.
    """

    def wrap(function):
        return F.arrow_udf(function, kind).asNondeterministic()

    return wrap


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """The same rows read back from the shared folder, with no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


BROADCAST_BYTES = 64 << 20


def _width(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    wide = lambda kind: kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))
    size = F.lit(16 + 8 * len(df.columns))
    for name, kind in df.dtypes:
        if wide(kind):
            text = F.col(name) if kind in ("string", "binary") else F.to_json(F.struct(name))
            size = size + F.coalesce(F.octet_length(text), F.lit(0))
    return size


def small_enough(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether df, which should be cheap to read (from storage), has at most so many rows and bytes."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_width(df)).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if it has at most max_rows rows and max_bytes bytes, else left to a shuffle join."""
    return F.broadcast(df) if small_enough(df, max_rows, max_bytes) else df


SALTS = 32


def join_small(left: DataFrame, right: DataFrame, keys: list[str], max_rows: int, spread: Column) -> DataFrame:
    """left joined with a right side of distinct keys, by broadcast if that is small enough.

    Else by a shuffle in which every key is split into SALTS by ``spread``, so that
    a key that a third of the rows have does not come to one task.
    """
    if small_enough(right, max_rows):
        return left.join(F.broadcast(right), keys)
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")
