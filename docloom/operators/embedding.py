"""Embedding records and embedders.

The default embedder is offline and deterministic: hashed word counts, damped and
scaled to length one, over Arrow batches. A neural one plugs in through the same
interface.
"""

from __future__ import annotations

import re
import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..planning import in_place


def embedding_records(chunks: DataFrame) -> DataFrame:
    """What is embedded of each chunk: its fields, joined path and tags, and the retrieval text."""
    tags = F.coalesce(F.array_join("topic_tags", ", "), F.lit("")) if "topic_tags" in chunks.columns else F.lit("")
    path = F.col("section_path")
    return chunks.select(*chunks.columns, T.join_path(path).alias("section_path_text"), tags.alias("topic_tags_text"), T.retrieval_text(F.col("title"), path, F.col("text")).alias("retrieval_text"))


class Embedder(ABC):
    """Adds a column ``embedding`` of vectors of length one."""

    dimension: int

    @abstractmethod
    def transform(self, df: DataFrame, text_col: str) -> DataFrame: ...


_TOKEN = re.compile(r"[^\W_]+")


def hashed_vector(text: str | None, dimension: int) -> np.ndarray | None:
    """Damped signed counts of the words' hashes, of length one; None without words."""
    counts = np.zeros(dimension)
    for word in _TOKEN.findall((text or "").lower()):
        h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        counts[h % dimension] += 1.0 if h >> 31 else -1.0
    damped = np.sign(counts) * np.log1p(np.abs(counts))
    length = np.linalg.norm(damped)
    return (damped / length).astype(np.float32) if length else None


class HashingEmbedder(Embedder):
    """Words hashed into so many signed dimensions; a text without words has a null embedding."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def column(self, text: Column) -> Column:
        dimension = self.dimension

        def encode(texts: pa.Array) -> pa.Array:
            return pa.array([hashed_vector(t, dimension) for t in texts.to_pylist()], pa.list_(pa.float32()))

        return in_place(encode, "array<float>")(text)

    def transform(self, df: DataFrame, text_col: str) -> DataFrame:
        return df.withColumn("embedding", self.column(F.col(text_col)))


class ModelEmbedder(Embedder):
    """A model that is loaded once per Python worker and encodes batches of texts."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[float]]]], dimension: int):
        self.load, self.dimension = load, dimension

    def transform(self, df: DataFrame, text_col: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("array<float>")
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                yield pd.Series(list(model([t or "" for t in texts])), index=texts.index)

        return df.withColumn("embedding", encode.asNondeterministic()(text_col))  # a filter on it must not call it again


def embedding_summary(df: DataFrame, model: str, batch_size: int) -> DataFrame:
    """One row: the model, its batch size, the number of vectors and their dimension."""
    return df.agg(F.lit(model).alias("model_name"), F.lit(batch_size).cast("long").alias("batch_size"), F.count("embedding").alias("num_vectors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("long").alias("vector_dim"))
