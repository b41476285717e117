"""Prompts, answers and their citations.

A generator answers rows of prompts. The default is offline: the first sentences of
the best chunks. A model plugs in as an iterator over batches, loaded once a worker.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..planning import lookup
from ..sources.files import exists
from .sampling import keep_first, pending


def generation_cases(retrieved: DataFrame, variants: DataFrame) -> DataFrame:
    """One prompt for each question and variant: its chunks in rank order, ids and model."""
    item = F.struct("rank", "chunk_id", "source_id", "section_path_text", "chunk_text")
    keys = ["query_id", "variant", "query_text", "topic", "difficulty"]
    grouped = lookup(retrieved.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_c")), variants.select("variant", "model_name"), ["variant"], "query_id")
    return grouped.select("query_id", "variant", "model_name", "topic", "difficulty", "query_text", F.transform("_c", lambda c: c["chunk_id"]).alias("chunk_ids"), F.transform("_c", lambda c: c["source_id"]).alias("source_ids"), T.prompt(F.col("query_text"), F.col("_c")).alias("prompt_text"))


class Generator(ABC):
    """Adds a column ``answer_text`` to generation cases."""

    @abstractmethod
    def transform(self, cases: DataFrame) -> DataFrame: ...


class ExtractiveGenerator(Generator):
    """Answers with the first sentences of the chunks in the prompt; the offline stand-in of a model."""

    def __init__(self, sentences: int = 2):
        self.sentences = sentences

    def transform(self, cases: DataFrame) -> DataFrame:
        texts = F.regexp_extract_all("prompt_text", F.lit(r"(?m)^Text: (.*)$"), F.lit(1))
        said = F.slice(F.flatten(F.transform(texts, lambda t: F.slice(T.split_sentences(t), 1, 1))), 1, self.sentences)
        return cases.withColumn("answer_text", F.array_join(said, " "))


class ModelGenerator(Generator):
    """A model that is loaded once per worker and answers batches of prompts; rows are spread by model first."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[str]]]):
        self.load = load

    def transform(self, cases: DataFrame) -> DataFrame:
        load = self.load

        @F.pandas_udf("string")
        def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for prompts in batches:
                yield pd.Series(model(list(prompts)), index=prompts.index)

        return cases.repartition("model_name", "query_id").withColumn("answer_text", answer.asNondeterministic()("prompt_text"))  # a filter on it must not call it again


def model_name(variant: Column) -> Column:
    """The tier of a variant's model; an unknown variant is an error."""
    tiers = F.create_map(*(x for v, _, tier in C.VARIANTS for x in (F.lit(v), F.lit(tier))))
    return F.coalesce(F.try_element_at(tiers, variant), F.raise_error(F.concat(F.lit("unknown variant: "), F.coalesce(variant, F.lit("null")))))


def model_id(name: Column, ids: dict[str, str], strict: bool = True) -> Column:
    """The id under which a model is loaded; an unknown name is an error, or stands for itself if not strict."""
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in ids.items() for x in pair)), name) if ids else F.lit(None).cast("string")
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown model: "), name)) if strict else name)


def run_generation(cases: DataFrame, generator: Generator, path: str) -> DataFrame:
    """Answers the cases that the table at path lacks, appends them there partition by partition, and returns all answers.

    A run that breaks off loses only the partitions that were not written; the next
    one takes up what is left. A case is known by query_id and variant.
    """
    spark = cases.sparkSession
    keys = ["query_id", "variant"]
    left = pending(cases, spark.read.parquet(path), keys) if exists(spark, path) else cases
    with_citations(generator.transform(left)).write.mode("append").parquet(path)
    return keep_first(spark.read.parquet(path), keys, ["answer_text"])


def with_citations(answers: DataFrame) -> DataFrame:
    """Answers (answer_text, chunk_ids) with their citations repaired: answer_text, answer_text_plain, citations."""
    return answers.select(*(c for c in answers.columns if c != "answer_text"), T.enforced_answer(F.col("answer_text"), F.col("chunk_ids")).alias("answer_text"), T.strip_citations(F.col("answer_text")).alias("answer_text_plain"), T.enforced_citations(F.col("answer_text"), F.col("chunk_ids")).alias("citations"))
