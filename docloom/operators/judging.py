"""Scoring of cases by judges: per-row errors, resuming, and matches of tokens by their vectors.

A scorer gives the metrics of one case or fails; a failure becomes the row's error
and stops nothing. Finished rows are kept, the others are scored again.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..planning import in_place
from ..sources.files import exists
from .embedding import hashed_vector
from .sampling import complete_rows, pending


class Scorer(ABC):
    """Gives metrics of a case; setup runs once a batch's worker, so a client or model may be made there."""

    metrics: tuple[str, ...]

    def setup(self) -> None:  # noqa: B027 - most scorers need none
        """Called before the first case of a worker's batches."""

    @abstractmethod
    def score(self, case: dict) -> dict[str, float | None]: ...


_TOKEN = re.compile(r"[a-z0-9]+")


class OverlapScorer(Scorer):
    """The offline stand-in of a judge: shares of distinct words that question, answer and reference have in common; an empty answer is an error."""

    metrics = ("answer_relevance", "faithfulness")

    def score(self, case: dict) -> dict[str, float | None]:
        answer, question, reference = (set(_TOKEN.findall((case.get(c) or "").lower())) for c in ("answer", "question", "ground_truth"))
        if not answer:
            raise ValueError("empty answer")
        return {"answer_relevance": len(question & answer) / len(question) if question else None, "faithfulness": len(reference & answer) / len(answer) if reference else None}


def judge(cases: DataFrame, scorer: Scorer, keys: list[str], fields: list[str], error: str = "ragas_error") -> DataFrame:
    """keys, the scorer's metrics and error of every case; fields are what the scorer sees of it besides.

    A case that fails has null metrics and its error's type and message.
    """
    metrics = scorer.metrics

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer.setup()
        for batch in batches:
            rows = []
            for case in batch.to_dict("records"):
                row = {k: case[k] for k in keys} | dict.fromkeys(metrics) | {error: None}
                try:
                    said = scorer.score(case)
                    row |= {m: None if (v := said.get(m)) is None else float(v) for m in metrics}
                except Exception as e:  # noqa: BLE001 - whatever a case does becomes its row
                    row[error] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=[*keys, *metrics, error]).astype(dict.fromkeys(metrics, "float64"))

    kinds = dict(cases.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{m} double" for m in metrics), f"{error} string"])
    scored = cases.select(*dict.fromkeys([*keys, *fields])).mapInPandas(run, schema)
    return scored.select(*keys, *(F.when(~F.isnan(m), F.col(m)).alias(m) for m in metrics), error)


def judge_pending(cases: DataFrame, done: DataFrame, scorer: Scorer, keys: list[str], fields: list[str], error: str = "ragas_error") -> DataFrame:
    """What a run adds to an earlier one (done: keys, metrics, error, ordinal): the cases without a complete row, scored."""
    finished = complete_rows(done, keys, list(scorer.metrics), error)
    return judge(pending(cases, finished, keys), scorer, keys, fields, error)


def run_judge(cases: DataFrame, scorer: Scorer, keys: list[str], fields: list[str], path: str, error: str = "ragas_error") -> DataFrame:
    """Scores the cases that the table at path lacks, appends them there partition by partition, and returns the finished rows.

    A run that breaks off loses only the partitions that were not written; the next
    one takes up what is left. ordinal counts the runs, so later rows win.
    """
    spark = cases.sparkSession
    kinds = dict(cases.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{m} double" for m in scorer.metrics), f"{error} string", "ordinal bigint"])
    done = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    run = (done.agg(F.max("ordinal")).first()[0] or 0) + 1
    new = judge_pending(cases, done, scorer, keys, fields, error).withColumn("ordinal", F.lit(run).cast("long"))
    new.write.mode("append").parquet(path)
    return complete_rows(spark.read.schema(schema).parquet(path), keys, list(scorer.metrics), error).drop("ordinal")


def trigram_vector(token: str, dimension: int = 64) -> np.ndarray:
    """A vector of length one from a token's character trigrams: the offline stand-in of a contextual one."""
    padded = f"^{token}$"
    made = hashed_vector(" ".join(padded[i : i + 3].encode().hex() for i in range(max(1, len(padded) - 2))), dimension)
    return made if made is not None else np.zeros(dimension, dtype=np.float32)


def embedding_match_scores(cases: DataFrame, answer_col: str = "answer_text_plain", reference_col: str = "reference_answer", encode: Callable[[str], np.ndarray] = trigram_vector, keys: tuple[str, ...] = ("query_id", "variant")) -> DataFrame:
    """keys, bertscore_p, r, f1: every token of one text matched greedily with its most similar of the other.

    encode gives a token's vector, of length one; a neural encoder plugs in there.
    Texts without tokens score 0. Tokens that occur again are matched again.
    """

    def match(answers: pa.Array, references: pa.Array) -> pa.Array:
        known: dict[str, np.ndarray] = {}
        p, r = [], []
        for pair in zip(answers.to_pylist(), references.to_pylist()):
            # a token's best match does not depend on how often it occurs: distinct tokens, weighed by their counts
            sides = [np.unique(_TOKEN.findall((t or "").lower()), return_counts=True) for t in pair]
            if not all(len(tokens) for tokens, _ in sides):
                p.append(0.0)
                r.append(0.0)
                continue
            for tokens, _ in sides:
                for t in tokens:
                    if t not in known:
                        known[t] = encode(str(t))
            a, b = (np.stack([known[t] for t in tokens]).astype(np.float64) for tokens, _ in sides)
            best = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
            for at in range(0, len(a), 1024):
                near = a[at : at + 1024] @ b.T
                best[0][at : at + 1024] = near.max(axis=1)
                np.maximum(best[1], near.max(axis=0), out=best[1])
            for out, m, (_, count) in zip((p, r), best, sides):
                out.append(float(np.average(m, weights=count)))
        return pa.StructArray.from_arrays([pa.array(p, pa.float64()), pa.array(r, pa.float64())], ["p", "r"])

    scored = cases.select(*keys, in_place(match, "struct<p:double,r:double>")(F.col(answer_col), F.col(reference_col)).alias("_m")).select(*keys, F.col("_m.p").alias("bertscore_p"), F.col("_m.r").alias("bertscore_r"))
    total = F.nullif(F.col("bertscore_p") + F.col("bertscore_r"), F.lit(0.0))
    return scored.withColumn("bertscore_f1", F.coalesce(F.try_divide(2 * F.col("bertscore_p") * F.col("bertscore_r"), total), F.lit(0.0)))
