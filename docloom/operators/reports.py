"""Summaries that compare systems: core scores, audits, breakdowns and the overall table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..planning import lookup
from .evaluation import core_composite

CORE = ("context_relevance_proxy", "answer_relevance_proxy", "proxy_core_composite", "faithfulness_proxy", "citation_validity")


def core_summary(scores: DataFrame, groups: tuple[str, ...] = ("variant", "model_name"), case: str = "query_id") -> DataFrame:
    """Cases, and mean and sample deviation of the five scores by group; the core composite is the mean of the first two that are there."""
    whole = scores.withColumn("proxy_core_composite", core_composite(F.col(CORE[0]), F.col(CORE[1])))
    sums = [a for c in CORE for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    return whole.groupBy(*groups).agg(F.count(case).alias("num_cases"), *sums)


def breakdown(scores: DataFrame, system: str, by: list[str], metrics: list[str]) -> DataFrame:
    """dimension, value and system with cases and means of the metrics, for all dimensions in one pass."""
    sets = [[F.col(system), F.col(b)] for b in by]
    name = F.coalesce(*(F.when(F.grouping(b) == 0, F.lit(b)) for b in by))
    value = F.coalesce(*(F.when(F.grouping(b) == 0, F.col(b).cast("string")) for b in by))
    return scores.groupingSets(sets, system, *by).agg(name.alias("dimension"), value.alias("value"), F.count(F.lit(1)).alias("num_cases"), *(F.avg(m).alias(m) for m in metrics)).select("dimension", "value", system, "num_cases", *metrics)


def audit_summary(sheet: DataFrame, scores: tuple[str, ...] = ("actionability_score", "usefulness_score"), flags: tuple[str, ...] = ("unsupported_claim_flag", "redundancy_flag"), groups: tuple[str, ...] = ("variant", "model_name")) -> DataFrame:
    """Cases, mean scores and rates of set flags by group; blank scores and flags are left out of them."""
    number = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).try_cast("double")
    means = [F.avg(number(c)).alias(f"{c.removesuffix('_score')}_mean") for c in scores]
    rates = [F.avg(number(c)).alias(f"{c.removesuffix('_flag')}_rate") for c in flags]
    return sheet.groupBy(*groups).agg(F.count(F.lit(1)).alias("num_cases"), *means, *rates)


def overall_comparison(bertscore: DataFrame, core: DataFrame, audit: DataFrame, failures: DataFrame, key: str = "variant") -> DataFrame:
    """One row a system: BERTScore F1, core composite, manual quality (the mean of actionability and usefulness), rates of unsupported claims, redundancy and no failure.

    Systems are those of bertscore; what another summary lacks of them is null.
    """
    quality = (F.col("actionability_mean") + F.col("usefulness_mean")) / 2
    out = bertscore.select(key, "bertscore_f1")
    out = lookup(out, core.select(key, F.col("proxy_core_composite_mean").alias("proxy_core_composite")), [key], key, "left")
    out = lookup(out, audit.select(key, quality.alias("manual_quality_score"), "unsupported_claim_rate", "redundancy_rate"), [key], key, "left")
    return lookup(out, failures.select(key, "no_failure_rate"), [key], key, "left")


def with_model_names(scores: DataFrame, answers: DataFrame, key: str = "variant") -> DataFrame:
    """The scores with the (smallest) model name of their system, null for an unknown one."""
    names = answers.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("model_name").alias("model_name"))
    return lookup(scores, names, [key], key, "left")


def all_answers(*frames: DataFrame) -> DataFrame:
    """The rows of all frames; columns that one lacks are null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def markdown(df: DataFrame, max_rows: int = 1000) -> str:
    """A table of at most so many rows as Markdown; more rows are an error, since a report is read by people."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows for a report")
    said = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(said, r)) + " |" for r in rows)]) + "\n"
