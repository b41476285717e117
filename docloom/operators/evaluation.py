"""Evaluation of answers: cases, metrics, proxies and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.vectors import clamp01, dot

JUDGED = ("context_relevance", "answer_relevance", "faithfulness", "context_precision", "context_recall")
BERTSCORE = ("bertscore_p", "bertscore_r", "bertscore_f1")
# Labels of failures
FAILURE_LABELS = ("retrieval_miss", "source_imbalance", "incomplete_answer", "hallucinated_or_weakly_grounded_claim", "outdated_or_mismatched_context")


def blueprint(topics: DataFrame) -> DataFrame:
    """Ten blank questions for each topic (column topic), with ids in topic order."""
    pattern = F.array(*map(F.lit, C.DIFFICULTY_PATTERN))
    names = topics.agg(F.array_sort(F.collect_set("topic")).alias("_names"))  # a topic is a heading of a benchmark that people write
    numbered = names.select(F.posexplode("_names").alias("_t", "topic")).withColumn("_t", F.col("_t") + 1)
    slots = numbered.select("topic", "_t", F.posexplode(pattern).alias("_s", "difficulty"))
    number = ((F.col("_t") - 1) * len(C.DIFFICULTY_PATTERN) + F.col("_s") + 1).cast("string")
    pad = lambda c, n: F.lpad(c, n, "0")
    blanks = [F.lit("").alias(c) for c in ("query_text", "reference_answer", "review_status", "draft_source", "notes")]
    return slots.select(F.concat(F.lit("Q"), F.when(F.length(number) < 3, pad(number, 3)).otherwise(number)).alias("query_id"), "topic", "difficulty", F.concat("topic", F.lit("__"), pad((F.col("_s") + 1).cast("string"), 2)).alias("topic_slot"), *blanks)


def reviewed_benchmark(bank: DataFrame, per_topic: int = len(C.DIFFICULTY_PATTERN)) -> DataFrame:
    """The questions of a bank (topic, slot from 1, query_text, reference_answer) as a benchmark with ids, difficulties and review marks.

    Every topic needs exactly the slots 1 to per_topic, else the result is an error.
    """
    pattern = F.array(*map(F.lit, C.DIFFICULTY_PATTERN))
    entry = F.struct("slot", "query_text", "reference_answer")
    topics = bank.groupBy("topic").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    whole = F.transform("_e", lambda e: e["slot"].cast("int")) == F.sequence(F.lit(1), F.lit(per_topic))
    said = F.concat(F.lit("not the required entries in topic "), "topic")
    checked = topics.withColumn("_e", F.when(whole, F.col("_e")).otherwise(F.raise_error(said)))
    places = checked.agg(F.array_sort(F.collect_list(F.struct("topic", "_e"))).alias("_t")).select(F.posexplode("_t").alias("_i", "_t"))  # topics are headings that people write
    rows = places.select("_i", "_t.topic", F.posexplode("_t._e").alias("_s", "_q"))
    number = (F.col("_i") * per_topic + F.col("_s") + 1).cast("string")
    return rows.select(
        F.concat(F.lit("Q"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("query_id"), "topic", F.get(pattern, F.col("_s")).alias("difficulty"), F.concat("topic", F.lit("__"), F.lpad((F.col("_s") + 1).cast("string"), 2, "0")).alias("topic_slot"),
        "_q.query_text", "_q.reference_answer", F.lit("reviewed_seed").alias("review_status"), F.lit("structured_seed_then_manual_refinement").alias("draft_source"), F.lit("").alias("notes"),
    )


def failure_template(spark, n: int = 12) -> DataFrame:
    """n blank rows for a failure analysis."""
    number = F.lpad(F.col("id").cast("string"), 2, "0")
    return spark.range(1, n + 1).select(F.concat(F.lit("F"), number).alias("case_id"), *(F.lit("").alias(c) for c in ("query_id", "variant", "failure_label", "notes")))


def metric_placeholder(queries: DataFrame, variants: DataFrame) -> DataFrame:
    """A row of null metrics for each question and variant."""
    blanks = [F.lit(None).cast("double").alias(c) for c in (*JUDGED, *BERTSCORE)]
    # one row that holds all variants: a generator instead of a join, however many there are
    named = variants.agg(F.collect_list("variant").alias("_v"))
    return queries.select("query_id").crossJoin(F.broadcast(named)).select("query_id", F.explode("_v").alias("variant"), *blanks)


def merge_metrics(base: DataFrame, *frames: DataFrame) -> DataFrame:
    """base with the metrics of the frames joined by query and variant; a value there replaces the one before, a null does not."""
    merged = base
    for frame in frames:
        new = [c for c in frame.columns if c not in ("query_id", "variant")]
        renamed = frame.select("query_id", "variant", *(F.col(c).alias(f"_new_{c}") for c in new))
        joined = merged.join(renamed, ["query_id", "variant"], "left")
        merged = joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in merged.columns), *(F.col(f"_new_{c}").alias(c) for c in new if c not in merged.columns))
    return merged


def checked_labels(df: DataFrame, column: str = "failure_label") -> DataFrame:
    """The rows, an error for a label that is none of FAILURE_LABELS; blanks are rows yet to be labelled."""
    known = F.coalesce(F.col(column), F.lit("")).isin("", *FAILURE_LABELS)
    return df.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown failure label: "), column))))


def asserted(df: DataFrame, there: Column, what: str, *keys: str) -> DataFrame:
    """The rows, an error for one in which ``there`` is false: a look-up that found nothing."""
    said = F.concat(F.lit(f"{what} is missing for "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    return df.withColumn(keys[0], F.when(there, F.col(keys[0])).otherwise(F.raise_error(said)))


def retrieval_variant(variant: Column) -> Column:
    """The retrieval variant of a system: its name without the prefix of its model's initials."""
    return F.regexp_replace(variant, "^[A-Z]+_(?=V)", "")


def evaluation_cases(answers: DataFrame, queries: DataFrame, retrieved: DataFrame, strict: bool = False) -> DataFrame:
    """Each answer with its question, reference and what was retrieved for it, in rank order.

    Answers whose question or retrieval is unknown are left out; an error if strict.
    """
    ranked = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "source_id", "section_path_text", "chunk_text")))
    context = retrieved.groupBy("query_id", "variant").agg(ranked.alias("_c")).select(
        "query_id", "variant", F.transform("_c", lambda c: c["chunk_id"]).alias("retrieved_chunk_ids"), F.transform("_c", lambda c: c["source_id"]).alias("retrieved_source_ids"),
        T.evaluation_context(F.col("_c")).alias("retrieved_context_text"), F.transform("_c", lambda c: c["chunk_text"]).alias("contexts"),
    )
    about = queries.select("query_id", "topic", "difficulty", "query_text", "reference_answer")
    if strict:
        known = about.withColumn("_asked", F.lit(True))
        joined = asserted(answers.join(known, "query_id", "left"), F.col("_asked").isNotNull(), "the question", "query_id", "variant")
        joined = asserted(joined.join(context.withColumn("_told", F.lit(True)), ["query_id", "variant"], "left"), F.col("_told").isNotNull(), "the retrieval", "query_id", "variant")
    else:
        joined = answers.join(about, "query_id").join(context, ["query_id", "variant"])
    return joined.select("query_id", "variant", "model_name", "topic", "difficulty", "query_text", "reference_answer", "answer_text", "answer_text_plain", "citations", "retrieved_chunk_ids", "retrieved_source_ids", "retrieved_context_text", "contexts")


def run_plan(cases: DataFrame, run_bertscore: bool, run_judge: bool, bertscore_model: str, judge_model: str) -> DataFrame:
    """One row: what is to be run on how many cases and variants."""
    return cases.agg(F.lit(run_bertscore).alias("run_bertscore"), F.lit(run_judge).alias("run_ragas"), F.count(F.lit(1)).alias("num_evaluation_cases"), F.count_distinct("variant").alias("num_variants"), F.lit(bertscore_model).alias("bertscore_model_type"), F.lit(judge_model).alias("ragas_judge_model"))


def citations_valid(cited: Column, retrieved: Column) -> Column:
    """Whether there are citations and all of them were retrieved."""
    return F.coalesce((F.size(cited) > 0) & (F.size(F.array_except(cited, retrieved)) == 0), F.lit(False))


def citation_share(cited: Column, retrieved: Column) -> Column:
    """The share of the citations that were retrieved, 0 without any."""
    valid = F.size(F.filter(cited, lambda c: F.array_contains(retrieved, c)))
    return F.round(F.coalesce(F.try_divide(valid, F.nullif(F.size(cited), F.lit(0))), F.lit(0.0)), 4)


def citation_frame(cases: DataFrame) -> DataFrame:
    return cases.select("query_id", "variant", F.size("retrieved_chunk_ids").alias("num_retrieved_chunk_ids"), F.size("citations").alias("num_citations"), citations_valid(F.col("citations"), F.col("retrieved_chunk_ids")).alias("citation_valid"))


def context_relevance(question: Column, sentences: Column) -> Column:
    """The share of context sentences (vectors) near the question's vector, 0 without any."""
    near = F.filter(sentences, lambda s: dot(question, s) >= C.CONTEXT_THRESHOLD)
    return F.round(F.coalesce(F.try_divide(F.size(near), F.nullif(F.size(sentences), F.lit(0))), F.lit(0.0)), 4)


def answer_relevance(question: Column, answer: Column) -> Column:
    """The similarity of question and answer within 0 and 1; 0 without an answer."""
    return F.round(F.coalesce(clamp01(dot(question, answer)), F.lit(0.0)), 4)


def faithfulness(answer: Column, context: Column) -> Column:
    """The share of answer sentences that some context sentence is near to, 0 without any."""
    grounded = F.filter(answer, lambda a: F.exists(context, lambda c: dot(a, c) >= C.FAITHFUL_THRESHOLD))
    return F.round(F.coalesce(F.try_divide(F.size(grounded), F.nullif(F.size(answer), F.lit(0))), F.lit(0.0)), 4)


def proxy_composite(*scores: Column) -> Column:
    """The mean of the scores, to four places."""
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return F.round(total / len(scores), 4)


def core_composite(*scores: Column) -> Column:
    """The mean of the scores that are there."""
    there = F.array_compact(F.array(*scores))
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.nullif(F.size(there), F.lit(0)))


def token_match_scores(cases: DataFrame, answer_col: str = "answer_text_plain", reference_col: str = "reference_answer") -> DataFrame:
    """query_id, variant, bertscore_p, r, f1 by exact token matches: the offline stand-in of a learned matcher."""
    tokens = lambda c: F.filter(F.split(F.lower(T.strip_citations(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    said, wanted = tokens(F.col(answer_col)), tokens(F.col(reference_col))
    share = lambda a, b: F.coalesce(F.try_divide(F.size(F.filter(a, lambda w: F.array_contains(b, w))), F.nullif(F.size(a), F.lit(0))), F.lit(0.0))
    p, r = share(said, wanted), share(wanted, said)
    scored = cases.select("query_id", "variant", p.alias("bertscore_p"), r.alias("bertscore_r"))
    f1 = F.coalesce(F.try_divide(2 * F.col("bertscore_p") * F.col("bertscore_r"), F.nullif(F.col("bertscore_p") + F.col("bertscore_r"), F.lit(0.0))), F.lit(0.0))
    return scored.withColumn("bertscore_f1", f1)


def metric_means(df: DataFrame, group: str, metrics: tuple[str, ...] = (*JUDGED, *BERTSCORE)) -> DataFrame:
    """Cases and means by group, null groups kept; metrics that df lacks are passed over."""
    present = [m for m in metrics if m in df.columns]
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("num_cases"), *(F.avg(m).alias(m) for m in present))


def mean_and_spread(df: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """Cases, mean and sample deviation of each metric by group."""
    sums = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("num_cases"), *sums)


def duplicate_answers(df: DataFrame, group: str = "query_id", answer_col: str = "answer_text_plain") -> DataFrame:
    """Answers, distinct ones and the difference by group, answers compared by their normalised form."""
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("num_answers"), F.count_distinct(T.answer_key(F.col(answer_col))).alias("num_unique_answers"))
    return counted.withColumn("duplicate_answers", F.col("num_answers") - F.col("num_unique_answers"))


def duplicate_rate(summary: DataFrame) -> DataFrame:
    """The share of all answers that are duplicates, null without answers."""
    return summary.agg(F.try_divide(F.sum("duplicate_answers"), F.nullif(F.sum("num_answers"), F.lit(0))).alias("duplicate_answer_rate"))


def win_counts(df: DataFrame, case: str, system: str, score: str) -> DataFrame:
    """How often each system has a case's highest score; ties win all, systems without a win have 0."""
    best = df.filter(F.col(score).isNotNull()).groupBy(case).agg(F.max(score).alias("_best"))
    won = df.join(best, case).filter(F.col(score) == F.col("_best"))
    wins = won.groupBy(system).agg(F.count(F.lit(1)).alias("win_count"))
    return df.select(system).distinct().join(wins, system, "left").select(system, F.coalesce("win_count", F.lit(0)).alias("win_count"))


def judge_summary(df: DataFrame, system: str = "variant", error: str = "ragas_error") -> DataFrame:
    """Means, deviations and the number of errors by system."""
    sums = [a for m in JUDGED for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return df.groupBy(system).agg(*sums, F.count(error).alias("error_count"))


def deep_dive(df: DataFrame, contexts: str, sources: str, slots: int = 3) -> DataFrame:
    """The first contexts and sources in columns of their own, empty where there are fewer."""
    def slot(c: str, i: int) -> Column:
        return F.coalesce(F.get(F.col(c), F.lit(i)), F.lit(""))

    return df.select("*", *(slot(contexts, i).alias(f"context_{i + 1}") for i in range(slots)), *(slot(sources, i).alias(f"source_{i + 1}") for i in range(slots)))


def order_of(column: Column, order: list[str]) -> Column:
    """A value's place in a given order, the one after the last for unknown values."""
    place = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(place == 0, len(order) + 1).otherwise(place)


def with_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows sorted by a column's place in a given order, unknown values last."""
    return df.orderBy(order_of(F.col(column), order), column)
