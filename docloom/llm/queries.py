"""The queries of the operators in this package, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leaks, neardup, pairs, quality, rankfuse, repeated, split, subjects, tokenize, vectors
from ._plan import broadcast_if_small
from .sql import ORACLES as ORACLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, hard_cut of each oversized document."""
    plans = split.split_documents(table(spark, folder, "documents"), with_text=False)
    return plans.filter("oversized").select("doc_id", "hard_cut")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of all documents."""
    return split.piece_rows(table(spark, folder, "documents"))


FOUND_DUPLICATES = neardup.DuplicateConfig(shingle=3, threshold=0.6, min_words=20, rows=5, bands=50)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_a, doc_b of all pairs of near-equal texts: three words, similarity 0.6."""
    return neardup.near_duplicate_pairs(table(spark, folder, "documents"), config=FOUND_DUPLICATES).select("doc_a", "doc_b")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's group of near-duplicates: five words, similarity 0.8."""
    return neardup.near_duplicate_groups(table(spark, folder, "documents"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, form of each document that is a list, a table or junk."""
    return p3_statistics(spark, folder).filter("form <> 'prose'").select("doc_id", "form")


def p3_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics and form of every document."""
    return quality.describe(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p3_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of words and repetition of every document, of those that SQL can tell too."""
    told = p3_statistics(spark, folder).filter("words is not null")
    return told.select("doc_id", "words", *(F.round(c, 6).alias(c) for c in ("mean_word_length", "repeated_line_share")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, line_no of each line that recurs within its source."""
    return repeated.repeated_lines(table(spark, folder, "documents"))


def p4_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's text without the lines that recur within its source."""
    return repeated.without_repeated_lines(table(spark, folder, "documents"))


def latest_scores(spark: SparkSession, folder: str) -> DataFrame:
    """variant, bertscore_f1: the mean over queries of the score made last."""
    last = table(spark, folder, "bertscore_results").groupBy("variant", "query_id").agg(F.max_by("bertscore_f1", "scored_at").alias("f1"))
    return last.filter(F.col("f1").isNotNull() & ~F.isnan("f1")).groupBy("variant").agg(F.avg("f1").alias("bertscore_f1"))


SCORES = ("context_relevance_proxy_mean", "faithfulness_proxy_mean", "citation_validity_mean", "bertscore_f1")


def _variants(spark: SparkSession, folder: str) -> DataFrame:
    proxies = table(spark, folder, "proxy_eval_summary_by_variant").select("variant", *SCORES[:3])
    return proxies.join(latest_scores(spark, folder), "variant", "left")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """variant: the first twentieth of the variants that have all four scores."""
    whole = _variants(spark, folder)
    for s in SCORES:
        whole = whole.filter(F.col(s).isNotNull() & ~F.isnan(s))
    ranking = rankfuse.borda_ranking(whole, "variant", dict.fromkeys(SCORES, 1.0))
    first = ranking.agg(F.floor(F.count(F.lit(1)) / 20).alias("_first"))
    return ranking.join(F.broadcast(first), F.col("position") <= F.col("_first")).select("variant")


def p5_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """All variants in one ranking; a missing score counts as the middle rank."""
    return rankfuse.borda_ranking(_variants(spark, folder), "variant", dict.fromkeys(SCORES, 1.0))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, embedding, embedding_dimension: the one that the vector's snapshot has."""
    dimensions = table(spark, folder, "summary").select("snapshot_id", "embedding_dimension").distinct()
    return table(spark, folder, "embedding_records").select("vec_id", "snapshot_id", "embedding").join(broadcast_if_small(dimensions, 10_000), "snapshot_id")


def p6_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar vectors of each vector, from cosine 0.85 on."""
    return vectors.nearest(_vectors(spark, folder)).select("vec_id", "neighbour", F.round("cosine", 6).alias("cosine"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """vec_a, vec_b of the pairs in which either is among the other's 5 most similar."""
    return vectors.mutual_pairs(vectors.nearest(_vectors(spark, folder))).select("vec_a", "vec_b")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """result_id, defect of each answer that is no proper answer."""
    return pairs.defective_pairs(*(table(spark, folder, t) for t in ("generation_results_smoke_v1", "evaluation_queries_blueprint", "common_words")))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids of every document."""
    return tokenize.encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, item_id of each evaluation item that leaked into a document."""
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))


def p9_near(spark: SparkSession, folder: str) -> DataFrame:
    """The same, but for one inserted, dropped or replaced word in the passage."""
    return leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "heldout_items"), config=leaks.LeakConfig(edits=1))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, subject of each subject that a document is about."""
    return subjects.document_subjects(*(table(spark, folder, t) for t in ("documents", "doc_labels", "subject_areas", "common_words")))


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by subject."""
    return p10_found(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_groups, p3_found, p3_statistics, p3_repetition, p4_found, p4_cleaned, p5_found, p5_ranking, p6_found, p6_neighbours, p7_found, p8_ids, p9_found, p9_near, p10_found, p10_composition)
}
