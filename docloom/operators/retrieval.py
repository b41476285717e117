"""Exact vector retrieval and its re-rankings.

One operator compares questions and items in blocks, as products of matrices: a
bounded set of questions goes to every batch of the corpus, a larger one meets it in
a grid of blocks, each a task's worth. Every block keeps its k best of each question,
and a window that Spark limits before its shuffle keeps the k best of all. The
re-rankings work on arrays of at most fetch_k candidates, within one row a question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.vectors import dot, finite
from ..planning import lookup, small_enough

QUESTION_ROWS, QUESTION_BYTES = 20_000, 32 << 20  # of the questions that go to every batch
BLOCK = 4096  # questions or items of a block in a grid
DIGITS = 12  # to which scores are rounded, so that ties do not depend on how blocks are cut


@dataclass(frozen=True)
class RetrievalMode:
    """fetch_k candidates are ranked and final_k kept, at most max_per_source of a source; bonus: none, official or topic."""

    name: str
    fetch_k: int
    final_k: int = 3
    mmr_lambda: float | None = None
    max_per_source: int | None = None
    bonus: str = "none"
    official_bonus: float = 0.0
    enriched: bool = False


# The three modes
BASELINE = RetrievalMode("baseline_dense_top3", 3)
IMPROVED = RetrievalMode("improved_dense_mmr_top3", 10, mmr_lambda=0.7, max_per_source=2, bonus="official")
INTENT_ENRICHED = RetrievalMode("intent_enriched_dense_mmr_top3", 12, mmr_lambda=0.75, max_per_source=3, bonus="topic", enriched=True)
MODES = {m.name: m for m in (BASELINE, IMPROVED, INTENT_ENRICHED)}


def _matrix(vectors: pa.Array, size: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _best(asked: pa.Table, items: pa.Table, k: int, same: bool, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of items, rows of asked and scores: the k best items of each question, ties to the smaller id.

    asked: _id, _vector; items: _id, _vector. Only vectors of equal length are
    compared. same: whether an item may answer a question with its own id.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lengths = [t.column("_vector").combine_chunks().value_lengths().to_numpy() for t in (asked, items)]
    place = np.argsort(pa.compute.sort_indices(items.column("_id")).to_numpy())
    for size in np.intersect1d(*lengths):
        rows = [np.flatnonzero(n == size) for n in lengths]
        if not size:
            continue
        q, x = (_matrix(t.column("_vector").take(pa.array(r)).combine_chunks(), size) for t, r in zip((asked, items), rows))
        names = [np.array(t.column("_id").take(pa.array(r)).to_pylist(), dtype=object) for t, r in zip((asked, items), rows)] if not same else None
        for begin in range(0, len(q), 1024):
            scores = np.round(q[begin : begin + 1024] @ x.T, digits)
            if names is not None:
                scores[names[0][begin : begin + 1024, None] == names[1][None]] = -np.inf
            keep = min(k, len(x))
            edge = np.partition(scores, len(x) - keep, axis=1)[:, len(x) - keep]
            question, item = np.nonzero((scores >= edge[:, None]) & np.isfinite(scores))
            value = scores[question, item]
            order = np.lexsort((place[rows[1][item]], -value, question))
            question, item, value = question[order], item[order], value[order]
            first = np.arange(len(question)) - np.searchsorted(question, question) < k
            out.append((rows[1][item[first]], rows[0][begin + question[first]], value[first]))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_embedding", item_id: str = "chunk_id", item_vector: str = "embedding", same: bool = True, digits: int = DIGITS) -> DataFrame:
    """The k items most similar to each question: the columns of both sides but the question's vector, similarity_score and rank.

    Similarity is the dot product, rounded to so many digits; ties go to the smaller
    item id. Ids are unique on either side. Vectors that are null, empty or not
    finite neither ask nor are found, and those without a counterpart of the same
    length are not compared. same: whether an item may answer a question with its
    own id.
    """
    asked = queries.select(F.col(query_id).alias("_id"), F.col(query_vector).alias("_vector")).filter(finite(F.col("_vector")))
    items = corpus.filter(finite(F.col(item_vector)))
    about = queries.drop(query_vector)
    if small_enough(asked, QUESTION_ROWS, QUESTION_BYTES):
        found = _in_batches(asked, items, query_id, item_id, item_vector, k, same, digits)
    else:
        found = _in_grid(asked, items, query_id, item_id, item_vector, k, same, digits)
    order = Window.partitionBy(query_id).orderBy(F.desc("similarity_score"), F.asc(item_id))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if len(about.columns) > 1:
        ranked = ranked.join(about, query_id) if not small_enough(about) else ranked.join(F.broadcast(about), query_id)
    return ranked.select(*about.columns, *corpus.columns, "similarity_score", "rank")


def _in_batches(asked: DataFrame, items: DataFrame, query_id: str, item_id: str, item_vector: str, k: int, same: bool, digits: int) -> DataFrame:
    """What every batch of the items finds for questions that are bounded: query_id, the items' columns, similarity_score."""
    held = items.sparkSession.sparkContext.broadcast(asked.toArrow())  # QUESTION_ROWS and QUESTION_BYTES at most

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sides = pa.table({"_id": table.column(item_id), "_vector": table.column(item_vector)})
            item, question, score = _best(held.value, sides, k, same, digits)
            found = batch.take(pa.array(item))
            names = held.value.column("_id").take(pa.array(question)).combine_chunks()
            yield pa.RecordBatch.from_arrays([names, *found.columns, pa.array(score)], names=["_asked", *batch.schema.names, "similarity_score"])

    kind = dict(asked.dtypes)["_id"]
    schema = ", ".join([f"_asked {kind}", *(f"`{c}` {t}" for c, t in items.dtypes), "similarity_score double"])
    return items.mapInArrow(best, schema).withColumnRenamed("_asked", query_id)


def _in_grid(asked: DataFrame, items: DataFrame, query_id: str, item_id: str, item_vector: str, k: int, same: bool, digits: int) -> DataFrame:
    """The same for any number of questions: both sides in blocks, every two of which are a task; then the items' columns."""
    slim = items.select(F.col(item_id).alias("_id"), F.col(item_vector).alias("_vector"))
    rows, cols = (max(1, -(-df.count() // BLOCK)) for df in (slim, asked))
    block = lambda n: F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("*", block(cols).alias("_col"), every(rows).alias("_row"))
    right = slim.select("*", block(rows).alias("_row"), every(cols).alias("_col"))

    def best(questions: pa.Table, held: pa.Table) -> pa.Table:
        item, question, score = _best(questions, held, k, same, digits)
        return pa.table({"_asked": questions.column("_id").take(pa.array(question)), "_found": held.column("_id").take(pa.array(item)), "similarity_score": pa.array(score)})

    schema = f"_asked {dict(asked.dtypes)['_id']}, _found {dict(slim.dtypes)['_id']}, similarity_score double"
    pairs = left.groupBy("_row", "_col").cogroup(right.groupBy("_row", "_col")).applyInArrow(best, schema)
    order = Window.partitionBy("_asked").orderBy(F.desc("similarity_score"), F.asc("_found"))
    pairs = pairs.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k).drop("_at")
    return items.join(pairs, items[item_id] == pairs["_found"]).select(F.col("_asked").alias(query_id), *items.columns, "similarity_score")


def group_similarities(asked: DataFrame, told: DataFrame, group: str, key: str, threshold: float, vector: str = "embedding") -> DataFrame:
    """group, key, near, total, best of each question: how many vectors told in its group are near it, of how many, and the highest similarity.

    A group is cut into blocks on both sides, every two of which are a task, so a
    group that holds a third of all rows comes to no single one. Questions without
    a counterpart have no row; vectors that are not finite do not count.
    """
    sides = [df.select(F.col(group).alias("_group"), *(F.col(c).alias(n) for c, n in cols), F.col(vector).alias("_vector")).filter(finite(F.col("_vector"))) for df, cols in ((asked, ((key, "_key"),)), (told, ()))]
    blocks = [df.groupBy("_group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n)) for df, n in zip(sides, ("_cols", "_rows"))]
    grid = blocks[0].join(blocks[1], "_group")
    pick = lambda n, c: F.pmod(F.xxhash64("_vector", *c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lookup(sides[0], grid, ["_group"], "_key").select("_group", "_key", "_vector", pick("_cols", ["_key"]).alias("_col"), every("_rows").alias("_row"))
    right = lookup(sides[1], grid, ["_group"], "_vector").select("_group", "_vector", pick("_rows", []).alias("_row"), every("_cols").alias("_col"))

    def compare(questions: pa.Table, held: pa.Table) -> pa.Table:
        n = len(questions)
        near, total, best = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, -np.inf)
        lengths = [t.column("_vector").combine_chunks().value_lengths().to_numpy() for t in (questions, held)] if len(held) and n else [np.zeros(0), np.zeros(0)]
        for size in np.intersect1d(*lengths):
            q, x = (np.flatnonzero(m == size) for m in lengths)
            scores = np.round(_matrix(questions.column("_vector").take(pa.array(q)).combine_chunks(), size) @ _matrix(held.column("_vector").take(pa.array(x)).combine_chunks(), size).T, DIGITS)
            near[q], total[q], best[q] = (scores >= threshold).sum(axis=1), len(x), scores.max(axis=1)
        some = np.flatnonzero(total)
        return pa.table({"_group": questions.column("_group"), "_key": questions.column("_key"), "_near": near, "_total": total, "_best": best}).take(pa.array(some))

    kinds = dict(left.dtypes)
    cells = ("_group", "_row", "_col")
    parts = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(compare, f"_group {kinds['_group']}, _key {kinds['_key']}, _near bigint, _total bigint, _best double")
    return parts.groupBy(F.col("_group").alias(group), F.col("_key").alias(key)).agg(F.sum("_near").alias("near"), F.sum("_total").alias("total"), F.max("_best").alias("best"))


def mmr_order(candidates: Column, k: int | Column, weight: float | Column) -> Column:
    """Candidates (an array of structs with similarity_score and embedding, best first) by maximal marginal relevance.

    Each step takes the one with the highest weight * similarity - (1 - weight) *
    nearest taken; ties keep their order.
    """

    weight = weight if isinstance(weight, Column) else F.lit(weight)
    k = k if isinstance(k, Column) else F.lit(k)

    def step(state: Column, _: Column) -> Column:
        taken, left = state["taken"], state["left"]

        def value(c: Column) -> Column:
            near = F.array_max(F.transform(taken, lambda t: dot(c["embedding"], t["embedding"])))
            return F.when(F.size(taken) == 0, c["similarity_score"]).otherwise(weight * c["similarity_score"] - (1 - weight) * near)

        valued = F.transform(left, lambda c, i: F.struct(value(c).alias("v"), (-i).alias("o"), c.alias("c")))
        best = F.reduce(valued, F.get(valued, F.lit(0)), lambda a, b: F.when((b["v"] > a["v"]) | ((b["v"] == a["v"]) & (b["o"] > a["o"])), b).otherwise(a))
        more = F.size(left) > 0
        return F.struct(F.when(more, F.concat(taken, F.array(best["c"]))).otherwise(taken).alias("taken"), F.when(more, F.filter(left, lambda c, i: i != -best["o"])).otherwise(left).alias("left"))

    start = F.struct(F.slice(candidates, 1, 0).alias("taken"), candidates.alias("left"))
    return F.reduce(F.sequence(F.lit(1), k), start, step, lambda s: s["taken"])


def source_bonus(source: Column, bonus: float, official: tuple[str, ...] = C.OFFICIAL_SOURCES) -> Column:
    return F.when(source.isin(*official), F.lit(bonus)).otherwise(F.lit(0.0))


def topic_bonus(topic: Column, source: Column, path_text: Column, text: Column) -> Column:
    """A hundredth for each keyword of the topic in source, path and the text's beginning, three at most."""
    place = topic_place(source, path_text, text)
    other = F.size(F.filter(F.split(T.topic_words(topic), " ", -1), lambda k: F.contains(place, k)))
    hits = F.when(F.lit(False), F.lit(0))
    for known in C.TOPIC_KEYWORDS:
        hits = hits.when(topic == known, topic_hits(place, known))
    return bonus_of(hits.otherwise(other))


def topic_place(source: Column, path_text: Column, text: Column) -> Column:
    """Where a topic's keywords are looked for."""
    return F.lower(F.concat_ws(" ", source, path_text, F.left(text, F.lit(C.TOPIC_WINDOW))))


def topic_hits(place: Column, topic: str) -> Column:
    """How many keywords of a known topic are in a place, by plain searches."""
    hits = F.lit(0)
    for keyword in C.TOPIC_KEYWORDS[topic]:
        hits = hits + place.contains(keyword).cast("int")
    return hits


def bonus_of(hits: Column) -> Column:
    return F.least(F.lit(C.TOPIC_HIT_BONUS) * hits, F.lit(C.TOPIC_BONUS_CAP))


def cap_per_source(df: DataFrame, order: list, k: int | Column, cap: int | Column, query_id: str | list[str] = "query_id", source: str = "source_id") -> DataFrame:
    """k rows a question in rank order, at most cap of a source unless others run out."""
    keys = [query_id] if isinstance(query_id, str) else query_id
    by_rank = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumn("_place", F.row_number().over(by_rank))
    within = Window.partitionBy(*keys, source).orderBy("_place")
    over = (F.row_number().over(within) > cap).cast("int")
    final = Window.partitionBy(*keys).orderBy("_over", "_place")
    return placed.withColumn("_over", over).withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).drop("_place", "_over")


_ITEM = ("chunk_id", "source_id", "section_path_text", "source_url", "word_count", "text", "embedding")


def candidates(queries: DataFrame, corpus: DataFrame, k: int, own: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """query_id, topic, similarity_score, rank and the corpus columns of the k best items of each question.

    own: tells the one item that is the question itself and does not count.
    """
    asked = queries.select("query_id", "topic", "query_embedding")
    if own is not None:
        more = top_k(asked, corpus.select(*_ITEM), k + 1).filter(~own(F.col("query_id"), F.col("chunk_id")))
        order = Window.partitionBy("query_id").orderBy("rank")
        return more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "topic", "similarity_score", "rank", *_ITEM)
    return top_k(asked, corpus.select(*_ITEM), k).select("query_id", "topic", "similarity_score", "rank", *_ITEM)


def _mode_rows(modes: list[RetrievalMode]) -> Column:
    """An array of structs, one for each mode, with its parameters."""
    one = lambda m: F.struct(
        F.lit(m.name).alias("name"), F.lit(m.fetch_k).alias("fetch_k"), F.lit(m.final_k).alias("final_k"), F.lit(m.mmr_lambda).cast("double").alias("mmr_lambda"), F.lit(m.max_per_source or m.final_k).alias("cap"),
        F.lit(m.bonus).alias("bonus"), F.lit(m.official_bonus).alias("official_bonus"), F.lit(m.enriched).alias("enriched"),
    )
    return F.array(*map(one, modes))


def rerank(found: DataFrame, *modes: RetrievalMode, enriched: str | None = None) -> DataFrame:
    """The rows of the modes, all in one pass, from candidates of at least their fetch_k ranks.

    enriched: a column that tells whether candidates are of the enriched question;
    without it they serve every mode.
    """
    kept = [enriched] if enriched else []
    met = found.select("query_id", "topic", "rank", "similarity_score", *_ITEM, *kept, F.explode(_mode_rows(list(modes))).alias("_m")).filter(F.col("rank") <= F.col("_m.fetch_k"))
    if enriched:
        met = met.filter(F.col(enriched) == F.col("_m.enriched"))
    listed = met.groupBy("query_id", "topic", "_m").agg(F.array_sort(F.collect_list(F.struct("rank", "similarity_score", *_ITEM))).alias("_c"))  # fetch_k candidates at most
    weight = F.col("_m.mmr_lambda")
    ordered = F.when(weight.isNull(), F.col("_c")).otherwise(mmr_order(F.col("_c"), F.col("_m.fetch_k"), weight))
    rows = listed.select("query_id", "topic", "_m", F.posexplode(ordered).alias("_at", "_i")).select("query_id", "topic", "_m", (F.col("_at") + 1).alias("mmr_rank"), "_i.*")
    topical = topic_bonus(F.col("topic"), F.col("source_id"), F.col("section_path_text"), F.col("text"))
    official = F.when(F.col("source_id").isin(*C.OFFICIAL_SOURCES), F.col("_m.official_bonus")).otherwise(F.lit(0.0))
    extra = F.when(F.col("_m.bonus") == "topic", topical).when(F.col("_m.bonus") == "official", official).otherwise(F.lit(0.0))
    scored = rows.drop("rank").withColumn("rerank_score", F.col("similarity_score") + extra).withColumn("retrieval_mode", F.col("_m.name"))
    order = [F.desc("rerank_score"), F.desc("similarity_score"), F.asc("mmr_rank"), F.asc("chunk_id")]
    ranked = cap_per_source(scored, order, F.col("_m.final_k"), F.col("_m.cap"), ["query_id", "retrieval_mode"])
    return ranked.select("query_id", "retrieval_mode", "rank", "chunk_id", "source_id", "similarity_score", "rerank_score", F.col("text").alias("chunk_text"), "section_path_text", "source_url", "word_count")


def retrieve(queries: DataFrame, corpus: DataFrame, mode: RetrievalMode) -> DataFrame:
    """query_id, rank, chunk_id, source_id, similarity_score, rerank_score, ... of one mode.

    queries: query_id, topic, query_embedding (of the enriched text for a mode that
    wants it); corpus: chunk_id, source_id, section_path_text, source_url,
    word_count, text, embedding. Null vectors neither ask nor are found.
    """
    return rerank(candidates(queries, corpus, mode.fetch_k), mode)


def run_variants(queries: DataFrame, corpus: DataFrame, variants: DataFrame, own: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Each mode once, its rows handed to the variants that use it; queries have query_embedding and enriched_embedding.

    Both vectors of every question ask in one pass over the corpus. own: tells an
    item that is the question itself, by query_id and chunk_id.
    """
    asks = [queries.select(F.concat(F.lit(f"{int(e)}:"), "query_id").alias("query_id"), "topic", F.col(c).alias("query_embedding")) for e, c in ((False, "query_embedding"), (True, "enriched_embedding"))]
    both = candidates(asks[0].unionByName(asks[1]), corpus, max(m.fetch_k for m in MODES.values()), own and (lambda query, chunk: own(F.substring(query, 3, 1 << 30), chunk)))
    marked = both.withColumn("_enriched", F.col("query_id").startswith("1:")).withColumn("query_id", F.substring("query_id", 3, 1 << 30))
    rows = rerank(marked, *MODES.values(), enriched="_enriched")
    known = F.array(*map(F.lit, MODES))
    checked = variants.withColumn("retrieval_mode", F.when(F.array_contains(known, F.col("retrieval_mode")), F.col("retrieval_mode")).otherwise(F.raise_error(F.concat(F.lit("unknown retrieval mode: "), "retrieval_mode"))))
    meta = queries.select("query_id", "query_text", "topic", "difficulty")
    handed = rows.join(F.broadcast(checked) if small_enough(variants) else checked, "retrieval_mode")
    return handed.join(F.broadcast(meta) if small_enough(meta) else meta, "query_id")


def retrieval_summary(results: DataFrame) -> DataFrame:
    """Rows, questions, mean scores and distinct sources by variant and mode."""
    return results.groupBy("variant", "retrieval_mode").agg(F.count(F.lit(1)).alias("num_rows"), F.count_distinct("query_id").alias("num_queries"), F.avg("similarity_score").alias("avg_similarity"), F.avg("rerank_score").alias("avg_rerank"), F.count_distinct("source_id").alias("unique_sources"))


def source_concentration(results: DataFrame) -> DataFrame:
    return results.groupBy("variant", "source_id").agg(F.count(F.lit(1)).alias("num_rows"))
