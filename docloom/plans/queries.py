"""The registered queries of the core operators and the SQL they must agree with.

Every query reads its whole tables. Searches ask for the rows whose id is divisible
by 20 against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import quality
from ..functions import text as T
from ..functions.vectors import norm
from ..operators import chunking, evaluation, generation, retrieval, sampling, summaries
from ..operators.embedding import HashingEmbedder, embedding_records, embedding_summary
from ..planning import once, spread
from ..sources import feed, html, pages
from ..sources.tables import vector_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, dealt out to all cores where a few files hold them all."""
    return spread(table(spark, folder, "documents"))


# --- SQL fragments -------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ws(x: str) -> str:
    return f"trim(regexp_replace({x}, {_q(C.SPACE + '+')}, ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'^{C.SPACE}+|{C.SPACE}+$')}, '', 'g')"


def _slug(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'untitled')"


def _parts(x: str, ends: str) -> str:
    """The pieces of a collapsed text; the separator goes in where look-around would split."""
    marked = f"regexp_replace({x}, {_q(f'({ends}) ({C.SENTENCE_START})')}, '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def _words(x: str) -> str:
    """Words of a collapsed text."""
    return f"(case when {x} = '' then 0 else len(string_split({x}, ' ')) end)"


def _dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


_TOPIC_ROWS = ", ".join(f"({_q(t)}, [{', '.join(map(_q, k))}])" for t, k in C.TOPIC_KEYWORDS.items())
_CITED = r"regexp_extract_all(answer_text, '\[([^\]]+)\]', 1)"
_CITATIONS = f"coalesce(list_filter(list_transform(string_split({_CITED}[-1], ','), lambda x: {_strip('x')}), lambda x: x <> ''), [])"
_PLAIN = _ws(r"regexp_replace(answer_text, '\[[^\]]+\]', '', 'g')")

# --- retrieval ----------------------------------------------------------------------

_SEARCH = f"""
with met as (
  select q.vec_id as query_id, c.vec_id, c.label, round({_dot('q.embedding', 'c.embedding')}, 6) as similarity
  from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), ranked as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from met)
"""


def _search(spark: SparkSession, folder: str, k: int) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    found = retrieval.top_k(asked, vectors, k, item_id="vec_id", same=False, digits=6)
    return found.select("query_id", "vec_id", "label", F.col("similarity_score").alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(_SEARCH + "select query_id, vec_id, similarity, rank from ranked where rank <= 3")
def dense_top3(spark, folder):
    """The three vectors most similar to each question."""
    return _search(spark, folder, 3).select("query_id", "vec_id", "similarity", "rank")


@query(
    _SEARCH
    + """, ten as (select * from ranked where rank <= 10), capped as (select *, (row_number() over (partition by query_id, label order by rank) > 2)::INT as over from ten),
final as (select *, row_number() over (partition by query_id order by over, rank) as place from capped)
select query_id, vec_id, label::BIGINT as source, similarity, place as rank from final where place <= 3"""
)
def improved_top3_source_cap(spark, folder):
    """Ten candidates, at most two of a source, the best three."""
    ten = _search(spark, folder, 10).withColumnRenamed("rank", "_r")
    kept = retrieval.cap_per_source(ten, [F.col("_r")], 3, 2, source="label")
    return kept.select("query_id", "vec_id", F.col("label").cast("long").alias("source"), "similarity", F.col("rank").cast("long").alias("rank"))


@query(
    _SEARCH
    + """, ten as (select *, round(similarity + case when label in (1, 4, 7) then 0.02 else 0 end, 6) as rerank from ranked where rank <= 10),
final as (select *, row_number() over (partition by query_id order by rerank desc, similarity desc, rank) as place from ten)
select query_id, vec_id, similarity, rerank, place as rank from final where place <= 3"""
)
def source_bonus_rerank(spark, folder):
    """Candidates of official sources are moved up by a bonus."""
    ten = _search(spark, folder, 10).withColumn("rerank", F.round(F.col("similarity") + retrieval.source_bonus(F.col("label").cast("string"), 0.02, ("1", "4", "7")), 6)).withColumnRenamed("rank", "_r")
    kept = retrieval.cap_per_source(ten, [F.desc("rerank"), F.desc("similarity"), F.asc("_r")], 3, 3, source="label")
    return kept.select("query_id", "vec_id", "similarity", "rerank", F.col("rank").cast("long").alias("rank"))


def _mmr(ranked: str, name: str, fetch: int, weight: float) -> str:
    """CTEs that order candidates (query_id, vec_id, sim, rank) by maximal marginal relevance: name(query_id, place, vec_id)."""
    return f"""{name}_c as (select query_id, list(vec_id order by rank) as ids, list(sim order by rank) as sims, list(e order by rank) as es from (select r.*, embedding::DOUBLE[] as e from {ranked} r join embeddings v using (vec_id) where rank <= {fetch}) group by query_id),
{name}_s as (select query_id, ids, sims, es, []::BIGINT[] as taken from {name}_c union all
  select query_id, ids, sims, es, list_append(taken, list_position(v, list_max(v))::BIGINT) from (select *, list_transform(range(1, len(ids) + 1), lambda i: case when list_contains(taken, i) then -1e9 when len(taken) = 0 then sims[i] else {weight} * sims[i] - (1 - {weight}::DOUBLE) * list_max(list_transform(taken, lambda t: list_dot_product(es[i], es[t]))) end) as v from {name}_s where len(taken) < len(ids))),
{name} as (select query_id, unnest(range(1, len(taken) + 1)) as place, unnest(list_transform(taken, lambda t: ids[t])) as vec_id, unnest(list_transform(taken, lambda t: sims[t])) as sim from {name}_s where len(taken) = len(ids))"""


_EXACT = f"""met as (select q.vec_id as query_id, c.vec_id, c.label, {_dot('q.embedding', 'c.embedding')} as sim from embeddings q join embeddings c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by round(sim, 12) desc, vec_id) as rank from met)"""


@query(f"with recursive {_EXACT}, {_mmr('ranked', 'm', 10, 0.7)} select query_id, place::BIGINT as mmr_rank, vec_id, round(sim, 6) as similarity from m")
def mmr_top10(spark, folder):
    """Ten candidates of each question in the order of maximal marginal relevance."""
    vectors = table(spark, folder, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    ten = retrieval.top_k(asked, vectors, 10, item_id="vec_id", same=False)
    listed = ten.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "similarity_score", "vec_id", "embedding"))).alias("_c"))
    ordered = listed.select("query_id", F.posexplode(retrieval.mmr_order(F.col("_c"), 10, 0.7)).alias("_at", "_i"))
    return ordered.select("query_id", (F.col("_at") + 1).cast("long").alias("mmr_rank"), "_i.vec_id", F.round("_i.similarity_score", 6).alias("similarity"))


@query(
    _SEARCH
    + """select 'V1' as variant, 'baseline_dense_top3' as retrieval_mode, count(*) as num_rows, count(distinct query_id) as num_queries, round(avg(similarity), 6) as avg_similarity, count(distinct label) as unique_sources from ranked where rank <= 3"""
)
def retrieval_summary(spark, folder):
    """Rows, questions, mean similarity and sources of the dense search."""
    rows = _search(spark, folder, 3).select(F.lit("V1").alias("variant"), F.lit("baseline_dense_top3").alias("retrieval_mode"), "query_id", F.col("similarity").alias("similarity_score"), F.col("similarity").alias("rerank_score"), F.col("label").alias("source_id"))
    return retrieval.retrieval_summary(rows).select("variant", "retrieval_mode", "num_rows", "num_queries", F.round("avg_similarity", 6).alias("avg_similarity"), "unique_sources")


@query(_SEARCH + "select 'V1' as variant, label::BIGINT as source_id, count(*) as num_rows from ranked where rank <= 3 group by label")
def source_concentration(spark, folder):
    """Rows of the dense search by source."""
    rows = _search(spark, folder, 3).select(F.lit("V1").alias("variant"), F.col("label").cast("long").alias("source_id"))
    return retrieval.source_concentration(rows)


@query(
    f"""with topics(topic, keywords) as (values {_TOPIC_ROWS}),
place as (select doc_id, lower(concat_ws(' ', source_id, array_to_string(list_filter(list_transform(section_path, lambda p: {_ws('p')}), lambda p: p <> ''), ' > '), left(text, {C.TOPIC_WINDOW}))) as hay from documents where text is not null),
hit as (select doc_id, topic, len(list_filter(keywords, lambda k: contains(hay, k))) as hits from place cross join topics)
select doc_id, topic, round(least({C.TOPIC_HIT_BONUS} * hits, {C.TOPIC_BONUS_CAP})::DOUBLE, 6) as bonus from hit where hits > 0"""
)
def topic_bonus(spark, folder):
    """The bonus of each document for each topic that it touches."""
    docs = documents(spark, folder).filter("text is not null").select("doc_id", "source_id", "section_path", "text")
    path = F.when(F.col("section_path").isNotNull(), T.join_path(F.col("section_path")))
    placed = once(docs, _place=retrieval.topic_place(F.col("source_id"), path, F.col("text"))).select("doc_id", "_place")
    hits = F.array(*(F.struct(F.lit(t).alias("topic"), retrieval.topic_hits(F.col("_place"), t).alias("hits")) for t in C.TOPIC_KEYWORDS))
    rows = placed.select("doc_id", F.inline(hits)).filter("hits > 0")
    return rows.select("doc_id", "topic", F.round(retrieval.bonus_of(F.col("hits")), 6).alias("bonus"))


@query(
    f"""with topics(topic, keywords) as (values {_TOPIC_ROWS})
select query_id, {_q(C.QUERY_PREFIX + ' Topic: ')} || replace(q.topic, '_', ' ') || '. Difficulty: ' || difficulty || '. Relevant concepts: ' || array_to_string(coalesce(keywords, string_split(replace(q.topic, '_', ' '), ' ')), ', ') || '. Question: ' || query_text as enriched
from evaluation_queries_blueprint q left join topics t on q.topic = t.topic"""
)
def intent_query_text(spark, folder):
    """Each question with its topic's concepts spelt out."""
    return table(spark, folder, "evaluation_queries_blueprint").select("query_id", T.enriched_query(F.col("topic"), F.col("difficulty"), F.col("query_text")).alias("enriched"))


_MODE_NAMES = {"baseline": "baseline_dense_top3", "improved": "improved_dense_mmr_top3", "intent_enriched": "intent_enriched_dense_mmr_top3"}


def _hashed_corpus(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    records = embedding_records(chunking.chunk_documents(docs))
    return HashingEmbedder(64).transform(records, "retrieval_text").filter("embedding is not null")


@query(f"""with recursive {_EXACT}, {_mmr('ranked', 'a', 10, 0.7)}, {_mmr('ranked', 'b', 12, 0.75)},
every as (select 'baseline_dense_top3' as mode, query_id, vec_id, sim, rank as place, 3 as cap from ranked where rank <= 3 union all select 'improved_dense_mmr_top3', query_id, vec_id, sim, place, 2 from a union all select 'intent_enriched_dense_mmr_top3', query_id, vec_id, sim, place, 3 from b),
placed as (select e.*, v.label, row_number() over (partition by mode, query_id order by round(sim, 12) desc, place) as p from every e join embeddings v using (vec_id)),
capped as (select *, (row_number() over (partition by mode, query_id, label order by p) > cap)::INT as over from placed),
final as (select *, row_number() over (partition by mode, query_id order by over, p) as rank from capped)
select v as variant, mode as retrieval_mode, query_id::VARCHAR as query_id, rank, vec_id::VARCHAR as chunk_id, label::VARCHAR as source_id, round(sim, 6) as similarity_score, round(sim, 6) as rerank_score from final join (values ('V1', 'baseline_dense_top3'), ('V2', 'improved_dense_mmr_top3'), ('V3', 'intent_enriched_dense_mmr_top3'), ('V4', 'baseline_dense_top3'), ('V5', 'improved_dense_mmr_top3'), ('V6', 'intent_enriched_dense_mmr_top3')) x(v, m) on mode = m where rank <= 3""")
def retrieval_modes(spark, folder):
    """All modes and variants over the stored vectors; each question's own vector is left out of its corpus by a corpus of the others."""
    vectors = table(spark, folder, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.lit("none").alias("topic"), F.lit("basic").alias("difficulty"), F.lit("x").alias("query_text"), F.col("embedding").alias("query_embedding"), F.col("embedding").alias("enriched_embedding"))
    nothing = F.lit("").alias
    corpus = vectors.select(F.format_string("%012d", F.col("vec_id")).alias("chunk_id"), F.col("label").cast("string").alias("source_id"), nothing("section_path_text"), nothing("source_url"), F.lit(1).alias("word_count"), nothing("text"), "embedding")
    variants = spark.createDataFrame([(v, _MODE_NAMES[m], tier) for v, m, tier in C.VARIANTS], "variant string, retrieval_mode string, model_name string")
    found = retrieval.run_variants(asked, corpus, variants, own=lambda query, chunk: query.cast("long") == chunk.cast("long"))
    return found.select("variant", "retrieval_mode", "query_id", F.col("rank").cast("long").alias("rank"), F.col("chunk_id").cast("long").cast("string").alias("chunk_id"), "source_id", *(F.round(c, 6).alias(c) for c in ("similarity_score", "rerank_score")))


@query()
def retrieval_variants(spark, folder):
    """All modes and variants, end to end: chunks of all documents, hashed vectors, every question whose number is divisible by 20."""
    asked = table(spark, folder, "evaluation_queries_blueprint").filter("cast(substring(query_id, 2) as int) % 20 = 0")
    embedder = HashingEmbedder(64)
    asked = asked.withColumn("query_embedding", embedder.column(F.col("query_text"))).withColumn("enriched_embedding", embedder.column(T.enriched_query(F.col("topic"), F.col("difficulty"), F.col("query_text"))))
    variants = spark.createDataFrame([(v, _MODE_NAMES[m], tier) for v, m, tier in C.VARIANTS], "variant string, retrieval_mode string, model_name string")
    found = retrieval.run_variants(asked, _hashed_corpus(spark, folder), variants)
    return found.select("query_id", "variant", "retrieval_mode", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("similarity_score", 6).alias("similarity_score"), F.round("rerank_score", 6).alias("rerank_score"))


def vector_store(spark, folder):
    """The vector table of all chunks; every vector has length one."""
    rows = vector_table(_hashed_corpus(spark, folder))
    return rows.select("chunk_id", "doc_id", "source_id", "page_key", "title", "section_path_text", "page_number", "chunk_index", "word_count", "document", F.size("embedding").alias("dimension"), F.round(norm(F.col("embedding")), 4).alias("length"))


def embedding_run(spark, folder):
    """One row that describes the embedding of the corpus."""
    return embedding_summary(_hashed_corpus(spark, folder), "hashing-64", 32)


# --- text ------------------------------------------------------------------------------


@query(f"select doc_id, {_ws('text')} as text, ({_words(_ws('text'))})::BIGINT as words, length(text) as chars from documents where text is not null")
def collapse_ws(spark, folder):
    """Texts with single spaces, their words and characters."""
    return documents(spark, folder).filter("text is not null").select("doc_id", T.collapse_whitespace(F.col("text")).alias("text"), T.word_count(F.col("text")).cast("long").alias("words"), F.length("text").cast("long").alias("chars"))


@query(f"select doc_id, {_slug('coalesce(title, source)')} as slug from documents")
def slugify_titles(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.slugify(F.coalesce("title", "source")).alias("slug"))


_URL_REST = "regexp_replace(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')"


@query(
    f"""with p as (select doc_id, trim(regexp_extract({_URL_REST}, '^([^?#]*)', 1), '/') as path, regexp_extract({_URL_REST}, '\\?([^#]*)', 1) as query from documents)
select doc_id, {_slug("coalesce(nullif(path, ''), 'root') || case when query <> '' then '_' || query else '' end")} as slug from p"""
)
def url_slugs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.url_slug(F.col("source_url")).alias("slug"))


@query(
    """with h as (select d.doc_id, lower(regexp_extract(d.source_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host, r.allowed_domains from documents d join source_registry r on d.source_id = r.source_id)
select doc_id, len(list_filter(allowed_domains, lambda a: host = lower(a) or ends_with(host, '.' || lower(a)))) > 0 as allowed from h"""
)
def domain_allowlist(spark, folder):
    """Whether each document comes from its source's domains."""
    allowed = table(spark, folder, "source_registry").select("source_id", "allowed_domains")
    return table(spark, folder, "documents").select("doc_id", "source_id", "source_url").join(allowed, "source_id").select("doc_id", T.domain_allowed(F.col("source_url"), F.col("allowed_domains")).alias("allowed"))


@query("select doc_id, sha256(text) as digest from documents where text is not null")
def sha256_snapshot(spark, folder):
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", T.sha256_hex(F.col("text")).alias("digest"))


def _numbered(df: DataFrame, items: Column, name: str) -> DataFrame:
    return df.select("doc_id", F.posexplode(items).alias("_at", name)).select("doc_id", (F.col("_at") + 1).cast("long").alias("no"), name)


def _numbered_sql(items: str, name: str) -> str:
    return f"with s as (select doc_id, {items} as l from documents where text is not null) select doc_id, unnest(range(1, len(l) + 1)) as no, unnest(l) as {name} from s"


@query(_numbered_sql(_parts(_ws("text"), "[.!?]"), "sentence"))
def sentence_split(spark, folder):
    return _numbered(documents(spark, folder), T.split_sentences(F.col("text")), "sentence")


@query(_numbered_sql(_parts(_ws("text"), "[;:]"), "clause"))
def clause_split(spark, folder):
    return _numbered(documents(spark, folder), T.split_clauses(F.col("text")), "clause")


_PROXY_MARKED = f"regexp_replace(text, {_q(f'([.!?]){C.SPACE}+')}, '\\1' || chr(1), 'g')"


@query(_numbered_sql(f"list_filter(list_transform(string_split({_PROXY_MARKED}, chr(1)), lambda s: {_strip('s')}), lambda s: length(s) >= {C.MIN_PROXY_SENTENCE})", "sentence"))
def proxy_sentence_split(spark, folder):
    return _numbered(documents(spark, folder), T.proxy_sentences(F.col("text")), "sentence")


@query(
    f"""with n as (select doc_id, ({_words(_ws('text'))}) as total from documents where text is not null), w as (select doc_id, total, unnest(range(0, total, 120)) as first from n),
k as (select * from w where first = 0 or first < total - 40)
select doc_id, row_number() over (partition by doc_id order by first) as no, first::BIGINT as first, least(first + 160, total)::BIGINT as "end" from k"""
)
def word_windows(spark, folder):
    """Overlapping word windows of each text."""
    counted = documents(spark, folder).select("doc_id", T.word_count(F.col("text")).alias("_n")).filter("_n > 0")
    rows = counted.select("doc_id", F.posexplode(chunking.word_windows(F.col("_n"))).alias("_at", "_w"))
    return rows.select("doc_id", (F.col("_at") + 1).cast("long").alias("no"), F.col("_w.first").cast("long").alias("first"), F.col("_w.end").cast("long").alias("end"))


# a fragment over the limit becomes windows of 160 words every 120
_UNITS = f"""
s as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as t from (select doc_id, {_parts(_ws('text'), '[.!?]')} as l from documents where text is not null)),
c as (select doc_id, i, t, {_words('t')} as n, {_parts('t', '[;:]')} as cl from s),
f as (select doc_id, i, 0 as j, t, n, 'sentence' as strategy from c where n <= 160 union all
      select doc_id, i, unnest(range(1, len(cl) + 1)) as j, unnest(cl) as t, null as n, case when len(cl) > 1 then 'clause' else 'word_fallback' end as strategy from c where n > 160),
g as (select doc_id, i, j, t, {_words('t')} as n, strategy from f),
u as (select doc_id, i, j, 0 as k, t as text, n as words, strategy from g where n <= 160 union all
      select doc_id, i, j, w as k, array_to_string(string_split(t, ' ')[w + 1 : least(w + 160, n)], ' ') as text, least(w + 160, n) - w as words, 'word_fallback' as strategy
      from (select *, unnest(range(0, n, 120)) as w from g where n > 160) x where w = 0 or w < n - 40),
units as (select doc_id, row_number() over (partition by doc_id order by i, j, k) as no, text, words, strategy from u)
"""


@query(f"with {_UNITS} select doc_id, no, text, words::BIGINT as words, strategy from units")
def semantic_units(spark, folder):
    """Sentences, else clauses, else word windows of each text."""
    rows = _numbered(documents(spark, folder), chunking.semantic_units(F.col("text")), "_u")
    return rows.select("doc_id", "no", "_u.text", F.col("_u.words").cast("long").alias("words"), "_u.strategy")


_PACK = """pack as (
  select doc_id, 1 as no, words, 1 as chunk from units where no = 1
  union all
  select p.doc_id, p.no + 1, case when j then p.words + u.words else u.words end, case when j then p.chunk else p.chunk + 1 end
  from (select p.*, u.words as next, (p.words < 40 or (p.words < 124 and p.words + u.words <= 179) or (p.words + u.words <= 160 and u.words <= 24)) as j from pack p join units u on u.doc_id = p.doc_id and u.no = p.no + 1) p
  join units u on u.doc_id = p.doc_id and u.no = p.no + 1
),
pg as (select p.doc_id, p.chunk, min(p.no) - 1 as first, max(p.no) as "end", sum(u.words) as words from pack p join units u on u.doc_id = p.doc_id and u.no = p.no group by p.doc_id, p.chunk),
m as (select *, max(chunk) over (partition by doc_id) as last from pg),
r as (select *, case when chunk = last and chunk > 1 and words < 40 then chunk - 1 else chunk end as own from m)"""


@query(
    f"""with recursive {_UNITS},
{_PACK}
select doc_id, own as no, min(first)::BIGINT as first, max("end")::BIGINT as "end", sum(words)::BIGINT as words from r group by doc_id, own"""
)
def semantic_chunks(spark, folder):
    """Units packed into chunks."""
    rows = _numbered(documents(spark, folder), chunking.chunk_groups(chunking.semantic_units(F.col("text"))), "_g")
    return rows.select("doc_id", F.col("no").cast("int").alias("no"), *(F.col(f"_g.{c}").cast("long").alias(c) for c in ("first", "end", "words")))


_SAID = f"list_filter(list_transform(coalesce(section_path, []), lambda p: {_ws('p')}), lambda p: p <> '')"
_FIRST = f"list_filter({_SAID}, lambda p, i: list_position(list_transform({_SAID}, lambda q: lower(q)), lower(p)) = i)"
_PREFIX = f"(case when len({_FIRST}) > 0 then 'Section: ' || array_to_string({_FIRST}[greatest(len({_FIRST}) - 1, 1):], ' > ') || '. ' else '' end)"


@query(f"select doc_id, {_PREFIX} as prefix from documents")
def context_prefix(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.coalesce(T.context_prefix(F.col("section_path")), F.lit("")).alias("prefix"))


@query(
    f"""with p as (select doc_id, {_PREFIX} as prefix, {_ws('text')} as flat from documents where text is not null)
select doc_id, case when {_words('flat')} >= 45 or prefix = '' or starts_with(lower(flat), trim(replace(lower(prefix), 'section: ', ''))) then flat else prefix || flat end as text from p"""
)
def enrich_short_text(spark, folder):
    """Short texts with their context in front."""
    return documents(spark, folder).filter("text is not null").select("doc_id", T.enrich_short_text(F.col("section_path"), F.col("text")).alias("text"))


@query(
    f"""select doc_id, concat_ws(chr(10), case when {_ws('title')} <> '' then 'Title: ' || {_ws('title')} end, case when len({_SAID}) > 0 then 'Section: ' || array_to_string({_SAID}, ' > ') end, case when {_ws('text')} <> '' then 'Content: ' || {_ws('text')} end) as retrieval_text from documents"""
)
def retrieval_text(spark, folder):
    """What is embedded of each document."""
    return documents(spark, folder).select("doc_id", T.retrieval_text(F.col("title"), F.col("section_path"), F.col("text")).alias("retrieval_text"))


# --- quality ---------------------------------------------------------------------------


def _hits(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(pattern)}))"


_HEAVY = f"({_hits('flat', C.URL)} >= 2 and ({_hits('flat', C.URL)} >= 5 or {_words('flat')} <= 80))"
_INDEX = f"({_hits('flat', C.PAGE_REFERENCE)} >= 8 and (contains(lower(flat), 'index') or contains(lower(flat), 'see also')))"
_LOW = f"(({_words('flat')} <= 15 and regexp_matches(flat, {_q(C.REPORT_HEADER)})) or {_HEAVY} or {_INDEX} or regexp_matches(lower(flat), {_q(C.BACK_MATTER)}))"
# the chunk records: documents of low signal go first, then units are packed, enriched and judged
_CHUNKS = f"""
docs as (select doc_id, section_path, title, source_id, page_key, page_number, {_ws('text')} as flat from documents where text is not null),
keep as (select * from docs where flat <> '' and not regexp_matches(coalesce(array_to_string(section_path, ' > '), ''), {_q(C.LOW_SIGNAL_SECTION)}) and not {_LOW}),
{_UNITS},
{_PACK},
body as (select r.doc_id, own as no, min(first) as first, max("end") as "end" from r join keep k on r.doc_id = k.doc_id group by r.doc_id, own),
said as (select b.doc_id, b.no, b.first, b."end", string_agg(u.text, ' ' order by u.no) as plain, list_sort(list_distinct(list(u.strategy))) as strategies, count(*) as units from body b join units u on u.doc_id = b.doc_id and u.no > b.first and u.no <= b."end" group by all),
rich as (select s.*, k.section_path, k.title, k.source_id, k.page_key, k.page_number, k.flat as whole, {_PREFIX} as prefix from said s join keep k on s.doc_id = k.doc_id),
texts as (select *, case when {_words('plain')} >= 45 or prefix = '' or starts_with(lower(plain), trim(replace(lower(prefix), 'section: ', ''))) then plain else prefix || plain end as flat from rich),
chunks as (select *, doc_id || '__chunk_' || printf('%04d', no) as chunk_id from texts where not {_LOW})
"""




@query(
    f"""with recursive {_CHUNKS} select chunk_id, doc_id, no::BIGINT as chunk_index, first::BIGINT as chunk_unit_start, "end"::BIGINT as chunk_unit_end, units as sentence_count, strategies as chunk_strategies, ({_words('whole')})::BIGINT as source_doc_word_count, ({_words('flat')})::BIGINT as word_count, length(flat) as char_count, flat as text from chunks"""
)
def document_chunks(spark, folder):
    """The chunk records of all documents."""
    rows = chunking.chunk_documents(documents(spark, folder))
    return rows.select("chunk_id", "doc_id", "chunk_index", "chunk_unit_start", "chunk_unit_end", "sentence_count", "chunk_strategies", "source_doc_word_count", "word_count", F.col("char_count"), "text")


_FLAT = f"with f as (select *, {_ws('text')} as flat from documents where text is not null)"


@query(f"""{_FLAT} select doc_id, {_HEAVY} as url_heavy, {_INDEX} as index_like, {_LOW} as low_signal_chunk, (regexp_matches(coalesce(array_to_string(section_path, ' > '), ''), {_q(C.LOW_SIGNAL_SECTION)}) or {_LOW}) as low_signal_document,
(regexp_matches(coalesce(array_to_string(section_path, ' > '), ''), {_q(C.LOW_SIGNAL_HEADING)}) or regexp_matches(text, {_q(C.LOW_SIGNAL_TEXT)})) as low_signal_section from f""")
def low_signal(spark, folder):
    """What the heuristics say of each document."""
    docs = documents(spark, folder).filter("text is not null").select("doc_id", "text", "section_path")
    told = quality.with_signals(once(docs, _path=quality.low_signal_path(F.col("section_path")), low_signal_section=quality.low_signal_section(F.col("section_path"), F.col("text"))), "text")
    return told.select("doc_id", F.col("_url_heavy").alias("url_heavy"), F.col("_index_like").alias("index_like"), F.col("_low_signal").alias("low_signal_chunk"), (F.col("_path") | F.col("_low_signal")).alias("low_signal_document"), "low_signal_section")


_LINES = f"lines as (select source_id, doc_id, unnest(string_split(text, chr(10))) as raw from documents where text is not null and source_id is not null), l as (select source_id, doc_id, {_ws('raw')} as line from lines where {_ws('raw')} <> '')"


def _source_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).filter("text is not null and source_id is not null")
    lines = docs.select(F.col("source_id").alias("document"), F.col("doc_id").alias("page_number"), F.explode(F.split("text", "\n", -1)).alias("_l"))
    return once(lines, line=T.collapse_whitespace(F.col("_l"))).drop("_l").filter("line <> ''")


@query(f"with {_LINES} select source_id as document, line, count(distinct doc_id) as repeats from l group by all")
def repeated_line_counts(spark, folder):
    """On how many documents of a source each line is."""
    return pages.repeated_line_counts(_source_lines(spark, folder))


@query(
    f"""with {_LINES}, n as (select source_id, line, count(distinct doc_id) as repeats from l group by all), t as (select source_id, count(distinct doc_id) as pages from l group by all)
select n.source_id as document, line, repeats from n join t using (source_id) where regexp_matches(line, {_q(C.PAGE_ONLY)}) or regexp_matches(line, {_q(C.PUNCT_ONLY)}) or regexp_matches(line, {_q(C.DOT_LEADER)}) or regexp_matches(lower(line), {_q(C.REPORT_HEADER)})
or (regexp_matches(lower(line), {_q(C.AGENCY)}) and repeats >= greatest(3, pages // 12)) or (length(line) between 1 and 14 and repeats >= greatest(3, pages // 10)) or (length(line) <= 120 and repeats >= greatest(5, pages // 8))"""
)
def boilerplate_lines(spark, folder):
    """Lines that are page numbers, rules or running heads."""
    lines = _source_lines(spark, folder)
    totals = lines.groupBy("document").agg(F.count_distinct("page_number").alias("_pages"))
    counted = pages.repeated_line_counts(lines).join(totals, "document")
    return counted.filter(quality.boilerplate_line(F.col("line"), F.col("repeats"), F.col("_pages"))).select("document", "line", "repeats")


def printed_pages(spark, folder):
    """Documents of printed pages, from the text of all documents of a source as its pages."""
    docs = documents(spark, folder).filter("source_id is not null")
    rows = pages.page_documents(docs.select(F.col("source_id").alias("document"), F.col("source").alias("title"), "source_id", F.concat(F.lit("https://docs.example/"), "source_id").alias("source_url"), "trust_level", F.array().cast("array<string>").alias("topic_tags"), F.lit(None).cast("string").alias("document_key"), F.col("doc_id").alias("page_number"), F.col("text").alias("raw_text")))
    return rows.select("doc_id", "source_id", "page_number", "title", "section_path", "text")


def html_sections(spark, folder):
    """Sections of pages made of all documents: a heading and a paragraph for each line."""
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>x</title></head><body><nav>menu</nav><main><h1>"), F.coalesce("title", F.lit("Page")), F.lit("</h1><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p><p>")), F.lit("</p></main></body></html>"))
    docs = documents(spark, folder)
    rows = html.sections(docs.select(F.coalesce("source_id", F.lit("unknown")).alias("source_id"), "source_url", "trust_level", F.array().cast("array<string>").alias("topic_tags"), F.col("page_key").alias("document_key"), page.alias("html")))
    return rows.select("doc_id", "source_id", "page_key", "title", "section_path", "text")


@query(
    """select 'feed__event_' || event_id || '__' || event_type as doc_id, event_type as external_id, 'CVE ID: ' || event_type || ' Summary: ' || 'event number ' || event_id || ' of user ' || user_id || ' ' || (props->>'k') as text from events where props->>'k' is not null"""
)
def feed_items(spark, folder):
    """Feed items made of all events: one item of JSON a row."""
    events = table(spark, folder, "events")
    item = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("id"), F.concat(F.lit("event number "), "event_id", F.lit(" of user "), "user_id").alias("summary"), F.get_json_object("props", "$.k").alias("content_text"))).alias("items")))
    rows = events.filter(F.get_json_object("props", "$.k").isNotNull()).select(F.lit("feed").alias("source_id"), F.lit("https://feed.example/").alias("source_url"), F.lit("official").alias("trust_level"), F.array().cast("array<string>").alias("topic_tags"), F.concat(F.lit("event "), "event_id").alias("document_key"), item.alias("payload"))
    return feed.feed_items(rows).select("doc_id", "external_id", "text")


_VECTORS = f"""with recursive {_CHUNKS}, v as (select *, coalesce(array_to_string({_SAID}, ' > '), '') as section_path_text from chunks),
n as (select *, concat_ws(' ', {_ws('title')}, section_path_text, flat) as embedded from v)"""
query(
    f"""{_VECTORS} select chunk_id, doc_id::VARCHAR as doc_id, coalesce(source_id, '') as source_id, coalesce(page_key, '') as page_key, coalesce(title, '') as title, section_path_text, page_number, no::BIGINT as chunk_index, ({_words('flat')})::BIGINT as word_count, flat as document, 64 as dimension, 1.0::DOUBLE as length from n"""
)(vector_store)
query(f"{_VECTORS} select 'hashing-64' as model_name, 32::BIGINT as batch_size, count(*) as num_vectors, 64::BIGINT as vector_dim from n")(embedding_run)

# --- answers ---------------------------------------------------------------------------


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "generation_results_smoke_v1")


@query(f"select result_id, {_CITATIONS} as cited, {_PLAIN} as plain from generation_results_smoke_v1 where answer_text is not null")
def extract_citations(spark, folder):
    """The citations and the plain text of each answer."""
    return _answers(spark, folder).filter("answer_text is not null").select("result_id", T.extract_citations(F.col("answer_text")).alias("cited"), T.strip_citations(F.col("answer_text")).alias("plain"))


_KEPT = f"list_filter({_CITATIONS}, lambda c: list_contains(citations, c))"
_ENFORCED = f"(case when len({_KEPT}) > 0 then {_KEPT} else citations end)"


@query(f"select result_id, {_PLAIN} || chr(10) || chr(10) || '[' || array_to_string({_ENFORCED}, ', ') || ']' as answer from generation_results_smoke_v1 where answer_text is not null and citations is not null")
def enforce_citations(spark, folder):
    """Each answer with its citations repaired."""
    return _answers(spark, folder).filter("answer_text is not null and citations is not null").select("result_id", T.enforced_answer(F.col("answer_text"), F.col("citations")).alias("answer"))


@query(
    f"""select result_id, len({_CITATIONS})::BIGINT as num_citations, coalesce(len({_CITATIONS}) > 0 and len(list_filter({_CITATIONS}, lambda c: not list_contains(citations, c))) = 0, false) as citation_valid,
round(case when len({_CITATIONS}) = 0 then 0.0 else len({_KEPT}) / len({_CITATIONS}) end, 4) as citation_share from generation_results_smoke_v1 where answer_text is not null and citations is not null"""
)
def citation_validity(spark, folder):
    """Whether the citations in the text are among those of the row, and what share of them."""
    cited = T.extract_citations(F.col("answer_text"))
    rows = _answers(spark, folder).filter("answer_text is not null and citations is not null").withColumn("_c", cited)
    return rows.select("result_id", F.size("_c").cast("long").alias("num_citations"), evaluation.citations_valid(F.col("_c"), F.col("citations")).alias("citation_valid"), evaluation.citation_share(F.col("_c"), F.col("citations")).alias("citation_share"))


@query(f"select result_id, {_ws('lower(coalesce(answer_text_plain, ' + _q('') + '))')} as key from generation_results_smoke_v1")
def answer_keys(spark, folder):
    return _answers(spark, folder).select("result_id", T.answer_key(F.col("answer_text_plain")).alias("key"))


@query(f"""with f as (select result_id, {_ws("coalesce(answer_text_plain, '')")} as flat from generation_results_smoke_v1)
select result_id, case when length(flat) <= 120 then flat else regexp_replace(left(flat, 120), ' [^ ]*$', '') || ' ...' end as short from f""")
def short_answers(spark, folder):
    return _answers(spark, folder).select("result_id", T.shorten(F.col("answer_text_plain"), 120).alias("short"))


@query("select result_id, citations as cited from generation_results_smoke_v1 where citations is not null")
def parse_lists(spark, folder):
    """Lists written as JSON text and read back."""
    return _answers(spark, folder).filter("citations is not null").select("result_id", T.parse_list(F.to_json("citations")).alias("cited"))


@query(
    f"""select query_id, count(*) as num_answers, count(distinct {_ws("lower(coalesce(answer_text_plain, ''))")}) as num_unique_answers, count(*) - count(distinct {_ws("lower(coalesce(answer_text_plain, ''))")}) as duplicate_answers from generation_results_smoke_v1 group by query_id"""
)
def duplicate_answers(spark, folder):
    return evaluation.duplicate_answers(_answers(spark, folder))


@query(
    f"""with d as (select count(*) as n, count(distinct {_ws("lower(coalesce(answer_text_plain, ''))")}) as u from generation_results_smoke_v1 group by query_id) select round(sum(n - u) / sum(n), 6) as duplicate_answer_rate from d"""
)
def duplicate_rate(spark, folder):
    return evaluation.duplicate_rate(evaluation.duplicate_answers(_answers(spark, folder))).select(F.round("duplicate_answer_rate", 6).alias("duplicate_answer_rate"))


_LAST = "a as (select * from (select *, row_number() over (partition by query_id, variant order by result_id desc) as n from generation_results_smoke_v1 where query_id is not null and citations is not null) where n = 1)"
_RETRIEVED = f"{_LAST}, r as (select query_id, variant, unnest(range(1, len(citations) + 1)) as rank, unnest(citations) as chunk_id from a)"


def _last_answers(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.keep_last(_answers(spark, folder).filter("query_id is not null and citations is not null"), ["query_id", "variant"], ["result_id"])


def _retrieved(answers: DataFrame) -> DataFrame:
    """What the answers cite, as if it had been retrieved for them."""
    rows = answers.select("query_id", "variant", F.posexplode("citations").alias("_at", "chunk_id"))
    return rows.select("query_id", "variant", (F.col("_at") + 1).alias("rank"), "chunk_id", F.split_part("chunk_id", F.lit("__"), F.lit(1)).alias("source_id"), F.split_part("chunk_id", F.lit("__"), F.lit(2)).alias("section_path_text"), F.col("chunk_id").alias("chunk_text"))


@query(
    f"""with {_RETRIEVED}, c as (select query_id, variant, list(chunk_id order by rank) as retrieved_chunk_ids, string_agg('Source: ' || split_part(chunk_id, '__', 1) || chr(10) || 'Section: ' || split_part(chunk_id, '__', 2) || chr(10) || 'Content: ' || chunk_id, chr(10) || chr(10) order by rank) as retrieved_context_text from r group by all)
select a.query_id, a.variant, model_name, topic, difficulty, query_text, reference_answer, answer_text_plain, retrieved_chunk_ids, retrieved_context_text from a join evaluation_queries_blueprint q on a.query_id = q.query_id join c on a.query_id = c.query_id and a.variant = c.variant"""
)
def evaluation_cases(spark, folder):
    """Each last answer with its question, reference and context."""
    answers = _last_answers(spark, folder)
    cases = evaluation.evaluation_cases(answers, table(spark, folder, "evaluation_queries_blueprint"), _retrieved(answers))
    return cases.select("query_id", "variant", "model_name", "topic", "difficulty", "query_text", "reference_answer", "answer_text_plain", "retrieved_chunk_ids", "retrieved_context_text")


@query(
    f"""with {_RETRIEVED}, g as (select r.query_id, r.variant, query_text, list(chunk_id order by rank) as chunk_ids, string_agg('Chunk ID: ' || chunk_id || chr(10) || 'Source ID: ' || split_part(chunk_id, '__', 1) || chr(10) || 'Section: ' || split_part(chunk_id, '__', 2) || chr(10) || 'Text: ' || chunk_id, chr(10) || chr(10) order by rank) as block from r join evaluation_queries_blueprint q on r.query_id = q.query_id group by all)
select query_id, variant, chunk_ids, 'User question:' || chr(10) || query_text || chr(10) || chr(10) || 'Allowed citation chunk IDs:' || chr(10) || array_to_string(chunk_ids, ', ') || chr(10) || chr(10) || 'Output requirements:' || chr(10) || {_q(C.OUTPUT_REQUIREMENTS)} || chr(10) || chr(10) || 'Retrieved context:' || chr(10) || block || chr(10) as prompt_text from g"""
)
def generation_prompts(spark, folder):
    """The prompt for each question and variant."""
    questions = table(spark, folder, "evaluation_queries_blueprint").select("query_id", "query_text", "topic", "difficulty")
    variants = spark.createDataFrame([(v, tier) for v, _, tier in C.VARIANTS], "variant string, model_name string")
    cases = generation.generation_cases(_retrieved(_last_answers(spark, folder)).join(questions, "query_id"), variants)
    return cases.select("query_id", "variant", "chunk_ids", "prompt_text")


@query(
    f"""with {_RETRIEVED}, g as (select r.query_id, r.variant, list(chunk_id order by rank) as ids from r join evaluation_queries_blueprint q on r.query_id = q.query_id group by all), m(variant, model_name) as (values {", ".join(f"({_q(v)}, {_q(t)})" for v, _, t in C.VARIANTS)})
select query_id, g.variant, model_name, array_to_string(ids[1:2], ' ') || chr(10) || chr(10) || '[' || array_to_string(ids, ', ') || ']' as answer_text, array_to_string(ids[1:2], ' ') as answer_text_plain, ids as citations from g join m on g.variant = m.variant"""
)
def generated_answers(spark, folder):
    """Extractive answers to all prompts, with repaired citations."""
    questions = table(spark, folder, "evaluation_queries_blueprint").select("query_id", "query_text", "topic", "difficulty")
    variants = spark.createDataFrame([(v, tier) for v, _, tier in C.VARIANTS], "variant string, model_name string")
    cases = generation.generation_cases(_retrieved(_last_answers(spark, folder)).join(questions, "query_id"), variants)
    made = generation.with_citations(generation.ExtractiveGenerator().transform(cases))
    return made.select("query_id", "variant", "model_name", "answer_text", "answer_text_plain", "citations")


_TOKEN_SQL = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


@query(
    f"""with {_LAST}, t as (select a.query_id, a.variant, {_TOKEN_SQL.format(_ws("regexp_replace(coalesce(answer_text_plain, ''), '" + chr(92) + "[[^" + chr(92) + "]]+" + chr(92) + "]', '', 'g')"))} as a, {_TOKEN_SQL.format(_ws("regexp_replace(coalesce(reference_answer, ''), '" + chr(92) + "[[^" + chr(92) + "]]+" + chr(92) + "]', '', 'g')"))} as r from a join evaluation_queries_blueprint q on a.query_id = q.query_id),
s as (select query_id, variant, case when len(a) = 0 then 0.0 else len(list_filter(a, lambda w: list_contains(r, w))) / len(a) end as p, case when len(r) = 0 then 0.0 else len(list_filter(r, lambda w: list_contains(a, w))) / len(r) end as c from t)
select query_id, variant, round(p, 6) as bertscore_p, round(c, 6) as bertscore_r, round(case when p + c = 0 then 0.0 else 2 * p * c / (p + c) end, 6) as bertscore_f1 from s"""
)
def token_match_scores(spark, folder):
    """Precision, recall and F1 of all answers against the references by matching words."""
    cases = _last_answers(spark, folder).join(table(spark, folder, "evaluation_queries_blueprint").select("query_id", "reference_answer"), "query_id")
    scored = evaluation.token_match_scores(cases)
    return scored.select("query_id", "variant", *(F.round(c, 6).alias(c) for c in evaluation.BERTSCORE))


@query(f"with {_LAST} select count(*) as num_evaluation_cases, count(distinct variant) as num_variants, true as run_bertscore, false as run_ragas, 'tokens' as bertscore_model_type, 'none' as ragas_judge_model from a")
def evaluation_run_plan(spark, folder):
    return evaluation.run_plan(_last_answers(spark, folder), True, False, "tokens", "none")


@query("select result_id, coalesce(citations[1], '') as context_1, coalesce(citations[2], '') as context_2, coalesce(citations[3], '') as context_3, array_to_string(list_filter([model_name, variant], lambda x: x is not null and x <> ''), ', ') as systems from generation_results_smoke_v1")
def deep_dive_slots(spark, folder):
    """The first three citations of each answer in columns of their own."""
    rows = evaluation.deep_dive(_answers(spark, folder), "citations", "citations")
    return rows.select("result_id", "context_1", "context_2", "context_3", T.joined_distinct(F.col("model_name"), F.col("variant")).alias("systems"))


# --- metrics ---------------------------------------------------------------------------

_PROXIES = ("context_relevance_proxy_mean", "answer_relevance_proxy_mean", "faithfulness_proxy_mean", "citation_validity_mean")


@query("select model_name, count(*) as num_cases, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in _PROXIES) + " from proxy_eval_summary_by_variant group by model_name")
def metric_means_null_group(spark, folder):
    """Means by model, the rows without one kept as a group."""
    means = evaluation.metric_means(table(spark, folder, "proxy_eval_summary_by_variant"), "model_name", _PROXIES)
    return means.select("model_name", "num_cases", *(F.round(m, 6).alias(m) for m in _PROXIES))


@query("select event_type, count(*) as num_cases, round(avg(value), 6) as value_mean, round(stddev_samp(value), 6) as value_std from events group by event_type")
def mean_std_summary(spark, folder):
    spread = evaluation.mean_and_spread(table(spark, folder, "events"), ["event_type"], ["value"])
    return spread.select("event_type", "num_cases", F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 6).alias("value_std"))


@query(
    """with b as (select event_type, rank() over (partition by user_id order by value desc) as r from events where value is not null), w as (select event_type, count(*) as win_count from b where r = 1 group by event_type)
select e.event_type, coalesce(win_count, 0) as win_count from (select distinct event_type from events) e left join w on e.event_type = w.event_type"""
)
def win_counts(spark, folder):
    """How often each kind of event has a user's highest value."""
    return evaluation.win_counts(table(spark, folder, "events"), "user_id", "event_type", "value")


@query("select v.variant, q.query_id, null::DOUBLE as bertscore_f1 from evaluation_queries_blueprint q cross join (values ('V1'), ('V2'), ('V3'), ('V4'), ('V5'), ('V6')) v(variant)")
def placeholder_cross(spark, folder):
    """A row of empty metrics for each question and variant."""
    variants = spark.createDataFrame([(v,) for v, _, _ in C.VARIANTS], "variant string")
    return evaluation.metric_placeholder(table(spark, folder, "evaluation_queries_blueprint"), variants).select("query_id", "variant", "bertscore_f1")


_SCORED = "s as (select query_id, variant, max(bertscore_f1) filter (not isnan(bertscore_f1)) as f1 from bertscore_results group by all)"


@query(f"with {_SCORED}, {_LAST} select a.query_id, a.variant, round(coalesce(s.f1, 0.5), 6) as bertscore_f1 from a left join s on a.query_id = s.query_id and a.variant = s.variant")
def metric_merge(spark, folder):
    """Scores laid over a default: a value replaces it, a null does not."""
    base = _last_answers(spark, folder).select("query_id", "variant", F.lit(0.5).alias("bertscore_f1"))
    scores = table(spark, folder, "bertscore_results").groupBy("query_id", "variant").agg(F.max(F.when(~F.isnan("bertscore_f1"), F.col("bertscore_f1"))).alias("bertscore_f1"))
    return evaluation.merge_metrics(base, scores).select("query_id", "variant", F.round("bertscore_f1", 6).alias("bertscore_f1"))


_GROUPED = f"""with g as (select label, list(embedding order by vec_id) as l from embeddings group by label)"""


@query(f"""{_GROUPED} select vec_id, round(len(list_filter(l, lambda c: {_dot('embedding', 'c')} >= {C.CONTEXT_THRESHOLD})) / len(l), 4) as context_relevance from embeddings join g using (label) where vec_id % 20 = 0""")
def proxy_context_relevance(spark, folder):
    """The share of a group's vectors near each question."""
    vectors = table(spark, folder, "embeddings")
    near = retrieval.group_similarities(vectors.filter("vec_id % 20 = 0"), vectors, "label", "vec_id", C.CONTEXT_THRESHOLD)
    return near.select("vec_id", F.round(F.col("near") / F.col("total"), 4).alias("context_relevance"))


@query(
    f"""with c as (select a.label, a.vec_id, max({_dot('a.embedding', 'b.embedding')}) as best from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id and b.vec_id % 20 <> 0 where a.vec_id % 20 = 0 group by all)
select label::BIGINT as label, round(count(*) filter (best >= {C.FAITHFUL_THRESHOLD}) / count(*), 4) as faithfulness from c group by label"""
)
def proxy_faithfulness(spark, folder):
    """The share of a group's questions that one of its other vectors is near to."""
    vectors = table(spark, folder, "embeddings")
    near = retrieval.group_similarities(vectors.filter("vec_id % 20 = 0"), vectors.filter("vec_id % 20 <> 0"), "label", "vec_id", C.FAITHFUL_THRESHOLD)
    return near.groupBy(F.col("label").cast("long").alias("label")).agg(F.round(F.avg((F.col("best") >= C.FAITHFUL_THRESHOLD).cast("double")), 4).alias("faithfulness"))


@query(
    """select variant, round((case when context_relevance_proxy_mean is null or isnan(context_relevance_proxy_mean) then answer_relevance_proxy_mean when answer_relevance_proxy_mean is null then context_relevance_proxy_mean else (context_relevance_proxy_mean + answer_relevance_proxy_mean) / 2 end), 8) as core,
round((coalesce(context_relevance_proxy_mean, 0) + answer_relevance_proxy_mean + coalesce(faithfulness_proxy_mean, 0)) / 3, 4) as composite from proxy_eval_summary_by_variant"""
)
def proxy_core(spark, folder):
    """The mean of two scores as far as they are there, and of three."""
    c, a, f = (F.col(x) for x in _PROXIES[:3])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return table(spark, folder, "proxy_eval_summary_by_variant").select("variant", F.round(evaluation.core_composite(F.when(~F.isnan(c), c), a), 8).alias("core"), evaluation.proxy_composite(zero(c), a, zero(f)).alias("composite"))


# --- summaries and samples ----------------------------------------------------------------


@query("select source_id, doc_kind, trust_level, count(*) as num_docs, median(length(text))::DOUBLE as median_chars from documents where source_id is not null group by all")
def docs_by_source_median(spark, folder):
    return summaries.documents_by_source(table(spark, folder, "documents")).withColumn("median_chars", F.col("median_chars").cast("double"))


@query("select e.source_id, trust_level, count(*) as num_chunks, median(word_count)::DOUBLE as median_words from embedding_records e join source_registry r on e.source_id = r.source_id group by all")
def chunk_summary(spark, folder):
    trust = table(spark, folder, "source_registry").select("source_id", "trust_level")
    return summaries.chunks_by_source(table(spark, folder, "embedding_records").join(trust, "source_id"))


@query("select source_id, doc_kind as source_type, trust_level, count(*) as num_items, sum(strlen(text))::BIGINT as total_bytes from documents where text is not null group by all")
def fetch_summary(spark, folder):
    raw = table(spark, folder, "documents").filter("text is not null").select("source_id", F.col("doc_kind").alias("source_type"), "trust_level", F.col("doc_id").alias("item_id"), F.octet_length("text").cast("long").alias("byte_size"))
    return summaries.fetch_summary(raw)


@query("select topic, count(*) filter (difficulty = 'basic') as basic, count(*) filter (difficulty = 'intermediate') as intermediate, count(*) filter (difficulty = 'advanced') as advanced from evaluation_queries_blueprint group by topic")
def topic_difficulty_pivot(spark, folder):
    return summaries.topic_difficulty(table(spark, folder, "evaluation_queries_blueprint"))


@query("select topic, count(*) as num_rows from evaluation_queries_blueprint group by topic union all select difficulty as topic, count(*) as num_rows from evaluation_queries_blueprint group by difficulty")
def query_distribution(spark, folder):
    """Questions by topic and by difficulty."""
    asked = table(spark, folder, "evaluation_queries_blueprint")
    return summaries.value_counts(asked, "topic").unionByName(summaries.value_counts(asked, "difficulty").withColumnRenamed("difficulty", "topic"))


@query("select source_id, type, trust_level, len(seed_urls)::BIGINT as num_seed_urls, array_to_string(allowed_domains, ', ') as allowed_domains, array_to_string(topic_tags, ', ') as topic_tags from source_registry")
def registry_overview(spark, folder):
    return summaries.registry_overview(table(spark, folder, "source_registry")).withColumn("num_seed_urls", F.col("num_seed_urls").cast("long"))


@query(
    """with e as (select min(word_count)::DOUBLE as lo, max(word_count)::DOUBLE as hi from embedding_records), b as (select least(floor((word_count - lo) / ((hi - lo) / 30)), 29)::BIGINT as bin from embedding_records cross join e where word_count is not null)
select bin, count(*) as rows from b group by bin"""
)
def chunk_histogram(spark, folder):
    return sampling.histogram(table(spark, folder, "embedding_records"), "word_count").select("bin", "rows")


@query(
    """with t as (select topic, row_number() over (order by topic) as t from (select distinct topic from heldout_items)), s as (select *, unnest(range(0, 10)) as s from t)
select 'Q' || case when (t - 1) * 10 + s + 1 < 1000 then lpad(((t - 1) * 10 + s + 1)::VARCHAR, 3, '0') else ((t - 1) * 10 + s + 1)::VARCHAR end as query_id, topic, case when s < 3 then 'basic' when s < 8 then 'intermediate' else 'advanced' end as difficulty, topic || '__' || lpad((s + 1)::VARCHAR, 2, '0') as topic_slot from s"""
)
def query_blueprint(spark, folder):
    """Ten blank questions for each topic."""
    return evaluation.blueprint(table(spark, folder, "heldout_items")).select("query_id", "topic", "difficulty", "topic_slot")


@query("select user_id, event_type, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def dedupe_keep_last(spark, folder):
    """The last event of each user and kind."""
    return sampling.keep_last(table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("select doc_id from documents d where not exists (select 1 from doc_labels l where l.doc_id = d.doc_id)")
def anti_join_resume(spark, folder):
    """The documents that have no label yet."""
    return sampling.pending(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "doc_labels"), ["doc_id"])


_STRATUM = "coalesce(topic, '') || '||' || coalesce(difficulty, '')"


@query(
    f"""with k as (select query_id, draft_source, topic, {_STRATUM} as stratum, md5('42:' || query_id) as key from evaluation_queries_blueprint), t as (select *, row_number() over (partition by draft_source, stratum order by key, query_id) as turn from k),
p as (select *, row_number() over (partition by draft_source order by turn, stratum, query_id) as pick from t) select query_id, draft_source, pick from p where pick <= 20"""
)
def stratified_round_robin(spark, folder):
    """Twenty questions of each origin, in turn from topics and difficulties."""
    taken = sampling.stratified_take(table(spark, folder, "evaluation_queries_blueprint"), ["draft_source"], ["topic", "difficulty"], "query_id", 20)
    return taken.select("query_id", "draft_source", F.col("pick").cast("long").alias("pick"))


@query(
    f"""with q as (select query_id, draft_source, topic, {_STRATUM} as stratum from evaluation_queries_blueprint),
one as (select * from (select *, row_number() over (partition by draft_source, topic order by md5('42:' || query_id), query_id) as n from q) where n = 1),
rest as (select q.*, row_number() over (partition by q.draft_source, q.stratum order by md5('142:' || q.query_id), q.query_id) as turn from q where query_id not in (select query_id from one)),
more as (select *, row_number() over (partition by draft_source order by turn, stratum, query_id) as pick from rest),
every as (select query_id, draft_source, topic, 0 as round, 0 as pick from one union all select query_id, draft_source, topic, 1, pick from more where pick <= 20),
placed as (select *, row_number() over (partition by draft_source order by round, pick, topic, query_id) as place from every)
select query_id, draft_source, place as pick from placed where place <= 20"""
)
def balanced_sample(spark, folder):
    """Twenty questions of each origin, one of each topic first."""
    taken = sampling.balanced_sample(table(spark, folder, "evaluation_queries_blueprint"), ["draft_source"], "topic", ["topic", "difficulty"], "query_id", 20)
    return taken.select("query_id", "draft_source", F.col("pick").cast("long").alias("pick"))
