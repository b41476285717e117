"""Queries of the pipeline's remaining operators: lists and formats, page rules, parsing by type, joins, judging and reports.

Each reads its whole tables; the SQL beside it gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import quality
from ..functions import text as T
from ..functions.vectors import norm
from ..operators import evaluation, generation, judging, reports, sampling
from ..operators.embedding import embedding_records
from ..planning import once
from ..sources import catalog, dispatch, pages, raw
from ..sources.tables import chunk_lookup as _chunk_lookup
from .queries import _LAST, _SAID, _answers, _hits, _last_answers, _q, _retrieved, _slug, _words, _ws, documents, html_sections, printed_pages, query, table

# --- lists and formats -----------------------------------------------------------------

_FORMS = """f as (select result_id, citations, case result_id % 6 when 0 then to_json(citations)::VARCHAR when 1 then '[' || array_to_string(list_transform(citations, lambda c: '''' || c || ''''), ', ') || ']'
when 2 then '[' || array_to_string(citations, ', ') || ']' when 3 then 'nan' when 4 then ' ' || coalesce(citations[1], '') || ' ' else null end as said from generation_results_smoke_v1 where citations is not null)"""


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """The citations of all answers written in six ways: as JSON, as a literal, bare, as nan, as one entry, not at all."""
    rows = _answers(spark, folder).filter("citations is not null").select("result_id", "citations")
    form = F.pmod("result_id", F.lit(6))
    literal = F.concat(F.lit("["), F.array_join(F.transform("citations", lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))
    bare = F.concat(F.lit("["), F.array_join("citations", ", "), F.lit("]"))
    one = F.concat(F.lit(" "), F.coalesce(F.get("citations", F.lit(0)), F.lit("")), F.lit(" "))
    return rows.withColumn("said", F.when(form == 0, F.to_json("citations")).when(form == 1, literal).when(form == 2, bare).when(form == 3, "nan").when(form == 4, one))


_ONE = "case when coalesce(citations[1], '') = '' then [] else [citations[1]] end"


@query(f"with {_FORMS} select result_id, case result_id % 6 when 3 then [] when 4 then {_ONE} when 5 then [] else citations end as cited from f")
def parse_lists_any_form(spark, folder):
    """Lists in all forms read back: JSON, literals and bare ones."""
    return _written(spark, folder).select("result_id", T.parse_list(F.col("said")).alias("cited"))


@query(f"with {_FORMS} select result_id, case result_id % 6 when 0 then citations when 3 then [] when 4 then {_ONE} when 5 then [] else case when len(citations) = 0 then [] else [said] end end as cited from f")
def parse_lists_json_only(spark, folder):
    """The reader that knows JSON only: other forms are one entry."""
    return _written(spark, folder).select("result_id", T.parse_json_list(F.col("said")).alias("cited"))


@query(f"with {_FORMS} select result_id, case result_id % 6 when 0 then citations when 1 then citations when 2 then case when len(citations) = 0 then [] else [said] end when 4 then {_ONE} when 5 then [] else [said] end as cited from f")
def parse_lists_literal(spark, folder):
    """The reader that knows JSON and literals, and for which nan is an entry."""
    return _written(spark, folder).select("result_id", T.parse_literal_list(F.col("said")).alias("cited"))


@query("select result_id, '[' || array_to_string(list_transform(citations, lambda c: '\"' || c || '\"'), ',') || ']' as encoded from generation_results_smoke_v1 where citations is not null")
def encode_lists(spark, folder):
    """Lists as JSON text, as a table of text keeps them."""
    return _answers(spark, folder).filter("citations is not null").select("result_id", F.to_json("citations").alias("encoded"))


@query("select event_id, printf('%.4f', round(value, 4)) as four, printf('%.2f', round(value, 2)) as two, printf('%.1f', round(value * 100, 1)) || '%' as share from events where value is not null")
def number_formats(spark, folder):
    """Numbers with so many digits, and as shares."""
    value = F.col("value")
    return table(spark, folder, "events").filter("value is not null").select("event_id", T.fixed(F.round(value, 4), 4).alias("four"), T.fixed(F.round(value, 2), 2).alias("two"), T.percent(F.round(value * 100, 1) / 100, 1).alias("share"))


@query("select doc_id, coalesce(page_number::VARCHAR, '') as page from documents")
def page_labels(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.page_label(F.col("page_number")).alias("page"))


@query("select query_id, array_to_string(list_transform(string_split(lower(replace(topic, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title from evaluation_queries_blueprint")
def topic_titles(spark, folder):
    return table(spark, folder, "evaluation_queries_blueprint").select("query_id", T.title_of(F.col("topic")).alias("title"))


@query(f"select distinct {_slug('source')} || '__' || {_slug('snapshot_id')} as collection from documents where source is not null and snapshot_id is not null")
def collection_names(spark, folder):
    """The name of each source's collection in each snapshot."""
    return table(spark, folder, "documents").filter("source is not null and snapshot_id is not null").select(T.collection_name(F.col("source"), F.col("snapshot_id")).alias("collection")).distinct()


_REST = "regexp_replace(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')"
_KIND = "case doc_id % 5 when 0 then 'text/HTML; charset=utf-8' when 1 then 'application/json' when 2 then 'application/pdf' when 3 then null else 'application/octet-stream' end"


@query(f"""with k as (select doc_id, lower(coalesce({_KIND}, '')) as kind, regexp_extract(regexp_extract({_REST}, '^([^?#]*)', 1), '[^/](\\.[^./]+)$', 1) as suffix from documents)
select doc_id, case when contains(kind, 'html') then '.html' when contains(kind, 'json') then '.json' when contains(kind, 'pdf') then '.pdf' when suffix is null or suffix = '' then '.bin' else suffix end as extension from k""")
def file_extensions(spark, folder):
    """Extensions by content type, else by the URL."""
    n = F.pmod("doc_id", F.lit(5))
    kind = F.when(n == 0, "text/HTML; charset=utf-8").when(n == 1, "application/json").when(n == 2, "application/pdf").when(n == 4, "application/octet-stream")
    return table(spark, folder, "documents").select("doc_id", T.infer_extension(kind, F.col("source_url")).alias("extension"))


def _clean_sql(x: str) -> str:
    opened = f"regexp_replace({x}, {_q(f'{C.SPACE}*¶{C.SPACE}*')}, ' ', 'g')"
    return f"regexp_replace({_ws(f'regexp_replace({opened}, {_q(f'{C.SPACE}*--+{C.SPACE}*$')}, {_q('')})')}, '[ ]+([.,;:!?])', '\\1', 'g')"


@query(f"select doc_id, {_clean_sql('text')} as text from documents where text is not null")
def clean_markup_text(spark, folder):
    """Texts cleaned as those of markup are."""
    return documents(spark, folder).filter("text is not null").select("doc_id", T.clean_html_text(F.col("text")).alias("text"))


def _page_sql(x: str) -> str:
    plain = f"replace(replace(replace({x}, chr(23), ' '), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    # look-around by groups: twice, since neighbours share a letter
    joined = plain
    for _ in range(2):
        joined = f"regexp_replace({joined}, {_q(f'([A-Za-z])-{C.SPACE}+([A-Za-z])')}, '\\1\\2', 'g')"
    return f"regexp_replace(trim(regexp_replace({_ws(joined)}, {_q(f'{C.SPACE}*--+{C.SPACE}*$')}, '')), '[ ]+([.,;:!?])', '\\1', 'g')"


@query(f"select doc_id, {_page_sql('text')} as text from documents where text is not null")
def clean_printed_text(spark, folder):
    """Texts cleaned as those of printed pages are."""
    return documents(spark, folder).filter("text is not null").select("doc_id", T.clean_page_text(F.col("text")).alias("text"))


_ITEMS = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_clean_sql('x')}), lambda x: x <> '')"


@query(f"with i as (select doc_id, {_ITEMS} as l from documents where text is not null) select doc_id, list_filter(l, lambda x, i: i = 1 or x <> l[i - 1]) as items from i")
def dedupe_consecutive(spark, folder):
    """The lines of each text without those equal to the one before."""
    docs = once(documents(spark, folder).filter("text is not null").select("doc_id", "text"), _lines=F.split("text", "\n", -1))
    return docs.select("doc_id", T.dedupe_consecutive(F.col("_lines")).alias("items"))


# --- page rules ------------------------------------------------------------------------

_P = f"p as (select doc_id, 1 + doc_id % 20 as page, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_ws('x')}), lambda x: x <> '') as l, {_ws('text')} as t, lower({_ws('text')}) as w from documents where text is not null)"
_HEAD4, _HEAD6 = "array_to_string(l[1:4], ' ')", "array_to_string(l[1:6], ' ')"
_TOC = f"(contains(lower({_HEAD6}), 'contents') and (len(list_filter(l, lambda x: regexp_matches(x, {_q(C.DOT_LEADER)}))) >= 2 or len(list_filter(l, lambda x: {_words('x')} <= 10)) >= 8))"
_IDX = f"((contains(w, 'index |') or starts_with(w, 'index ')) and ({_hits('t', C.PAGE_REFERENCE)} >= 8 or contains(w, 'see also')))"
_REFS = f"(regexp_matches({_HEAD4}, {_q(C.REFERENCES)}) and ({_hits('w', 'https?://')} >= 2 or {_hits('w', 'doi')} >= 2 or {_hits('t', '[\\[\\]]')} >= 6))"
_ABBR = f"(regexp_matches({_HEAD4}, {_q(C.ABBREVIATIONS)}) and len(list_filter(string_split(t, ' '), lambda x: x = upper(x) and x <> lower(x) and length(x) between 2 and 8)) >= 12)"
_PUBL = f"(regexp_matches(w, {_q(C.BOOK_BACK_MATTER)}) or (page <= 12 and regexp_matches(w, {_q(C.PUBLISHER_FRONT_MATTER)})) or (page <= 10 and ((contains(w, 'copyright ©') and contains(w, 'packt publishing')) or contains(w, 'for my lovely wife'))))"
_VEND = f"((page >= 16 and contains(w, 'copyright ©')) or (page >= 15 and regexp_matches(w, {_q(C.VENDOR_MARKETING)})))"
_COVER = "(page = 1 and contains(w, 'cybersecurity technical report') and contains(w, 'kubernetes hardening guid'))"
_OPEN = f"(page <= 8 and (starts_with(w, 'notices and history') or contains(w, 'document change history') or starts_with(w, 'publication information') or starts_with(w, 'figures ') or regexp_matches(w, {_q(C.THESIS_FRONT_MATTER)})))"
_MATTER = f"({_COVER} or {_TOC} or {_IDX} or {_REFS} or regexp_matches(w, {_q(C.COLOPHON)}) or {_ABBR} or {_PUBL} or {_VEND} or {_OPEN} or starts_with(w, 'preface ') or w = 'preface')"


@query(f"with {_P} select doc_id, {_TOC} as contents, {_IDX} as idx, {_REFS} as refs, {_ABBR} as abbreviations, {_PUBL} as publisher, {_VEND} as vendor, {_MATTER} as front_or_back from p")
def page_rules(spark, folder):
    """What each text would be as a page: contents, index, references, abbreviations, publisher's or vendor's matter."""
    docs = documents(spark, folder).filter("text is not null").select("doc_id", (1 + F.pmod("doc_id", F.lit(20))).alias("_page"), "text")
    lines = F.filter(F.transform(F.split("text", "\n", -1), T.collapse_whitespace), lambda x: x != "")
    rows = once(docs, _lines=lines, _text=T.collapse_whitespace(F.col("text")))
    page, said, text = F.col("_page"), F.col("_lines"), F.col("_text")
    return rows.select(
        "doc_id", quality.contents_page(said).alias("contents"), quality.index_page(text).alias("idx"), quality.references_page(said, text).alias("refs"), quality.abbreviations_page(said, text).alias("abbreviations"),
        quality.publisher_matter(page, text).alias("publisher"), quality.vendor_back_matter(page, text).alias("vendor"), quality.front_or_back_matter(page, said, text).alias("front_or_back"),
    )


@query(f"""with t as (select doc_id, case when doc_id % 2 = 0 then title end as title, source_url as url from documents), n as (select doc_id, title, regexp_extract(rtrim(regexp_extract(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^([^?#]*)', 1), '/'), '([^/]*)$', 1) as name from t)
select doc_id, {_page_sql("coalesce(nullif(title, ''), nullif(name, ''), 'Untitled PDF')")} as title from n""")
def page_titles(spark, folder):
    """Titles of printed files: from their metadata, else their names."""
    return table(spark, folder, "documents").select("doc_id", pages.page_title(F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("title")), F.col("source_url")).alias("title"))


_SLUGS = "list_transform({0}, lambda x: " + _slug("x") + ")"
query(
    f"""with i as (select coalesce(source_id, 'unknown') as source_id, page_key, source_url, {_clean_sql("coalesce(title, 'Page')")} as title, {_ITEMS.replace("text", "coalesce(text, '')")} as l from documents),
p as (select *, case when title = '' then 'x' else title end as named, {_clean_sql("array_to_string(list_filter(l, lambda x, i: i = 1 or x <> l[i - 1]), ' ')")} as text from i),
k as (select *, {_slug("page_key")} as key from p where length(text) >= {C.MIN_SECTION_CHARS} and not regexp_matches(named, {_q(C.LOW_SIGNAL_HEADING)}) and not regexp_matches(text, {_q(C.LOW_SIGNAL_TEXT)}))
select {_slug("source_id")} || '__' || key || '__' || {_slug("named")} || '__0001' as doc_id, source_id, key as page_key, named as title, [named] as section_path, text from k"""
)(html_sections)


_BOILER = f"""(regexp_matches(line, {_q(C.PAGE_ONLY)}) or regexp_matches(line, {_q(C.PUNCT_ONLY)}) or regexp_matches(line, {_q(C.DOT_LEADER)}) or regexp_matches(lower(line), {_q(C.REPORT_HEADER)})
or (regexp_matches(lower(line), {_q(C.AGENCY)}) and repeats >= greatest(3, pages // 12)) or (length(line) between 1 and 14 and repeats >= greatest(3, pages // 10)) or (length(line) <= 120 and repeats >= greatest(5, pages // 8)))"""
_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
query(
    f"""with d as (select doc_id as page, source_id, source, text as raw from documents where source_id is not null), t as (select source_id, count(distinct page) as pages from d group by source_id),
s as (select page, source_id, string_split(regexp_replace(raw, {_q(_BREAKS)}, chr(1), 'g'), chr(1)) as x from d where raw is not null),
l as (select page, source_id, no, {_page_sql("replace(line, chr(0), ' ')")} as line from (select page, source_id, unnest(range(1, len(x) + 1)) as no, unnest(x) as line from s)),
n as (select source_id, line, count(distinct page) as repeats from l where line <> '' group by all), gone as (select source_id, line from n join t using (source_id) where {_BOILER}),
kept as (select l.* from l where line <> '' and not exists (select 1 from gone g where g.source_id = l.source_id and g.line = l.line)),
w as (select source_id, page, list(line order by no) as l from kept group by all), j as (select *, {_page_sql("array_to_string(l, ' ')")} as t from w), m as (select *, lower(t) as w from j where length(t) >= {C.MIN_PAGE_CHARS}),
a as (select source_id, min(source) as title from d group by source_id)
select {_slug("m.source_id")} || '__' || {_slug("m.source_id")} || '__page_' || printf('%04d', page) as doc_id, m.source_id, page::BIGINT as page_number, title, [title, 'Page ' || page] as section_path, t as text from m join a on a.source_id = m.source_id where not {_MATTER}"""
)(printed_pages)


# --- sources ---------------------------------------------------------------------------

_LONG = " is described here at some length for readers."


@query(f"""with h as (select 'guide_section' as doc_kind, {_ws('query_text')} || {_q(_LONG)} as text from evaluation_queries_blueprint where query_text is not null and not regexp_matches(query_text, '[<>&¶]|--|[ ][.,;:!?]')),
f as (select 'cve_feed_item' as doc_kind, 'CVE ID: ' || event_type || ' Summary: ' || 'event number ' || event_id || ' of user ' || user_id as text from events),
u as (select * from h union all select * from f)
select doc_kind, count(*) as num_docs, sum(length(text))::BIGINT as num_chars from u where length(text) >= 40 group by doc_kind""")
def parsed_by_type(spark, folder):
    """Pages of all questions and feeds of all events, each parsed as its type says."""
    clean = ~F.col("query_text").rlike("[<>&¶]|--|[ ][.,;:!?]")
    asked = table(spark, folder, "evaluation_queries_blueprint").filter(F.col("query_text").isNotNull() & clean)
    page = F.concat(F.lit("<html><body><main><h1>Questions</h1><p>"), "query_text", F.lit(_LONG), F.lit("</p></main></body></html>"))
    nothing = F.lit(None).cast("string")
    shared = [F.lit("https://site.example/a").alias("source_url"), F.lit("official").alias("trust_level"), F.array().cast("array<string>").alias("topic_tags")]
    texts = F.lit(None).cast("array<string>").alias("page_texts")
    web = asked.select(F.lit("web").alias("source_id"), F.lit("html").alias("source_type"), *shared, F.col("query_id").alias("document_key"), nothing.alias("title"), page.alias("body"), texts)
    item = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("id"), F.concat(F.lit("event number "), "event_id", F.lit(" of user "), "user_id").alias("summary"))).alias("items")))
    feeds = table(spark, folder, "events").select(F.lit("feed").alias("source_id"), F.lit("json_feed").alias("source_type"), *shared, F.concat(F.lit("event "), "event_id").alias("document_key"), nothing.alias("title"), item.alias("body"), texts)
    docs = dispatch.parse_items(web.unionByName(feeds))
    return docs.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("num_docs"), F.sum(F.length("text")).cast("long").alias("num_chars"))


@query("select doc_id::VARCHAR as url, sha256(text) as sha256, strlen(text)::BIGINT as byte_size, '.html' as extension from documents where text is not null and doc_id % 7 <> 0")
def raw_snapshot(spark, folder):
    """What a snapshot keeps of the texts as fetched pages; a seventh of them fail."""
    docs = table(spark, folder, "documents").filter("text is not null")
    ok = F.pmod("doc_id", F.lit(7)) != 0
    fetched = docs.select("source_id", F.col("doc_id").cast("string").alias("url"), ok.alias("ok"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), F.lit("utf-8").alias("encoding"), F.encode("text", "UTF-8").alias("content"), F.lit("2030-01-01T00:00:00Z").alias("fetched_at"))
    return raw.raw_items(fetched, "s1").select("url", "sha256", "byte_size", "extension")


@query("select 's1' as snapshot_id, source_id, doc_id::VARCHAR as requested_url, 'HTTPError' as error_type, 'status ' || (400 + doc_id % 100) as error_message from documents where doc_id % 7 = 0")
def fetch_failures(spark, folder):
    """The errors of the pages that could not be fetched."""
    docs = table(spark, folder, "documents").filter("doc_id % 7 = 0")
    fetched = docs.select("source_id", F.col("doc_id").cast("string").alias("url"), F.lit(False).alias("ok"), F.lit("HTTPError").alias("error_type"), F.concat(F.lit("status "), 400 + F.pmod("doc_id", F.lit(100))).alias("error_message"))
    return raw.failures(fetched, "s1")


@query("select doc_id, text from documents where text is not null and not contains(text, chr(0))")
def decoded_bodies(spark, folder):
    """Bodies read back as text by their recorded encoding."""
    docs = table(spark, folder, "documents").filter("text is not null and not contains(text, char(0))")
    return docs.select("doc_id", raw.decoded(F.encode("text", "UTF-8"), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.lit("utf-8"))).alias("text"))


@query("select max(snapshot_id) as snapshot_id from summary")
def latest_snapshot(spark, folder):
    """The latest snapshot of the manifest."""
    return catalog.latest(table(spark, folder, "summary")).select("snapshot_id")


_PATH = f"array_to_string({_SAID}, ' > ')"


@query(f"""select doc_id, {_PATH} as section_path_text, 'kind, ' || doc_kind as topic_tags_text, concat_ws(chr(10), case when {_ws('title')} <> '' then 'Title: ' || {_ws('title')} end, case when len({_SAID}) > 0 then 'Section: ' || {_PATH} end, case when {_ws('text')} <> '' then 'Content: ' || {_ws('text')} end) as retrieval_text from documents where doc_kind is not null""")
def embedding_inputs(spark, folder):
    """What is embedded of each document: joined path and tags, and the retrieval text."""
    docs = documents(spark, folder).filter("doc_kind is not null").withColumn("topic_tags", F.array(F.lit("kind"), "doc_kind"))
    return embedding_records(docs).select("doc_id", "section_path_text", "topic_tags_text", "retrieval_text")


# --- joins -------------------------------------------------------------------------------


@query("""with c as (select doc_id::VARCHAR as chunk_id, title, source_url from documents) select vec_id, doc_id::VARCHAR as chunk_id, c.title, c.source_url from embedding_records e left join c on e.doc_id::VARCHAR = c.chunk_id""")
def chunk_lookup(spark, folder):
    """The vectors' records with the place of their chunk, also those whose chunk is unknown."""
    records = table(spark, folder, "embedding_records").select("vec_id", F.col("doc_id").cast("string").alias("chunk_id"))
    chunks = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "title", "source_url")
    return _chunk_lookup(records, chunks).select("vec_id", "chunk_id", "title", "source_url")


@query("select result_id, 'QW_' || variant as system, variant as retrieval_variant from generation_results_smoke_v1 where variant is not null")
def system_variants(spark, folder):
    """The retrieval variant of each system of the second model."""
    rows = _answers(spark, folder).filter("variant is not null").withColumn("system", F.concat(F.lit("QW_"), "variant"))
    return rows.select("result_id", "system", evaluation.retrieval_variant(F.col("system")).alias("retrieval_variant"))


@query("""with b as (select variant, count(*) as num_cases, round(avg(case when isnan(bertscore_f1) then null else bertscore_f1 end), 6) as bertscore_f1 from bertscore_results group by variant), m as (select variant, min(model_name) as model_name from generation_results_smoke_v1 where variant is not null group by variant)
select b.variant, num_cases, bertscore_f1, model_name from b left join m on b.variant = m.variant""")
def bertscore_by_model(spark, folder):
    """Mean scores by variant with the name of its model."""
    scores = table(spark, folder, "bertscore_results").withColumn("bertscore_f1", F.when(~F.isnan("bertscore_f1"), F.col("bertscore_f1")))
    means = scores.groupBy("variant").agg(F.count(F.lit(1)).alias("num_cases"), F.round(F.avg("bertscore_f1"), 6).alias("bertscore_f1"))
    return reports.with_model_names(means, _answers(spark, folder)).select("variant", "num_cases", "bertscore_f1", "model_name")


@query("select result_id, variant, model_name, null::VARCHAR as answer_text from generation_results_smoke_v1 where result_id % 2 = 0 union all select result_id, variant, null as model_name, answer_text from generation_results_smoke_v1 where result_id % 2 = 1")
def union_of_runs(spark, folder):
    """Answers of two runs whose tables have different columns."""
    answers = _answers(spark, folder)
    one, other = answers.filter("result_id % 2 = 0").select("result_id", "variant", "model_name"), answers.filter("result_id % 2 = 1").select("answer_text", "variant", "result_id")
    return reports.all_answers(one, other).select("result_id", "variant", "model_name", "answer_text")


@query("select result_id from generation_results_smoke_v1 g where exists (select 1 from proxy_eval_summary_by_variant p where p.variant = g.variant and p.model_name is not null)")
def semi_join_known_systems(spark, folder):
    """The answers of systems that a summary knows."""
    known = table(spark, folder, "proxy_eval_summary_by_variant").filter("model_name is not null").select("variant")
    return _answers(spark, folder).join(known, "variant", "left_semi").select("result_id")


@query(f"with {_LAST} select a.query_id, a.variant, count(*) as cases from a join evaluation_queries_blueprint q on a.query_id = q.query_id where len(citations) > 0 group by all")
def asserted_cases(spark, folder):
    """Cases whose question and retrieval must be there: an unknown one would be an error."""
    questions = table(spark, folder, "evaluation_queries_blueprint")
    answers = _last_answers(spark, folder).filter(F.size("citations") > 0).join(questions.select("query_id"), "query_id", "left_semi")
    cases = evaluation.evaluation_cases(answers, questions, _retrieved(answers), strict=True)
    return cases.groupBy("query_id", "variant").agg(F.count(F.lit(1)).alias("cases"))


# --- judging ------------------------------------------------------------------------------

_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'))"
_JUDGED = f"""j as (select a.query_id, a.variant, {_TOKENS.format('answer_text_plain')} as a, {_TOKENS.format('query_text')} as q, {_TOKENS.format('reference_answer')} as r from a join evaluation_queries_blueprint b on a.query_id = b.query_id),
s as (select query_id, variant, case when len(a) = 0 or len(q) = 0 then null else round(len(list_intersect(q, a)) / len(q), 6) end as answer_relevance, case when len(a) = 0 or len(r) = 0 then null else round(len(list_intersect(r, a)) / len(a), 6) end as faithfulness, case when len(a) = 0 then 'ValueError: empty answer' end as ragas_error from j)"""


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    about = table(spark, folder, "evaluation_queries_blueprint").select("query_id", F.col("query_text").alias("question"), F.col("reference_answer").alias("ground_truth"))
    cases = _last_answers(spark, folder).select("query_id", "variant", F.col("answer_text_plain").alias("answer")).join(about, "query_id")
    scored = judging.judge(cases, judging.OverlapScorer(), ["query_id", "variant"], ["answer", "question", "ground_truth"])
    return scored.select("query_id", "variant", *(F.round(m, 6).alias(m) for m in ("answer_relevance", "faithfulness")), "ragas_error")


@query(f"with {_LAST}, {_JUDGED} select * from s")
def judge_scores(spark, folder):
    """Every case scored by the offline judge, with the error of those that fail."""
    return _judged(spark, folder)


@query(f"with {_LAST}, {_JUDGED} select s.query_id, s.variant, answer_relevance, faithfulness, ragas_error from s where faithfulness is null or answer_relevance is null or substring(query_id, length(query_id), 1) in ('1', '3', '5', '7', '9')")
def judge_resumed(spark, folder):
    """What a second run scores: cases that the first has not finished, which are those of odd questions and of failures."""
    first = _judged(spark, folder).filter("substring(query_id, -1, 1) in ('0', '2', '4', '6', '8')").withColumn("ordinal", F.lit(1).cast("long"))
    about = table(spark, folder, "evaluation_queries_blueprint").select("query_id", F.col("query_text").alias("question"), F.col("reference_answer").alias("ground_truth"))
    cases = _last_answers(spark, folder).select("query_id", "variant", F.col("answer_text_plain").alias("answer")).join(about, "query_id")
    scored = judging.judge_pending(cases, first, judging.OverlapScorer(), ["query_id", "variant"], ["answer", "question", "ground_truth"])
    return scored.select("query_id", "variant", *(F.round(m, 6).alias(m) for m in ("answer_relevance", "faithfulness")), "ragas_error")


_MS = ", ".join(f"{'round(avg(answer_relevance), 4)' if m == 'answer_relevance' else 'round(avg(faithfulness), 4)' if m == 'faithfulness' else 'null::DOUBLE'} as {m}_mean, {'round(stddev_samp(' + m + '), 4)' if m in ('answer_relevance', 'faithfulness') else 'null::DOUBLE'} as {m}_std" for m in evaluation.JUDGED)


@query(f"with {_LAST}, {_JUDGED} select variant, {_MS}, count(ragas_error) as error_count from s group by variant")
def judge_summary(spark, folder):
    """Means, deviations and errors of the judge by variant."""
    absent = [F.lit(None).cast("double").alias(m) for m in evaluation.JUDGED if m not in ("answer_relevance", "faithfulness")]
    out = evaluation.judge_summary(_judged(spark, folder).select("*", *absent))
    return out.select("variant", *(F.round(f"{m}_{k}", 4).alias(f"{m}_{k}") for m in evaluation.JUDGED for k in ("mean", "std")), "error_count")


@query()
def embedding_match_scores(spark, folder):
    """Precision, recall and F1 of all answers against the references by greedy matches of token vectors."""
    cases = _last_answers(spark, folder).join(table(spark, folder, "evaluation_queries_blueprint").select("query_id", "reference_answer"), "query_id")
    return judging.embedding_match_scores(cases).select("query_id", "variant", *(F.round(c, 6).alias(c) for c in evaluation.BERTSCORE))


@query("select v.vec_id, round(greatest(0.0, least(1.0, list_dot_product(v.embedding::DOUBLE[], n.embedding::DOUBLE[]))), 4) as answer_relevance from embeddings v join embeddings n on n.vec_id = v.vec_id + 1")
def proxy_answer_relevance(spark, folder):
    """The similarity of each vector and the next one, as of question and answer."""
    vectors = table(spark, folder, "embeddings")
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("_answer"))
    return vectors.join(following, "vec_id").select("vec_id", evaluation.answer_relevance(F.col("embedding"), F.col("_answer")).alias("answer_relevance"))


# --- reports --------------------------------------------------------------------------------

_CASES = """c as (select event_id as query_id, event_type as variant, (user_id % 3)::VARCHAR as model_name, case when event_id % 11 = 0 then null else value end as context_relevance_proxy, value / 2 as answer_relevance_proxy, value / 3 as faithfulness_proxy, (event_id % 2)::DOUBLE as citation_validity,
case when event_id % 5 = 0 then '' else (1 + event_id % 5)::VARCHAR end as actionability_score, (1 + event_id % 4)::VARCHAR as usefulness_score, (event_id % 2)::VARCHAR as unsupported_claim_flag, case when event_id % 3 = 0 then '' else (event_id % 7 % 2)::VARCHAR end as redundancy_flag, (user_id % 10)::VARCHAR as topic, (user_id % 4)::VARCHAR as difficulty from events)"""


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """All events as scored and audited cases."""
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    text = lambda c: c.cast("string")
    return table(spark, folder, "events").select(
        i.alias("query_id"), F.col("event_type").alias("variant"), text(u % 3).alias("model_name"), F.when(i % 11 != 0, v).alias("context_relevance_proxy"), (v / 2).alias("answer_relevance_proxy"), (v / 3).alias("faithfulness_proxy"), (i % 2).cast("double").alias("citation_validity"),
        F.when(i % 5 == 0, "").otherwise(text(1 + i % 5)).alias("actionability_score"), text(1 + i % 4).alias("usefulness_score"), text(i % 2).alias("unsupported_claim_flag"), F.when(i % 3 == 0, "").otherwise(text(i % 7 % 2)).alias("redundancy_flag"), text(u % 10).alias("topic"), text(u % 4).alias("difficulty"),
    )


def _rounded(df: DataFrame, keep: tuple[str, ...], digits: int = 6) -> DataFrame:
    return df.select(*keep, *(F.round(c, digits).alias(c) for c in df.columns if c not in keep))


_CORE = "coalesce((context_relevance_proxy + answer_relevance_proxy) / 2, context_relevance_proxy, answer_relevance_proxy)"
_CORE_SQL = ", ".join(f"round(avg({e}), 6) as {n}_mean, round(stddev_samp({e}), 6) as {n}_std" for n, e in ((c, _CORE if c == "proxy_core_composite" else c) for c in reports.CORE))


@query(f"with {_CASES} select variant, model_name, count(query_id) as num_cases, {_CORE_SQL} from c group by all")
def core_summary(spark, folder):
    """Cases, means and deviations of five scores by system and model."""
    return _rounded(reports.core_summary(_cases(spark, folder)), ("variant", "model_name", "num_cases"))


_BD = "count(*) as num_cases, round(avg(context_relevance_proxy), 6) as context_relevance_proxy, round(avg(faithfulness_proxy), 6) as faithfulness_proxy"


@query(f"with {_CASES} select 'topic' as dimension, topic as value, variant, {_BD} from c group by all union all select 'difficulty' as dimension, difficulty as value, variant, {_BD} from c group by all")
def topic_and_difficulty_means(spark, folder):
    """Means by topic and by difficulty in one pass."""
    return _rounded(reports.breakdown(_cases(spark, folder), "variant", ["topic", "difficulty"], ["context_relevance_proxy", "faithfulness_proxy"]), ("dimension", "value", "variant", "num_cases"))


_AUDIT = "count(*) as num_cases, round(avg(try_cast(nullif(actionability_score, '') as DOUBLE)), 6) as actionability_mean, round(avg(try_cast(usefulness_score as DOUBLE)), 6) as usefulness_mean, round(avg(try_cast(unsupported_claim_flag as DOUBLE)), 6) as unsupported_claim_rate, round(avg(try_cast(nullif(redundancy_flag, '') as DOUBLE)), 6) as redundancy_rate"


@query(f"with {_CASES} select variant, model_name, {_AUDIT} from c group by all")
def audit_summary(spark, folder):
    """Mean scores and rates of an audit by system and model."""
    return _rounded(reports.audit_summary(_cases(spark, folder)), ("variant", "model_name", "num_cases"))


@query(f"""with {_CASES}, b as (select variant, round(avg(value), 6) as bertscore_f1 from events e join c on e.event_id = c.query_id where c.variant <> 'none' group by variant), k as (select variant, round(avg({_CORE}), 6) as core from c group by variant), u as (select variant, {_AUDIT} from c group by variant), n as (select variant, round(avg((query_id % 4 = 0)::INT), 6) as no_failure_rate from c where variant <> 'click' group by variant)
select b.variant, bertscore_f1, core as proxy_core_composite, round((actionability_mean + usefulness_mean) / 2, 4) as manual_quality_score, unsupported_claim_rate, redundancy_rate, no_failure_rate from b left join k on b.variant = k.variant left join u on b.variant = u.variant left join n on b.variant = n.variant""")
def overall_comparison(spark, folder):
    """One row a system from four summaries, one of which lacks a system."""
    cases = _cases(spark, folder)
    scores = table(spark, folder, "events").groupBy(F.col("event_type").alias("variant")).agg(F.round(F.avg("value"), 6).alias("bertscore_f1"))
    core = _rounded(reports.core_summary(cases, ("variant",)), ("variant", "num_cases"))
    audit = _rounded(reports.audit_summary(cases, groups=("variant",)), ("variant", "num_cases"))
    failures = cases.filter("variant <> 'click'").groupBy("variant").agg(F.round(F.avg((F.col("query_id") % 4 == 0).cast("int")), 6).alias("no_failure_rate"))
    out = reports.overall_comparison(scores, core, audit, failures)
    return out.withColumn("manual_quality_score", F.round("manual_quality_score", 4))


@query("""with b as (select topic, query_text, reference_answer, row_number() over (partition by topic order by item_id) as slot from heldout_items), t as (select topic, dense_rank() over (order by topic) - 1 as i from (select distinct topic from heldout_items))
select 'Q' || case when i * 10 + slot < 1000 then lpad((i * 10 + slot)::VARCHAR, 3, '0') else (i * 10 + slot)::VARCHAR end as query_id, b.topic, case when slot <= 3 then 'basic' when slot <= 8 then 'intermediate' else 'advanced' end as difficulty, b.topic || '__' || lpad(slot::VARCHAR, 2, '0') as topic_slot, query_text, reference_answer from b join t on b.topic = t.topic where slot <= 10""")
def reviewed_benchmark(spark, folder):
    """A benchmark of ten reviewed questions a topic; a topic with fewer would be an error."""
    slot = F.row_number().over(Window.partitionBy("topic").orderBy("item_id"))
    bank = table(spark, folder, "heldout_items").withColumn("slot", slot).filter("slot <= 10")
    return evaluation.reviewed_benchmark(bank).select("query_id", "topic", "difficulty", "topic_slot", "query_text", "reference_answer")


@query("select 'F' || lpad(i::VARCHAR, 2, '0') as case_id, '' as failure_label, '' as notes from range(1, 13) t(i)")
def failure_template(spark, folder):
    """Twelve blank rows for a failure analysis, their labels checked."""
    return evaluation.checked_labels(evaluation.failure_template(spark)).select("case_id", "failure_label", "notes")


@query("select result_id, '' as actionability_score, '' as notes from generation_results_smoke_v1")
def audit_sheet(spark, folder):
    """All answers with empty columns to fill in."""
    return sampling.audit_sheet(_answers(spark, folder).select("result_id"), ["actionability_score", "notes"])


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1")
def dedupe_keep_first(spark, folder):
    """The first event of each user and kind."""
    return sampling.keep_first(table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""select variant, row_number() over (order by case variant when 'V3' then 1 when 'V1' then 2 when 'V2' then 3 else 4 end, variant) as place from (select distinct variant from generation_results_smoke_v1 where variant is not null)""")
def ordered_systems(spark, folder):
    """The systems in a given order, unknown ones last."""
    systems = _answers(spark, folder).filter("variant is not null").select("variant").distinct()
    place = evaluation.order_of(F.col("variant"), ["V3", "V1", "V2"])
    return systems.select("variant", F.row_number().over(Window.orderBy(place, "variant")).cast("long").alias("place"))  # systems are few


@query("select source_id, list_sort(list_distinct(list(doc_kind) filter (doc_kind is not null))) as kinds from documents where source_id is not null group by source_id")
def distinct_sorted(spark, folder):
    """The kinds of documents of each source, sorted."""
    return table(spark, folder, "documents").filter("source_id is not null").groupBy("source_id").agg(F.array_sort(F.collect_set("doc_kind")).alias("kinds"))


@query("select distinct query_id, variant, model_name from generation_results_smoke_v1")
def distinct_projection(spark, folder):
    return _answers(spark, folder).select("query_id", "variant", "model_name").distinct()


@query("select source_id, count(*) as num_docs from documents where source_id is not null group by source_id order by num_docs desc, source_id limit 10")
def top_sources(spark, folder):
    """The ten sources with the most documents."""
    return table(spark, folder, "documents").filter("source_id is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("num_docs")).orderBy(F.desc("num_docs"), "source_id").limit(10)


_TIERS = {v: tier for v, _, tier in C.VARIANTS}


@query("select v as variant, tier as model_name, case tier when 'small' then 'models/small-2b' else 'models/strong-7b' end as model_id from (values " + ", ".join(f"({_q(v)}, {_q(t)})" for v, t in _TIERS.items()) + ") x(v, tier)")
def model_map(spark, folder):
    """The model of each variant and the id it is loaded by."""
    variants = spark.createDataFrame([(v,) for v in _TIERS], "variant string")
    named = variants.withColumn("model_name", generation.model_name(F.col("variant")))
    return named.withColumn("model_id", generation.model_id(F.col("model_name"), {"small": "models/small-2b", "strong": "models/strong-7b"}))


@query("select vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) as length from embeddings")
def vector_lengths(spark, folder):
    """The length of each vector, which is one."""
    return table(spark, folder, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("length"))
