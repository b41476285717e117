"""SQL that DuckDB can run for the queries of this package that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9]+')"
_SPACES = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUNS = r"len(regexp_extract_all({0}, '[^ \t\r\n]+'))"


def _grams(table: str, key: str, words: str, n: int) -> str:
    return f"select {key}, unnest(list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i : i + {n - 1}], ' '))) as g from {table}"


_NEAREST = """
with v as (select vec_id, embedding::DOUBLE[] as e from embedding_records r join (select distinct snapshot_id, embedding_dimension from summary) s on r.snapshot_id = s.snapshot_id
  where len(embedding) = embedding_dimension and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
c as (select a.vec_id as q, b.vec_id as n, round(list_cosine_similarity(a.e, b.e), 12) as s from v a join v b on len(a.e) = len(b.e) and a.vec_id <> b.vec_id),
t as (select *, row_number() over (partition by q order by s desc, n) as r from c)
"""

ORACLES: dict[str, str] = {
    "p1_found": f"""
with d as (select doc_id, text, 160 - coalesce(list_sum(list_transform(section_path, lambda x: case when x is null then 0 else {_RUNS.format('x')} end)), 0) as room from documents where text <> ''),
c as (select *, {_RUNS.format('text')} as n from d),
s as (select doc_id, room, unnest(string_split(regexp_replace(replace(text, chr(10), chr(1)), '([.!?])[ \\t\\r]', '\\1' || chr(1), 'g'), chr(1))) as stretch from c where n > room)
select doc_id, (max({_RUNS.format('stretch')}) > any_value(room))::INT as hard_cut from s group by doc_id""",
    "p2_found": f"""
with w as (select doc_id, {_WORDS} as w from documents where text is not null), k as (select * from w where len(w) >= 20),
g as (select distinct doc_id, g from ({_grams('k', 'doc_id', 'w', 3)})), n as (select doc_id, count(*) as n from g group by doc_id),
m as (select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as shared from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by all)
select doc_a, doc_b from m join n a on a.doc_id = doc_a join n b on b.doc_id = doc_b where shared / (a.n + b.n - shared) >= 0.6""",
    "p2_groups": f"""
with recursive w as (select doc_id, {_WORDS} as w from documents where text is not null), g as (select distinct doc_id, g from ({_grams('(select * from w where len(w) >= 5)', 'doc_id', 'w', 5)})), n as (select doc_id, count(*) as n from g group by doc_id),
m as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from m join n x on x.doc_id = a join n y on y.doc_id = b where shared / (x.n + y.n - shared) >= 0.8),
r as (select doc_id, doc_id as root from documents union select l.b, r.root from r join l on l.a = r.doc_id),
c as (select doc_id, min(root) as class_id from r group by doc_id)
select c.doc_id, class_id, (select count(*) from l where l.a = c.doc_id) as links from c""",
    "p3_repetition": rf"""
with w as (select doc_id, text, {_WORDS} as w from documents where text is not null),
l as (select doc_id, w, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SPACES}+|{_SPACES}+$', '', 'g')), lambda x: x <> '') as l from w)
select doc_id, len(w)::INT as words, round(case when len(w) = 0 then 0 else list_sum(list_transform(w, lambda x: length(x))) / len(w) end, 6) as mean_word_length,
round(coalesce((list_sum(list_transform(l, lambda x: length(x))) - list_sum(list_transform(list_distinct(l), lambda x: length(x)))) / list_sum(list_transform(l, lambda x: length(x))), 0), 6) as repeated_line_share from l""",
    "p4_cleaned": r"""
with d as (select doc_id, source_id, page_key, text from documents where text is not null and source_id is not null),
t as (select source_id, count(distinct page_key) as pages from d group by source_id),
u as (select doc_id, source_id, page_key, string_split(text, chr(10)) as l from d),
l as (select doc_id, source_id, page_key, unnest(range(0, len(l))) as line_no, unnest(l) as line from u),
n as (select *, regexp_replace(trim(regexp_replace(lower(line), '[ \t\r]+', ' ', 'g')), '[0-9]+', '0', 'g') as norm from l),
f as (select source_id, norm from n join t using (source_id) where length(norm) >= 25 group by source_id, norm, pages having count(distinct page_key) >= 5 and 20 * count(distinct page_key) >= pages),
k as (select n.doc_id, n.line_no, n.line, f.norm is null as stays from n left join f on n.source_id = f.source_id and n.norm = f.norm),
c as (select doc_id, coalesce(string_agg(line, chr(10) order by line_no) filter (stays), '') as text, count(*) filter (not stays) as removed from k group by doc_id)
select x.doc_id, case when x.text is null or x.source_id is null then x.text else c.text end as text, case when x.text is null then null when x.source_id is null then 0 else removed end as removed_lines from documents x left join c on x.doc_id = c.doc_id""",
    "p5_ranking": """
with b as (select variant, bertscore_f1 as f1 from (select *, row_number() over (partition by query_id, variant order by scored_at desc) as r from bertscore_results) where r = 1 and f1 is not null and not isnan(f1)),
m as (select variant, avg(f1) as d from b group by variant),
v as (select p.variant, nullif(context_relevance_proxy_mean, 'nan'::DOUBLE) as a, nullif(faithfulness_proxy_mean, 'nan'::DOUBLE) as b, nullif(citation_validity_mean, 'nan'::DOUBLE) as c, d from proxy_eval_summary_by_variant p left join m on p.variant = m.variant),
e as (select variant, unnest(['a', 'b', 'c', 'd']) as s, unnest([a, b, c, d]) as x from v), n as (select count(*) as n from v),
k as (select variant, s, x, rank() over (partition by s order by x desc) + (count(*) over (partition by s, x) - 1) / 2 as r, count(*) over (partition by s) as m from e where x is not null),
g as (select variant, n - r * (n + 1) / (m + 1) as p from k, n union all select variant, (n - 1) / 2 as p from e, n where x is null),
q as (select variant, round(sum(p), 6) as points from g group by variant)
select variant, points, row_number() over (order by points desc, variant) as position from q""",
    "p4_found": r"""
with d as (select doc_id, source_id, page_key, text from documents where text is not null and source_id is not null),
t as (select source_id, count(distinct page_key) as pages from d group by source_id),
u as (select doc_id, source_id, page_key, string_split(text, chr(10)) as l from d),
l as (select doc_id, source_id, page_key, unnest(range(0, len(l))) as line_no, unnest(l) as line from u),
n as (select *, regexp_replace(trim(regexp_replace(lower(line), '[ \t\r]+', ' ', 'g')), '[0-9]+', '0', 'g') as norm from l),
f as (select source_id, norm from n join t using (source_id) where length(norm) >= 25 group by source_id, norm, pages having count(distinct page_key) >= 5 and 20 * count(distinct page_key) >= pages)
select doc_id, line_no::INT as line_no from n join f using (source_id, norm)""",
    "p5_found": """
with b as (select variant, bertscore_f1 as f1 from (select *, row_number() over (partition by query_id, variant order by scored_at desc) as r from bertscore_results) where r = 1 and f1 is not null and not isnan(f1)),
m as (select variant, avg(f1) as d from b group by variant),
v as (select p.variant, context_relevance_proxy_mean as a, faithfulness_proxy_mean as b, citation_validity_mean as c, d from proxy_eval_summary_by_variant p join m on p.variant = m.variant where a is not null and not isnan(a) and b is not null and not isnan(b) and c is not null and not isnan(c)),
r as (select variant, rank() over (order by a desc) + (count(*) over (partition by a) - 1) / 2 + rank() over (order by b desc) + (count(*) over (partition by b) - 1) / 2 + rank() over (order by c desc) + (count(*) over (partition by c) - 1) / 2 + rank() over (order by d desc) + (count(*) over (partition by d) - 1) / 2 as s from v),
o as (select variant, row_number() over (order by s, variant) as place, count(*) over () as n from r)
select variant from o where place <= n // 20""",
    "p6_found": _NEAREST + "select distinct least(q, n) as vec_a, greatest(q, n) as vec_b from t where r <= 5 and s >= 0.85",
    "p6_neighbours": _NEAREST + "select q as vec_id, n as neighbour, round(s, 6) as cosine from t where r <= 5 and s >= 0.85",
    "p9_found": f"""
with i as (select item_id, regexp_extract_all(lower(unnest([query_text, reference_answer])), '[a-z0-9]+') as w from heldout_items), ig as (select distinct item_id, g from ({_grams('i', 'item_id', 'w', 12)})),
d as (select doc_id, {_WORDS} as w from documents where text is not null), dg as ({_grams('d', 'doc_id', 'w', 12)})
select distinct doc_id, item_id from dg join ig using (g)""",
    # within one edit of an item's 12 words if what the beginnings and the ends have in common leaves out one word at most
    "p9_near": f"""
with i as (select item_id, regexp_extract_all(lower(unnest([query_text, reference_answer])), '[a-z0-9]+') as w from heldout_items),
iw as (select distinct item_id, b from (select item_id, unnest(list_transform(range(1, len(w) - 10), lambda k: w[k : k + 11])) as b from i)),
d as (select doc_id, {_WORDS} as w from documents where text is not null),
dw as (select distinct doc_id, a from (select doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda k: w[k : k + n - 1])) as a from d, (values (11), (12), (13)) x(n))),
m as (select doc_id, item_id, a, b from dw join iw on a[1:6] = b[1:6] union select doc_id, item_id, a, b from dw join iw on a[-6:] = b[-6:]),
c as (select doc_id, item_id, len(a) as n, coalesce(nullif(list_position(list_transform(range(1, 12), lambda k: a[k] is distinct from b[k]), true), 0) - 1, 11) as p,
coalesce(nullif(list_position(list_transform(range(1, 12), lambda k: a[-k] is distinct from b[-k]), true), 0) - 1, 11) as s from m)
select distinct doc_id, item_id from c where p + s >= case when n = 13 then 12 else 11 end""",
}
