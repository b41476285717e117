"""Retrieval, evaluation, sampling, generation and the sources."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunking, evaluation, generation, retrieval, sampling
from docloom.operators.embedding import HashingEmbedder, hashed_vector
from docloom.sources import catalog, feed, html, pages, raw, tables
from docloom.streaming import ingest


def test_chunk_documents_defined_cases(spark):
    rows = [(1, None, ["A"]), (2, "", None), (3, "Short text here.", ["Top", "Sub"]), (4, "Was here. See references.", ["References"]), (5, "word " * 400, None)]
    got = chunking.chunk_documents(spark.createDataFrame(rows, "doc_id int, text string, section_path array<string>")).collect()
    assert {r["doc_id"] for r in got} == {3, 5}
    assert next(r["text"] for r in got if r["doc_id"] == 3) == "Section: Top > Sub. Short text here."
    assert all(r["word_count"] <= 179 for r in got)


def test_chunks_of_a_very_long_text(spark):
    """The fold closes thousands of chunks block by block; every word is in one of them, in order."""
    text = " ".join(f"Sentence number {i} says {'a few words ' * (i % 9)}here." for i in range(20_000))
    groups = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(chunking.chunk_groups(chunking.semantic_units(F.col("t"))).alias("g")).collect()
    found = groups[0]["g"]
    assert len(found) > 1000 and sum(g["words"] for g in found) == len(text.split()) and not groups[1]["g"] and not groups[2]["g"]
    assert found[0]["first"] == 0 and found[-1]["end"] == 20_000 and all(a["end"] == b["first"] for a, b in zip(found, found[1:]))


def mmr_by_hand(sim, dots, weight):
    left, taken = list(range(len(sim))), []
    while left:
        best = max(left, key=lambda i: (weight * sim[i] - (1 - weight) * max(dots[i][j] for j in taken)) if taken else sim[i])
        taken.append(best)
        left.remove(best)
    return taken


def test_mmr_against_plain_loop(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.standard_normal((8, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[0] + 0.1
    order = np.argsort(-(x @ q))
    x = x[order]
    rows = [(1, [(float(v @ q), i, v.tolist()) for i, v in enumerate(x)])]
    df = spark.createDataFrame(rows, "q int, c array<struct<similarity_score:double,n:int,embedding:array<double>>>")
    got = [c["n"] for c in df.select(retrieval.mmr_order(F.col("c"), 8, 0.7).alias("o")).first()["o"]]
    assert got == mmr_by_hand(x @ q, x @ x.T, 0.7)


@pytest.mark.parametrize(("sources", "wanted"), [("AAAB", [1, 2, 4]), ("AAAA", [1, 2, 3])])
def test_source_cap_with_backfill(spark, sources, wanted):
    df = spark.createDataFrame([("q", s, i + 1) for i, s in enumerate(sources)], "query_id string, source_id string, place int")
    got = retrieval.cap_per_source(df, [F.col("place")], 3, 2).orderBy("rank").collect()
    assert [r["place"] for r in got] == wanted


def test_topic_bonus_is_capped(spark):
    text = "rbac role rolebinding service account least privilege"
    bonus = retrieval.topic_bonus(F.lit("rbac_and_service_accounts"), F.lit("s"), F.lit(""), F.lit(text))
    assert spark.range(1).select(bonus.alias("b")).first()["b"] == 0.03


def test_unknown_mode_is_an_error(spark):
    queries = spark.createDataFrame([("q", "t", "d", "x", [1.0], [1.0])], "query_id string, topic string, difficulty string, query_text string, query_embedding array<double>, enriched_embedding array<double>")
    corpus = spark.createDataFrame([("c", "s", "", "", 1, "t", [1.0])], "chunk_id string, source_id string, section_path_text string, source_url string, word_count int, text string, embedding array<double>")
    with pytest.raises(Exception, match="unknown retrieval mode"):
        retrieval.run_variants(queries, corpus, spark.createDataFrame([("V9", "no such", "m")], "variant string, retrieval_mode string, model_name string")).collect()


def test_hashing_embedder(spark):
    df = HashingEmbedder(16).transform(spark.createDataFrame([("a b a",), ("",), (None,)], "t string"), "t")
    got = [r["embedding"] for r in df.collect()]
    assert got[1:] == [None, None] and abs(sum(v * v for v in got[0]) - 1) < 1e-6
    assert (hashed_vector("B A a", 16) == hashed_vector("a b a", 16)).all()


def test_merge_metrics_keeps_what_is_new(spark):
    base = spark.createDataFrame([("q", "v", 0.5), ("p", "v", 0.5)], "query_id string, variant string, f1 double")
    new = spark.createDataFrame([("q", "v", 0.9, 1), ("p", "v", None, 2)], "query_id string, variant string, f1 double, extra int")
    got = {r["query_id"]: (r["f1"], r["extra"]) for r in evaluation.merge_metrics(base, new).collect()}
    assert got == {"q": (0.9, 1), "p": (0.5, 2)}


def test_winners_and_duplicates(spark):
    df = spark.createDataFrame([("c", "A", 1.0), ("c", "B", 1.0), ("d", "A", 2.0), ("d", "C", 1.0), ("e", "C", None)], "case string, system string, score double")
    assert {tuple(r) for r in evaluation.win_counts(df, "case", "system", "score").collect()} == {("A", 2), ("B", 1), ("C", 0)}
    answers = spark.createDataFrame([("q", " A  b"), ("q", "a B"), ("q", None), ("p", "x")], "query_id string, answer_text_plain string")
    assert {tuple(r) for r in evaluation.duplicate_answers(answers).collect()} == {("q", 3, 2, 1), ("p", 1, 1, 0)}
    assert evaluation.duplicate_rate(evaluation.duplicate_answers(answers.limit(0))).first()[0] is None


def test_samples(spark):
    rows = [(f"q{i:02d}", f"t{i % 3}", "easy" if i % 2 else "hard", "s") for i in range(30)]
    df = spark.createDataFrame(rows, "query_id string, topic string, difficulty string, system string")
    taken = sampling.stratified_take(df, ["system"], ["topic", "difficulty"], "query_id", 12).collect()
    counts = {}
    for r in taken:
        counts[r["topic"], r["difficulty"]] = counts.get((r["topic"], r["difficulty"]), 0) + 1
    assert len(taken) == 12 and max(counts.values()) - min(counts.values()) <= 1
    balanced = sampling.balanced_sample(df, ["system"], "topic", ["topic", "difficulty"], "query_id", 5).collect()
    assert len({r["query_id"] for r in balanced}) == 5 and {r["topic"] for r in balanced} == {"t0", "t1", "t2"}
    assert sampling.stratified_take(df.limit(0), ["system"], ["topic"], "query_id", 3).count() == 0


def test_resume(spark):
    done = spark.createDataFrame([("a", 1.0, None, 1), ("a", 2.0, None, 2), ("b", None, None, 3), ("c", 1.0, "oops", 4)], "k string, m double, error string, ordinal int")
    whole = sampling.complete_rows(done, ["k"], ["m"], "error")
    assert [(r["k"], r["m"]) for r in whole.collect()] == [("a", 2.0)]
    assert sampling.pending(spark.createDataFrame([("a",), ("b",)], "k string"), whole, ["k"]).collect()[0]["k"] == "b"


def test_generation(spark):
    retrieved = spark.createDataFrame([("q", "V1", "ask", "t", "basic", 2, "c2", "s", "p", "Second. More."), ("q", "V1", "ask", "t", "basic", 1, "c1", "s", None, "First. More.")], "query_id string, variant string, query_text string, topic string, difficulty string, rank int, chunk_id string, source_id string, section_path_text string, chunk_text string")
    cases = generation.generation_cases(retrieved, spark.createDataFrame([("V1", "m")], "variant string, model_name string"))
    row = generation.with_citations(generation.ExtractiveGenerator().transform(cases)).first()
    assert row["chunk_ids"] == ["c1", "c2"] and row["answer_text"] == "First. Second.\n\n[c1, c2]" and row["citations"] == ["c1", "c2"]


PAGE = "<html><head><title>T</title><meta name='date' content='2030'></head><body><nav><p>menu</p></nav><main><h1>Top</h1><p>Intro text that is long enough to be kept here.<p>Again <code>x</code><h2>Part ¶</h2><ul><li>An item that is long enough to be kept as text</ul><h2>References</h2><p>Long enough text below a heading of low signal.</p></main></body></html>"


def test_html_sections(spark):
    df = spark.createDataFrame([("My Source", "https://a.b/c", "official", ["x"], None, PAGE), ("s", "https://a.b/", "official", ["x"], None, None), ("s", "https://a.b/", "official", ["x"], None, "")], "source_id string, source_url string, trust_level string, topic_tags array<string>, document_key string, html string")
    got = html.sections(df).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["section_path"], r["text"]) for r in got] == [
        ("my_source__c__top__0001", ["Top"], "Intro text that is long enough to be kept here. Again x x"),
        ("my_source__c__top__part__0002", ["Top", "Part"], "An item that is long enough to be kept as text"),
    ]
    assert got[0]["title"] == "Top" and got[0]["updated_at"] == "2030"


def test_page_documents(spark):
    body = "This page has quite enough words of its own to be kept as one document, and its number is "
    rows = [("d", "Title", "S", "https://a.b/x.pdf", "official", ["t"], None, i, f"Head line\n{body}{i}.\n{i}") for i in range(1, 6)]
    got = pages.page_documents(spark.createDataFrame(rows, "document string, title string, source_id string, source_url string, trust_level string, topic_tags array<string>, document_key string, page_number int, raw_text string")).orderBy("page_number").collect()
    assert [r["doc_id"] for r in got] == [f"s__x_pdf__page_{i:04d}" for i in range(1, 6)]
    assert got[0]["text"] == f"{body}1." and got[0]["section_path"] == ["Title", "Page 1"]


def test_feed(spark):
    payload = json.dumps({"title": " Feed ", "_kubernetes_io": {"updated_at": "u"}, "items": [{"id": "CVE-1", "summary": "a  flaw", "content_text": "details of the flaw", "url": "u1"}, {"id": None}]})
    df = spark.createDataFrame([("S", "https://f/", "official", ["t"], "k", p) for p in (payload, "no json", None)], "source_id string, source_url string, trust_level string, topic_tags array<string>, document_key string, payload string")
    got = feed.feed_items(df).collect()
    assert len(got) == 1 and got[0]["doc_id"] == "s__k__cve_1" and got[0]["text"] == "CVE ID: CVE-1 Summary: a flaw details of the flaw" and got[0]["source_url"] == "u1"


def test_fetch_turns_errors_into_rows(spark):
    def opener(url):
        if "bad" in url:
            raise TimeoutError("late")
        return 200, "text/html", "utf-8", b"<p>x</p>"

    urls = spark.createDataFrame([("s", "https://a.b/x", ["a.b"]), ("s", "https://a.b/bad", ["a.b"]), ("s", "https://c.d/", ["a.b"])], "source_id string, url string, allowed_domains array<string>")
    fetched = raw.fetch(urls, opener)
    assert [r["byte_size"] for r in raw.raw_items(fetched, "snap").collect()] == [8]
    assert {r["error_type"] for r in raw.failures(fetched, "snap").collect()} == {"TimeoutError", "ValueError"}


def test_tables_and_catalog(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", ["x", "y"], "s1", "k")], "text string, section_path array<string>, snapshot_id string, source_id string")
    tables.write_jsonl(df, f"{tmp_path}/j")
    assert tables.read_chunks(spark, f"{tmp_path}/j").first()["section_path_text"] == "x > y"
    tables.write_csv(df, f"{tmp_path}/c")
    assert tables.read_csv(spark, f"{tmp_path}/c").first()["text"] == "a\nb"
    tables.write_documents(df, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d").count() == 1
    for snapshot in ("2031-01-01T000000Z", "2031-02-01T000000Z"):
        catalog.append_snapshot(spark, f"{tmp_path}/m", {"snapshot_id": snapshot, "num_documents": 3})
    assert catalog.latest(catalog.snapshots(spark, f"{tmp_path}/m")).first()["snapshot_id"] == "2031-02-01T000000Z"
    with pytest.raises(ValueError):
        catalog.append_snapshot(spark, f"{tmp_path}/m", {"snapshot_id": "x", "chunks_path": "/abs"})


def test_stream(spark, tmp_path):
    rows = [("s", "https://a.b/c", "official", ["x"], None, PAGE, "2031-01-01T00:00:00")] * 2
    spark.createDataFrame(rows, "source_id string, source_url string, trust_level string, topic_tags array<string>, document_key string, html string, fetched_at string").write.json(f"{tmp_path}/in")
    documents = html.sections(ingest.new_pages(ingest.page_stream(spark, f"{tmp_path}/in")))
    ingest.write_documents(documents, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_batched_candidates_equal_the_join(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((300, 6)), 1)
    x[100:140] = x[0]  # ties at the edge
    corpus = spark.createDataFrame([(f"c{i:03d}", f"s{i % 4}", "p", "u", 1, "t", v.tolist()) for i, v in enumerate(x)] + [("none", "s", "p", "u", 1, "t", None), ("short", "s", "p", "u", 1, "t", [1.0])], "chunk_id string, source_id string, section_path_text string, source_url string, word_count int, text string, embedding array<double>")
    queries = spark.createDataFrame([(f"q{i}", "t", x[i].tolist()) for i in range(5)] + [("n", "t", None)], "query_id string, topic string, query_embedding array<double>")
    key = lambda df: {(r["query_id"], r["rank"]): (r["chunk_id"], round(r["similarity_score"], 9)) for r in df.collect()}
    assert key(retrieval.candidates(queries, corpus.repartition(7), 8)) == key(retrieval.top_k(queries, corpus, 8))
    assert retrieval.candidates(queries.limit(0), corpus, 3).count() == retrieval.candidates(queries, corpus.limit(0), 3).count() == 0
