"""Retrieval in blocks, judging with resume, reports, files and parsing by type, on their defined cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom import planning as plan
from docloom.operators import evaluation, generation, judging, reports, retrieval
from docloom.sources import dispatch, files, raw, tables


def vectors(spark, rows, names="id long, v array<double>"):
    return spark.createDataFrame(rows, names)


def plain_top(asked, items, k, same=True):
    want = set()
    for q, a in asked.items():
        scored = sorted((-round(float(np.dot(a, x)), 12), i) for i, x in items.items() if len(x) == len(a) and (same or i != q))
        want |= {(q, i, rank) for rank, (_, i) in enumerate(scored[:k], 1)}
    return want


@pytest.mark.parametrize("grid", [False, True])
def test_top_k_against_plain_loop(spark, monkeypatch, grid):
    rng = np.random.default_rng(1)
    items = {i: rng.integers(-2, 3, 4 if i % 9 else 3).astype(float) for i in range(150)}  # few values: many ties
    asked = {i: rng.integers(-2, 3, 4 if i % 5 else 3).astype(float) for i in range(0, 60, 2)}
    bad = [(900, None), (901, []), (902, [float("nan")] * 4), (903, [float("inf")] + [0.0] * 3), (904, [None, 1.0, 1.0, 1.0])]
    corpus = vectors(spark, [*((i, x.tolist()) for i, x in items.items()), *bad], "id long, v array<double>").withColumn("note", F.lit("n"))
    queries = vectors(spark, [*((i, x.tolist()) for i, x in asked.items()), *bad], "q long, w array<double>")
    if grid:
        monkeypatch.setattr(retrieval, "QUESTION_ROWS", 0)
        monkeypatch.setattr(retrieval, "BLOCK", 16)
    for same in (True, False):
        got = retrieval.top_k(queries, corpus, 3, "q", "w", "id", "v", same=same)
        assert got.columns == ["q", "id", "v", "note", "similarity_score", "rank"]
        assert {(r["q"], r["id"], r["rank"]) for r in got.collect()} == plain_top(asked, items, 3, same)
    assert retrieval.top_k(queries.limit(0), corpus, 3, "q", "w", "id", "v").count() == retrieval.top_k(queries, corpus.limit(0), 3, "q", "w", "id", "v").count() == 0


def test_vectors_that_are_not_finite_take_no_places(spark):
    rows = [(1, [0.9]), (2, [0.8]), (3, [0.7]), (4, [float("nan")]), (5, [float("nan")])]
    found = retrieval.top_k(vectors(spark, [(0, [1.0])], "q long, w array<double>"), vectors(spark, rows), 3, "q", "w", "id", "v").collect()
    assert [r["id"] for r in sorted(found, key=lambda r: r["rank"])] == [1, 2, 3]


@pytest.mark.parametrize("block", [4096, 7])
def test_group_similarities_against_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = np.random.default_rng(2)
    asked = [(i, i % 3, rng.standard_normal(3).tolist()) for i in range(40)] + [(77, 9, [1.0, 0.0, 0.0])]
    told = [(i % 2, rng.standard_normal(3).tolist()) for i in range(60)] + [(0, [float("nan")] * 3), (1, None)]
    got = retrieval.group_similarities(spark.createDataFrame(asked, "k long, g long, embedding array<double>"), spark.createDataFrame(told, "g long, embedding array<double>"), "g", "k", 0.4).collect()
    want = {}
    for k, g, a in asked:
        scores = [float(np.dot(a, x)) for h, x in told if h == g and x and x[0] == x[0]]
        if scores:
            want[k] = (g, sum(s >= 0.4 for s in scores), len(scores), pytest.approx(max(scores)))
    assert {r["k"]: (r["g"], r["near"], r["total"], r["best"]) for r in got} == want


def test_more_variants_than_a_thousand_stay(spark):
    variants = spark.range(1500).select(F.concat(F.lit("V"), "id").alias("variant"), F.lit("m").alias("model_name"))
    assert evaluation.metric_placeholder(spark.createDataFrame([("q",)], "query_id string"), variants).count() == 1500
    found = variants.select(F.lit("q").alias("query_id"), "variant", F.lit("t").alias("query_text"), F.lit("t").alias("topic"), F.lit("d").alias("difficulty"), F.lit(1).alias("rank"), F.lit("c").alias("chunk_id"), F.lit("s").alias("source_id"), F.lit("p").alias("section_path_text"), F.lit("x").alias("chunk_text"))
    assert generation.generation_cases(found, variants).count() == 1500


def test_lookup_beyond_a_broadcast(spark, monkeypatch):
    left, right = spark.range(100).withColumn("k", F.col("id") % 3), spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    small = {tuple(r) for r in plan.lookup(left, right, ["k"], "id", "left").select("id", "name").collect()}
    monkeypatch.setattr(plan, "small_enough", lambda *a: False)
    assert {tuple(r) for r in plan.lookup(left, right, ["k"], "id", "left").select("id", "name").collect()} == small and len(small) == 100


def test_strict_cases_and_labels_raise(spark):
    answers = spark.createDataFrame([("q1", "V1", "m", "a", "a", ["c"]), ("q2", "V1", "m", "a", "a", ["c"])], "query_id string, variant string, model_name string, answer_text string, answer_text_plain string, citations array<string>")
    queries = spark.createDataFrame([("q1", "t", "d", "x", "r")], "query_id string, topic string, difficulty string, query_text string, reference_answer string")
    found = spark.createDataFrame([(q, "V1", 1, "c", "s", "p", "x") for q in ("q1", "q2")], "query_id string, variant string, rank int, chunk_id string, source_id string, section_path_text string, chunk_text string")
    assert evaluation.evaluation_cases(answers, queries, found).count() == 1
    with pytest.raises(Exception, match="the question is missing for q2"):
        evaluation.evaluation_cases(answers, queries, found, strict=True).collect()
    with pytest.raises(Exception, match="the retrieval is missing for q1"):
        evaluation.evaluation_cases(answers.filter("query_id = 'q1'"), queries, found.limit(0), strict=True).collect()
    labels = spark.createDataFrame([("retrieval_miss",), ("",), (None,)], "failure_label string")
    assert evaluation.checked_labels(labels).count() == 3
    with pytest.raises(Exception, match="unknown failure label: bad luck"):
        evaluation.checked_labels(spark.createDataFrame([("bad luck",)], "failure_label string")).collect()
    bank = spark.createDataFrame([("t", i, f"q{i}", "r") for i in range(1, 11)], "topic string, slot int, query_text string, reference_answer string")
    assert [r["query_id"] for r in evaluation.reviewed_benchmark(bank).orderBy("query_id").collect()][-1] == "Q010"
    with pytest.raises(Exception, match="not the required entries in topic t"):
        evaluation.reviewed_benchmark(bank.filter("slot < 10")).collect()
    variants = spark.createDataFrame([("V1",), ("V9",)], "variant string")
    with pytest.raises(Exception, match="unknown variant: V9"):
        variants.select(generation.model_name(F.col("variant"))).collect()


def test_judging_takes_up_where_it_stopped(spark, tmp_path):
    class Counting(judging.Scorer):
        metrics = ("m",)

        def score(self, case):
            if case["text"] == "bad":
                raise ValueError("no score")
            return {"m": None if case["text"] is None else len(case["text"])}

    schema = "id long, text string"
    cases = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "four")], schema)
    path = f"file://{tmp_path}/scores"
    first = judging.run_judge(cases, Counting(), ["id"], ["text"], path).collect()
    assert {(r["id"], r["m"]) for r in first} == {(1, 1.0), (4, 4.0)}
    # a second run scores what was not finished, and no more
    mended = spark.createDataFrame([(1, "longer"), (2, "now"), (3, None), (4, "four"), (5, "x")], schema)
    second = judging.run_judge(mended, Counting(), ["id"], ["text"], path).collect()
    assert {(r["id"], r["m"]) for r in second} == {(1, 1.0), (2, 3.0), (4, 4.0), (5, 1.0)}
    every = spark.read.parquet(path).collect()
    assert sorted((r["id"], r["ordinal"]) for r in every) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (5, 2)]
    assert {r["ragas_error"] for r in every if r["ordinal"] == 1} == {None, "ValueError: no score"}


def test_generation_takes_up_where_it_stopped(spark, tmp_path):
    class Upper(generation.Generator):
        def transform(self, cases):
            return cases.withColumn("answer_text", F.upper("prompt_text"))

    cases = spark.createDataFrame([("q1", "V1", "m", "one", ["c"]), ("q2", "V1", "m", "two", ["d"])], "query_id string, variant string, model_name string, prompt_text string, chunk_ids array<string>")
    path = f"file://{tmp_path}/answers"
    assert generation.run_generation(cases.limit(1), Upper(), path).count() == 1
    done = {r["query_id"]: r["answer_text"] for r in generation.run_generation(cases, Upper(), path).collect()}
    assert done == {"q1": "ONE\n\n[c]", "q2": "TWO\n\n[d]"} and spark.read.parquet(path).count() == 2


def test_token_matches_against_plain_loop(spark):
    texts = [("q1", "the cat sat sat", "a cat has sat"), ("q2", "", "x"), ("q3", None, None), ("q4", "same words", "same words")]
    df = spark.createDataFrame([(q, "V", a, r) for q, a, r in texts], "query_id string, variant string, answer_text_plain string, reference_answer string")
    got = {r["query_id"]: (r["bertscore_p"], r["bertscore_r"], r["bertscore_f1"]) for r in judging.embedding_match_scores(df).collect()}
    for q, a, r in texts:
        x, y = ([judging.trigram_vector(w).astype(float) for w in (t or "").split()] for t in (a, r))
        if not x or not y:
            assert got[q] == (0.0, 0.0, 0.0)
            continue
        p, c = np.mean([max(i @ j for j in y) for i in x]), np.mean([max(i @ j for j in x) for i in y])
        assert got[q] == pytest.approx((p, c, 2 * p * c / (p + c)), abs=1e-6)
    assert got["q4"] == pytest.approx((1, 1, 1), abs=1e-6)


def test_model_interfaces_load_once_a_worker(spark):
    def load():
        return lambda prompts: [p[::-1] for p in prompts]

    cases = spark.createDataFrame([("q", "m", "abc")], "query_id string, model_name string, prompt_text string")
    assert generation.ModelGenerator(load).transform(cases).first()["answer_text"] == "cba"
    from docloom.operators.embedding import ModelEmbedder

    made = ModelEmbedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2).transform(spark.createDataFrame([("abc",), (None,)], "t string"), "t")
    assert sorted(r["embedding"] for r in made.collect()) == [[0.0, 1.0], [3.0, 1.0]]


def test_items_are_parsed_by_their_type(spark):
    schema = "source_id string, source_type string, source_url string, trust_level string, topic_tags array<string>, document_key string, title string, body string, page_texts array<string>"
    long = "It says what has to be done, and by whom, in all cases."
    page = f"<html><body><main><h1>Top</h1><p>{long}</p></main></body></html>"
    feed = '{"items": [{"id": "X-1", "summary": "A summary that is long enough to be kept."}]}'
    url = "https://site.example/docs/Guide.pdf?x=1"
    rows = [("w", "html", url, "official", [], "k", None, page, None), ("f", "json_feed", url, "official", [], None, None, feed, None), ("p", "pdf", url, "official", [], None, None, None, [long * 2, "short", long + " " + long + " more"]), ("e", "html", url, "official", [], "k", None, None, None)]
    docs = {(r["source_id"], r["page_number"]): r for r in dispatch.parse_items(spark.createDataFrame(rows, schema)).collect()}
    assert set(docs) == {("w", None), ("f", None), ("p", 1), ("p", 3)}
    assert docs["p", 1]["title"] == "Guide.pdf" and docs["w", None]["section_path"] == ["Top"] and docs["f", None]["external_id"] == "X-1"
    with pytest.raises(Exception, match="unknown source type: docx"):
        dispatch.parse_items(spark.createDataFrame([("w", "docx", url, "o", [], None, None, None, None)], schema)).collect()


def test_bodies_paths_and_environment(spark, tmp_path):
    fetched = spark.createDataFrame([("s", "https://a.example/x/y", True, 200, "text/html", "utf-8", bytearray(b"<p>hi</p>"), "2030-01-01T00:00:00Z")], "source_id string, url string, ok boolean, status_code int, content_type string, encoding string, content binary, fetched_at string")
    root = f"file://{tmp_path}/raw"
    kept = files.write_bodies(raw.raw_items(fetched, "snap"), root).collect()
    assert [(r["local_body_path"], r["byte_size"]) for r in kept] == [("s/snap/x_y/body.html", 9)]
    assert bytes(raw.bodies(spark, root).first()["content"]) == b"<p>hi</p>"
    about = raw.metadata(spark, root).first()
    assert about["item_id"] == "x_y" and about["byte_size"] == 9 and about["local_body_path"] == "s/snap/x_y/body.html"
    paths = files.ProjectPaths(f"file://{tmp_path}/project")
    paths.create(spark)
    assert all(files.exists(spark, p) for p in paths.every().values())
    assert files.project_root(spark, f"file://{tmp_path}/none", paths.root) == paths.root
    with pytest.raises(FileNotFoundError):
        files.project_root(spark, f"file://{tmp_path}/none")
    assert files.first_existing(spark, f"{paths.root}/no", paths.raw, paths.chunks) == paths.raw
    assert files.first_match(spark, f"{paths.root}/*s").endswith("/chunks") and files.first_match(spark, f"{paths.root}/z*") is None
    report = {r["name"]: r["version"] for r in files.environment_report(spark, ("pyspark", "no-such-package")).collect()}
    assert report["spark"] == report["pyspark"] == spark.version and report["no-such-package"] is None


def test_text_dump_and_markdown(spark, tmp_path):
    chunks = spark.createDataFrame([("b", "two"), ("a", "one")], "chunk_id string, text string").coalesce(1)
    tables.text_dump(chunks, f"file://{tmp_path}/dump")
    said = "".join(open(os.path.join(tmp_path, "dump", f)).read() for f in sorted(os.listdir(f"{tmp_path}/dump")) if f.startswith("part"))
    assert said == "one\n\ntwo\n\n"
    assert reports.markdown(spark.createDataFrame([("a|b", None, "x\ny")], "p string, q int, r string")) == "| p | q | r |\n| --- | --- | --- |\n| a\\|b |  | x y |\n"
    with pytest.raises(ValueError):
        reports.markdown(spark.range(5), 4)


def test_lists_are_read_in_three_ways(spark):
    rows = ['["a", "b"]', "['a, b', \"c'd\"]", "[a, b]", "nan", "NaN", "", None, "plain", "[]", "[1, 2.5]", "[None, True]", "(a, b)", '["x", null]', "[ , a]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", T.parse_list(F.col("t")).alias("a"), T.parse_json_list(F.col("t")).alias("b"), T.parse_literal_list(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r["a"] for r in got] == [["a", "b"], ["a, b", "c'd"], ["a", "b"], [], [], [], [], ["plain"], [], ["1", "2.5"], ["None", "True"], ["(a, b)"], ["x", "None"], ["a"]]
    assert [r["b"] for r in got][:9] == [["a", "b"], [rows[1]], ["[a, b]"], [], [], [], [], ["plain"], []]
    assert [r["c"] for r in got][:9] == [["a", "b"], ["a, b", "c'd"], ["[a, b]"], ["nan"], ["NaN"], [], [], ["plain"], []]


def test_rules_are_worked_out_once(spark):
    df = plan.once(spark.createDataFrame([("a  b",)], "t string"), flat=T.collapse_whitespace(F.col("t")))
    used = df.filter(F.length("flat") > 1).select(F.upper("flat").alias("u"), F.length("flat").alias("n"))
    said = used._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("regexp_replace") == 1 and used.first() == ("A B", 3)
