"""Literal inputs and outputs of the scalar functions and heuristics."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import quality
from docloom.functions import text as T
from docloom.operators import chunking


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*items):
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def expressions():
    return [
        (T.slugify(F.lit(" Hello,  World! ")), "hello_world"),
        (T.slugify(F.lit("!!!")), "untitled"),
        (T.url_slug(F.lit("https://a.b/")), "root"),
        (T.url_slug(F.lit("https://a.b/c/d/?q=1")), "c_d_q_1"),
        (T.clean_html_text(F.lit("Use TLS ¶ now . --")), "Use TLS now."),
        (T.clean_page_text(F.lit("con-\n tainer ﬁle , ok --")), "container file, ok"),
        (T.collapse_whitespace(F.lit(" a  b\t")), "a b"),
        (T.dedupe_consecutive(array("a", "a", "", "a", "b")), ["a", "b"]),
        (T.split_sentences(F.lit("One. Two! three. (Four)")), ["One.", "Two! three.", "(Four)"]),
        (T.split_clauses(F.lit("A; B: c; D")), ["A;", "B: c;", "D"]),
        (T.split_sentences(F.lit(None).cast("string")), []),
        (T.context_prefix(array("A", "a", "B", "C")), "Section: B > C. "),
        (T.context_prefix(array()), ""),
        (T.extract_citations(F.lit("x [a] y [b, c,]")), ["b", "c"]),
        (T.extract_citations(F.lit("none")), []),
        (T.enforced_answer(F.lit("t [z]"), array("a", "b")), "t\n\n[a, b]"),
        (T.enforced_citations(F.lit("t [b, z, b]"), array("a", "b")), ["b", "b"]),
        (T.parse_list(F.lit("['a', 'b']")), ["a", "b"]),
        (T.parse_list(F.lit('["a","b"]')), ["a", "b"]),
        (T.parse_list(F.lit("nan")), []),
        (T.parse_list(F.lit("plain")), ["plain"]),
        (T.shorten(F.lit("one two three"), 8), "one two ..."),
        (T.infer_extension(F.lit("text/HTML"), F.lit("x")), ".html"),
        (T.infer_extension(F.lit(None).cast("string"), F.lit("https://a/b/c.pdf?x=1")), ".pdf"),
        (T.infer_extension(F.lit(""), F.lit("https://a/b")), ".bin"),
        (T.domain_allowed(F.lit("https://x.docs.io/a"), array("docs.io")), True),
        (T.domain_allowed(F.lit("https://xdocs.io/a"), array("docs.io")), False),
        (T.topic_keywords(F.lit("some_topic")), ["some", "topic"]),
        (T.joined_distinct(F.lit("b"), F.lit("a"), F.lit("b"), F.lit("nan")), "b, a"),
        (quality.url_heavy(F.lit("see https://a and www.b")), True),
        (quality.index_like(F.lit("index, 1, 2, 3, 4, 5, 6, 7, 8")), True),
        (quality.low_signal_section(array("What's next"), F.lit("x")), True),
        (quality.boilerplate_line(F.lit("xiv"), F.lit(1), F.lit(9)), True),
        (quality.boilerplate_line(F.lit("Running head"), F.lit(3), F.lit(9)), True),
        (quality.boilerplate_line(F.lit("An ordinary line of text"), F.lit(2), F.lit(9)), False),
        (quality.references_page(array("References"), F.lit("[1] a [2] b [3] c")), True),
    ]


def test_expressions(spark):
    pairs = expressions()
    got = spark.range(1).select(*(column.alias(f"c{i}") for i, (column, _) in enumerate(pairs))).first()
    assert list(got) == [wanted for _, wanted in pairs]


def test_items_are_cleaned_once(spark):
    items = [f" line {i // 3} ¶ --" if i % 5 else " " for i in range(20_000)]
    said = [f"line {i // 3}" for i in range(20_000) if i % 5]
    wanted = [x for x, before in zip(said, [None, *said]) if x != before]
    got = spark.createDataFrame([(items,), (None,), ([],), ([None, "a", None, "a ¶"],)], "i array<string>").select(T.dedupe_consecutive(F.col("i")).alias("x"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("¶") == 1  # written out again in a lambda, all would be cleaned for each
    assert [r["x"] for r in got.collect()] == [wanted, None, [], ["a"]]


def test_word_windows(spark):
    windows = lambda n, c=chunking.ChunkConfig(): [tuple(w) for w in one(spark, chunking.word_windows(F.lit(n), c))]
    assert windows(300) == [(0, 160), (120, 280), (240, 300)]
    assert windows(165, chunking.ChunkConfig(160, 10, 40)) == [(0, 165)]
    assert windows(0) == []


@pytest.mark.parametrize(("sizes", "wanted"), [([100, 60, 30, 20, 10], [160, 60]), ([150, 5, 30], [185]), ([], []), ([10], [10])])
def test_greedy_packing(spark, sizes, wanted):
    units = F.array(*(F.struct(F.lit("x").alias("text"), F.lit(n).alias("words"), F.lit("sentence").alias("strategy")) for n in sizes)).cast(f"array<{chunking.UNIT}>")
    assert [g["words"] for g in one(spark, chunking.chunk_groups(units))] == wanted


@pytest.mark.parametrize("arguments", [(0, 0, 1), (10, 10, 1), (10, -1, 1), (10, 1, 0)])
def test_bad_chunk_config(arguments):
    with pytest.raises(ValueError):
        chunking.ChunkConfig(*arguments)


def greedy(sizes, c):
    """The packing rule, step by step."""
    out, now = [], []
    for n in sizes:
        w = sum(now)
        if now and not (w < c.min_words or (w < c.target and w + n <= c.soft_max) or (w + n <= c.max_words and n <= c.small)):
            out.append(now)
            now = []
        now = [*now, n]
    if now:
        out.append(now)
    if len(out) > 1 and sum(out[-1]) < c.min_words:
        out[-2:] = [out[-2] + out[-1]]
    return [sum(x) for x in out]


def test_packing_against_plain_loop(spark):
    import random

    random.seed(4)
    lists = [[random.choice([3, 12, 30, 60, 150]) for _ in range(random.randrange(0, 25))] for _ in range(200)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lists)], "i int, s array<int>")
    units = F.transform("s", lambda n: F.struct(F.lit("x").alias("text"), n.alias("words"), F.lit("sentence").alias("strategy")))
    got = {r["i"]: [g["words"] for g in r["g"]] for r in df.select("i", chunking.chunk_groups(units).alias("g")).collect()}
    assert all(got[i] == greedy(s, chunking.ChunkConfig()) for i, s in enumerate(lists))
