"""The training-data operators against brute force and on their defined edge cases."""

import dataclasses
import itertools
import os
import random
import re

import numpy as np
import pytest
from docloom.llm import languages, leaks, neardup, pairs, quality, rankfuse, repeated, split, subjects, tokenize, vectors
from docloom.llm._plan import broadcast_if_small

WORD = re.compile("[a-z0-9]+")
DOCS = "doc_id long, text string, section_path array<string>, source_id string, page_key string, _id string, _text string, words string"
VOCABULARY = tokenize.DEFAULT_VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def documents(spark, *rows):
    """Documents with extra columns whose names the operators use themselves."""
    full = [(i, t, p, s, k, "x", "y", "z") for i, t, p, s, k in rows]
    return spark.createDataFrame(full, DOCS)


def texts(spark, *values):
    return documents(spark, *((i, t, None, "s", f"k{i}") for i, t in enumerate(values)))


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sta") for b in ("ban", "dor", "fel", "gus", "hin", "x7")]


# --- splitting ---------------------------------------------------------------------


def plain_pieces(text):
    return re.findall(r"[^ \t\r\n]+", text)


def test_split_covers_text_within_the_limit(spark):
    rng = random.Random(1)
    values = [rng.choice([" ", "\n", "\t"]).join(sentence(rng, rng.randrange(3, 40)) for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    values += [" ".join(rng.choice(WORDS) for _ in range(700)), "a b " * 3000]
    paths = [None, ["one two", None, "three"], []]
    df = documents(spark, *((i, t, paths[i % 3], "s", "k") for i, t in enumerate(values)))
    rows = split.split_documents(df).collect()
    assert len(rows) == len(values)
    for r in rows:
        words, p = plain_pieces(values[r["doc_id"]]), 3 if r["doc_id"] % 3 == 1 else 0
        assert r["path_words"] == p and r["oversized"] == (len(words) > 160 - p)
        stretches = re.split(r"\n|(?<=[.!?])[ \t\r]", values[r["doc_id"]])
        if r["oversized"]:
            assert r["hard_cut"] == int(any(len(plain_pieces(s)) > 160 - p for s in stretches))
        at = 0
        for n, piece in enumerate(r["pieces"]):
            got = plain_pieces(piece["text"])
            assert len(got) == piece["words"] <= (160 - p if r["oversized"] else 10**9)
            assert got == words[piece["first_word"] : piece["first_word"] + len(got)]
            assert piece["first_word"] == (0 if n == 0 else at - 40)
            at = piece["first_word"] + len(got)
        assert at == len(words)


def test_split_defined_cases(spark):
    long_path = ["w " * 170]
    df = documents(spark, (1, None, None, "s", "k"), (2, "", None, "s", "k"), (3, "a b c", long_path, "s", "k"), (4, "x " * 200, ["w " * 130], "s", "k"), (5, "  ", None, "s", "k"), (5, "  ", None, "s", "k"))
    rows = {r["doc_id"]: r for r in split.split_documents(df).collect()}
    assert [rows[i]["oversized"] for i in (1, 2, 3, 4, 5)] == [False, False, True, True, False]
    assert rows[1]["pieces"] == rows[2]["pieces"] == [] and [p["words"] for p in rows[3]["pieces"]] == [1, 1, 1]
    assert all(p["words"] <= 30 for p in rows[4]["pieces"])
    assert split.split_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.SplitConfig(10, 10)


def test_split_prefers_natural_boundaries():
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(10))
    found = split.pieces_of(text, 0, split.SplitConfig())
    assert set(found["kinds"][:-1]) == {"line"} and found["hard_cut"] == 0


# --- near-duplicates ------------------------------------------------------------------


def shingles(text, k):
    w = WORD.findall(text.lower()) if text else []
    return set(zip(*(w[i:] for i in range(k)))), len(w)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(1000))
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(2)
    values = []
    for _ in range(30):
        base = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(20, 120)))
        values += [base, base.upper() + " !", *(edited(rng, base, n) for n in (1, 2, 4, 8))]
    values += ["hot copy of one text that a third of all rows may hold in the worst of cases and then some more words"] * 90
    values += [None, "", "too short", "Long " * 3000]
    config = neardup.DuplicateConfig(shingle=3, threshold=0.6, min_words=20, rows=4, bands=40)
    df = texts(spark, *values)
    got = {(r["doc_a"], r["doc_b"]): r["similarity"] for r in neardup.near_duplicate_pairs(df, config=config).collect()}
    sets = [shingles(t, 3) for t in values]
    want = {}
    for (i, (a, n)), (j, (b, m)) in itertools.combinations(enumerate(sets), 2):
        if n >= 20 and m >= 20 and a and b and len(a & b) / len(a | b) >= 0.6:
            want[i, j] = len(a & b) / len(a | b)
    assert got == pytest.approx(want)
    # keys that many documents share are worked through in blocks, with the same result
    blocks = dataclasses.replace(config, hot=1, block=7)
    assert {(r["doc_a"], r["doc_b"]): r["similarity"] for r in neardup.near_duplicate_pairs(df, config=blocks).collect()} == pytest.approx(want)

    groups = {r["doc_id"]: (r["class_id"], r["links"]) for r in neardup.near_duplicate_groups(df, config=config).collect()}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(range(len(values)), 0)
    for i, j in want:
        links[i] += 1
        links[j] += 1
        root[max(find(i), find(j))] = min(find(i), find(j))
    assert groups == {i: (find(i), links[i]) for i in range(len(values))}
    assert neardup.near_duplicate_pairs(df.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    element = np.concatenate([common, a, common, b, common[:1]])
    owner = np.concatenate([np.zeros(800, int), np.ones(800, int), [2]])
    s = neardup.sketches(element, owner, 4, 240)
    assert (s[:3] != np.iinfo(np.uint64).max).all() and (s[3] == 0).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12
    again = neardup.sketches(np.concatenate([common[::-1], a]), np.zeros(800, int), 1, 240)
    assert (again[0] == s[0]).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102)], "_a long, _b long")
    got = {r["_id"]: r["_root"] for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}


COMMON = {
    "en": "the of and a to in is that it for on with as this are be by not or from at an if when which each only after before but can has have no one other they was will",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei nur wie ohne muss",
    "fr": "le la les de des et en un une du que est pour dans qui par sur pas au ne se plus avec son ce il sont ou si sans comment chaque",
    "es": "el la los las de y en un una que es para por con no se su al lo como más o pero sus le ha si sin muy cada cuando",
}
COMMON_WORDS = frozenset(w for words in COMMON.values() for w in words.split())


def common_words(spark):
    rows = [(lang, w) for lang, words in COMMON.items() for w in words.split()]
    return spark.createDataFrame([*rows, rows[0], (None, "x"), ("en", None)], "lang string, word string")


# --- form ----------------------------------------------------------------------------

PROSE = "When a node fails, the controller moves its work to another one. This takes a while, and the users may notice it. Nothing has to be done by hand."
FORMS = [
    (PROSE, "prose"), ("\n".join(f"- {s}" for s in PROSE.split(". ")) + "\n" + PROSE, "prose"), (PROSE.replace(" ", "  "), "prose"), (PROSE.upper(), "prose"),
    ("\n".join(f"- {a} {b}" for a, b in itertools.product(("red", "blue"), ("cup", "plate", "spoon", "bowl"))), "list"),
    ("\n".join(f"{i}) Copper Kettle Number" for i in range(12)), "list"),
    ("\n".join(f"kettle\tcopper\t{i}\tyes" for i in range(9)), "table"), ("\n".join(f"| kettle | copper | {i} |" for i in range(9)), "table"),
    ("\n".join(f'"kettle","copper pot",{i},ok' for i in range(9)), "table"), ("\n".join("kettle        copper pot       %4d" % i for i in range(9)), "table"),
    ("\n".join("aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgdGV4dA0KYW5kIG1vcmUgb2YgaXQ" for _ in range(4)), "junk"),
    ("\n".join(f".box{i}{{margin:0 {i}px;border:none}}" for i in range(8)), "junk"), ("=====#####=====*****=====\n" * 6, "junk"),
    ("buy cheap kettle best copper free online guide top spoon " * 8, "junk"), ("short", "prose"), ("", "prose"),
    # boilerplate: the same lines, paragraphs or sentence again and again
    ("\n".join(["Please read the notice before you go on.", "All rights in the text are with the site.", "Accept the terms to see the page."] * 20), "junk"),
    ("\n\n".join([PROSE.replace(". ", ".\n")] * 9), "junk"), ("The cat sat on the mat and looked at the moon. " * 40, "junk"), (PROSE + "\n" + PROSE, "prose"),
]


def test_forms_and_statistics(spark):
    long = "\n".join(f"{PROSE} It was number {i} of them." for i in range(400))
    df = texts(spark, *(t for t, _ in FORMS), None, long, "Für Über für")
    rows = {r["doc_id"]: r for r in quality.describe(df, common_words(spark)).collect()}
    for i, (text, form) in enumerate(FORMS):
        assert rows[i]["form"] == form, (text[:60], rows[i]["form"])
        words = WORD.findall(text.lower())
        assert rows[i]["words"] == len(words)
        if words:
            assert rows[i]["mean_word_length"] == pytest.approx(sum(map(len, words)) / len(words))
            assert rows[i]["common_word_share"] == pytest.approx(sum(w in COMMON_WORDS for w in words) / len(words))
    assert rows[len(FORMS)]["form"] is None and rows[len(FORMS)]["words"] is None
    assert rows[len(FORMS) + 1]["words"] == len(WORD.findall(long.lower())) and rows[len(FORMS) + 2]["common_word_share"] == pytest.approx(2 / 3)
    assert rows[12]["repeated_line_share"] == pytest.approx(5 / 6)
    assert quality.describe(df.limit(0), common_words(spark)).count() == 0
    # without common words nothing is known of them, and more than the bound are an error, not a part of them
    none = quality.describe(df, common_words(spark).limit(0)).collect()
    assert len(none) == len(FORMS) + 3 and not any(r["common_word_share"] for r in none)
    bound, quality.MAX_COMMON = quality.MAX_COMMON, 10
    try:
        with pytest.raises(ValueError):
            quality.describe(df, common_words(spark))
    finally:
        quality.MAX_COMMON = bound


def test_dominant_ngram():
    rng = random.Random(1)
    words = [rng.choice(["ab", "cd"]) for _ in range(60)]
    want = max(sum(map(len, g)) * n / 120 for k in (2, 3, 4) for g, n in __import__("collections").Counter(zip(*(words[i:] for i in range(k)))).items() if n > 1)
    assert quality._repetition(quality.hash_words([" ".join(words), "one two three"]))[0, 0] == pytest.approx(min(want, 1.0))


# --- repeated lines ----------------------------------------------------------------------


def test_repeated_lines_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    # a line whose lower case is longer than itself
    rows = [(1000 + i, "\n".join(["İ" * 13, f"page {i}"]), None, "b", f"q{i}") for i in range(30)]
    for i in range(400):
        source = rng.choice(["hot", "hot", "hot", "b", None])
        lines = [sentence(rng, 8) for _ in range(rng.randrange(0, 4))]
        if rng.random() < 0.4:
            lines.append(rng.choice(["  Copyright 2031 by the\tteam of this site ", "COPYRIGHT 7 by the team  of this site"]))
        if rng.random() < 0.03:
            lines.append("A rare notice that is still long enough to count")
        rows.append((i, rng.choice([None, "\n".join(lines), "\n".join(lines)]), None, source, f"p{rng.randrange(200)}"))
    norm = lambda s: re.sub("[0-9]+", "0", re.sub("[ \t\r]+", " ", s.lower()).strip(" "))
    pages, seen = {}, {}
    for _, t, _, s, p in rows:
        if t is not None and s is not None:
            pages.setdefault(s, set()).add(p)
            for line in t.split("\n"):
                seen.setdefault((s, norm(line)), set()).add(p)
    bad = {k for k, v in seen.items() if len(k[1]) >= 25 and len(v) >= 5 and 20 * len(v) >= len(pages[k[0]])}
    want = {(i, n) for i, t, _, s, _ in rows if t is not None and s is not None for n, line in enumerate(t.split("\n")) if (s, norm(line)) in bad}
    df = documents(spark, *rows)
    assert want and {tuple(r) for r in repeated.repeated_lines(df).collect()} == want
    assert (1000, 0) in want

    def check():
        clean = {r["doc_id"]: r for r in repeated.without_repeated_lines(df).collect()}
        for i, t, _, _, _ in rows:
            kept = None if t is None else [x for n, x in enumerate(t.split("\n")) if (i, n) not in want]
            assert clean[i]["text"] == (None if t is None else "\n".join(kept)) and clean[i]["removed_lines"] == (None if t is None else len(t.split("\n")) - len(kept))
        assert len(clean) == len(rows) and repeated.without_repeated_lines(df.limit(0)).count() == 0

    check()
    # more repeated lines than can be looked up or broadcast: joins, with the same result
    monkeypatch.setattr(repeated, "LOOKUP_ROWS", 0)
    monkeypatch.setattr(repeated, "BROADCAST_ROWS", 0)
    check()
    assert {tuple(r) for r in repeated.repeated_lines(df).collect()} == want
    assert repeated.repeated_lines(df.limit(0)).count() == 0


# --- ranking --------------------------------------------------------------------------------


def borda(items, names):
    """Points by the definition, with plain loops."""
    n = len(items)
    points = dict.fromkeys(items, 0.0)
    for s in names:
        there = {i: v[s] for i, v in items.items() if v[s] is not None and v[s] == v[s]}
        for i in items:
            if i in there:
                rank = sum(o > there[i] for o in there.values()) + (sum(o == there[i] for o in there.values()) + 1) / 2
                points[i] += n - rank * (n + 1) / (len(there) + 1)
            else:
                points[i] += (n - 1) / 2
    return points


def test_borda_against_brute_force(spark):
    rng = random.Random(6)
    items = {f"i{k:03d}": {"a": rng.choice([0.5, rng.random(), None, float("nan")]), "b": rng.choice([1e6 * rng.random(), 7.0]), "c": rng.randrange(5) * 1.0} for k in range(150)}
    df = spark.createDataFrame([(k, v["a"], v["b"], v["c"], "x") for k, v in items.items()] + [(None, 1.0, 1.0, 1.0, "x")], "id string, a double, b double, c double, points string")
    want = borda(items, "abc")
    got = rankfuse.borda_ranking(df, "id", {"a": 1.0, "b": 1.0, "c": 1.0}).orderBy("position").collect()
    assert {r["id"]: r["points"] for r in got} == pytest.approx(want, abs=1e-5)
    order = sorted(items, key=lambda k: (-round(want[k], 6), k))
    assert [r["id"] for r in got] == order and [r["position"] for r in got] == list(range(1, 151))
    assert rankfuse.borda_ranking(df.limit(0), "id", {"a": 1.0}).count() == 0


# --- vectors ---------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((120, 16))
    x = np.repeat(centres, 12, axis=0) + 0.25 * rng.standard_normal((1440, 16))
    x = np.concatenate([x, np.repeat(x[:1], 40, axis=0)]).astype(np.float32)
    rows = [(i, v.tolist(), 16, "x") for i, v in enumerate(x)] + [(9001, None, 16, "x"), (9002, [1.0] * 15, 16, "x"), (9003, [0.0] * 16, 16, "x"), (9004, [float("nan")] * 16, 16, "x"), (9005, [1.0] * 8, 8, "x"), (9006, [2.0] * 8, 8, "x"), (None, [1.0] * 16, 16, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, embedding_dimension int, _part string")
    config = vectors.NeighbourConfig(per_part=150, sample=1024, block=128)
    got = {(r["vec_a"], r["vec_b"]) for r in vectors.mutual_pairs(vectors.nearest(df, config=config)).collect()}
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    want = {(9005, 9006)}
    for i, row in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :5]):
        want |= {(min(i, j), max(i, j)) for j in row.tolist() if s[i, j] >= 0.85}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    # two levels of parts, and parts of several blocks
    for other in (dataclasses.replace(config, fan=4, per_part=60), dataclasses.replace(config, per_part=4000)):
        again = {(r["vec_a"], r["vec_b"]) for r in vectors.mutual_pairs(vectors.nearest(df, config=other)).collect()}
        assert len(again & want) >= 0.97 * len(want) and len(again - want) <= 0.03 * len(want)
    copies = {p for p in want if p[0] in range(1440, 1480) and p[1] in range(1440, 1480)}
    assert copies <= got
    assert vectors.nearest(df.limit(0)).count() == 0


def test_equal_vectors_share_what_the_last_searched_one_finds(spark):
    """A scaled copy with a smaller id is nearer, by the tie, than the later copies of a crowd."""
    crowd = [(i, [0.6, 0.8, 0.0], 3) for i in range(10, 40)]
    scaled = [(1, [1.2, 1.6, 0.0], 3), (2, [3.0, 4.0, 0.0], 3)]
    df = spark.createDataFrame([*crowd, *scaled, (3, [0.0, 0.0, 1.0], 3)], "vec_id long, embedding array<double>, embedding_dimension int")
    got = {}
    for r in vectors.nearest(df).collect():
        got.setdefault(r["vec_id"], []).append(r["neighbour"])
    everyone = [1, 2, *range(10, 40)]
    assert {k: sorted(v) for k, v in got.items()} == {i: [j for j in everyone if j != i][:5] for i in everyone}


def test_parts_are_balanced():
    x = np.random.default_rng(1).standard_normal((900, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = vectors.balanced_parts(x, vectors.neighbour_graph(x, 10), 9, 12)
    assert np.bincount(part, minlength=9).max() <= 1.1 * 100 + 12


# --- pairs -----------------------------------------------------------------------------------

ASK = "Why should operators review the key rotation policy every month?"
CITED = "\n\n[alpha_docs__page__0001__chunk_0002, beta_docs__page__0004__chunk_0001]"
PAIRS = [
    (ASK, None, "empty"), (ASK, CITED, "empty"), (ASK, "N/A", "empty"), (ASK, "<answer></answer>" + CITED, "empty"),
    (ASK, "I'm sorry, but I can't help with that request.", "refusal"), (ASK, "The provided context does not contain enough information to answer." + CITED, "refusal"), ("Warum?", "Dazu kann ich leider keine Auskunft geben.", "refusal"),
    (ASK, "Reviewers cannot delete old keys until the job is gone.", None), (ASK, "I'm sorry to say that the store keeps old keys for a year.", None),
    (ASK, f"Question: {ASK}\nAnswer: {ASK}", "copies_question"), (ASK, ASK.lower().rstrip("?"), "copies_question"), (ASK, f"{ASK} Keys that are old are easier to steal, so they are replaced.", None),
    (ASK, "Old keys are easier to steal. In addition, the" + CITED, "truncated"), (ASK, "Old keys are easier to steal. The rotation of the key pol [alpha_docs__pa", "truncated"),
    (ASK, "Old keys are easier to steal.\n\n- rotation\n- old keys" + CITED, None), (ASK, "Do this.\n\nkind: Pod\nmetadata:\n  name: x", None), (ASK, "Use old keys", None), (ASK, "12 nodes, no more", None),
    (ASK, "Die alten Schlüssel sind leichter zu stehlen, und deshalb werden sie ersetzt.", "other_language"), (ASK, "鍵は毎月確認する必要があります。", "other_language"), (None, "Die alten Schlüssel sind leichter zu stehlen.", None),
]


def test_defects(spark):
    answers = spark.createDataFrame([(i, f"q{i}" if q else None, a, "x") for i, (q, a, _) in enumerate(PAIRS)], "result_id long, query_id string, answer_text string, _query string")
    queries = spark.createDataFrame([(f"q{i}", q) for i, (q, _, _) in enumerate(PAIRS)] + [("q1", ASK), (None, ASK)], "query_id string, query_text string")
    got = {tuple(r) for r in pairs.defective_pairs(answers, queries, common_words(spark), citations_col=None).collect()}
    assert got == {(i, d) for i, (_, _, d) in enumerate(PAIRS) if d}
    assert pairs.defective_pairs(answers.limit(0), queries, common_words(spark), citations_col=None).count() == pairs.defective_pairs(answers.limit(0), queries.limit(0), common_words(spark).limit(0), citations_col=None).count() == 0


def test_string_tiling():
    assert pairs.tiles("a b c x d e".split(), "d e a b c".split()) == 5
    assert pairs.tiles("a b a b".split(), "a b".split()) == 2


def test_parser_tells_what_is_open():
    parsed = lambda t: pairs.Parse(t).open
    assert parsed('say (x "y" `(` and') == ["("] and parsed("a ) b ] c") == []
    assert parsed("see\n```yaml\na: (1") == ["```"] and parsed("```\n( [\n```\nend") == []
    assert parsed("<b>bold <i>and</i> so") == ["<b>"] and parsed("one<br>two <hr/> three") == []
    assert parsed("steps:\n- first\n- second (of") == ["-", "("] and parsed("- first\n\nthen") == [] and parsed("- first\n  goes on") == ["-"]


@pytest.mark.parametrize(
    "text, cut",
    [
        ("Use the flag.", False), ("Use the flag and when", True), ("It is set in the file (see the", True), ('He said "it is fine', True), ('He said "it is fine."', False),
        ("Do this:\n```yaml\nkind: Pod\nname: a\n```", False), ("Do this:\n```yaml\nkind: Pod\nname: a", False), ("Do this:\n```yaml\nkind: Pod\nitems: [a,", True), ("Do this:\n```sh\nrun --all \\", True), ("Do this:\n```", True),
        ("Steps:\n- one thing\n- another thing", False), ("Steps:\n- one thing\n- another thing (with the", True), ("Steps:\n- one thing,\n- another,", True), ("Steps:\n1. One is done. Then the other", True),
        ("It has two kinds (e.g.", True), ("It has two kinds, etc.", False), ("<p>It is done.</p>", False), ("<b>It is", True), ("Done. It was <b>bold</b>", False), ("| a | b |\n| 1 | 2 |", False),
        ("It works. The rest of it", True), ("Three nodes", False), ("", False),
    ],
)
def test_truncation(text, cut):
    assert pairs.is_truncated(text, COMMON_WORDS) == cut


def test_long_defects_and_citations():
    one = "I am sorry, but I cannot answer this question."
    assert pairs.is_refusal(" ".join([one] * 60)) and not pairs.is_refusal(" ".join([one] * 60) + " The answer lies in the third pod, which runs as root.")
    for refusal in ("This service is not able to judge that.", "There is not enough evidence to say so.", "Ich kann diese Frage nicht beantworten.", "Je ne peux pas répondre.", "No puedo responder a eso."):
        assert pairs.is_refusal(refusal), refusal
    assert not pairs.is_refusal("You cannot answer such requests without a token. Set one first.")
    ask = "Which of the nodes has the longest lease?"
    for times in (1, 3, 12, 200):
        assert pairs.copies_question(" ".join([ask] * times), ask) and pairs.copies_question("\n".join([ask] * times), ask)
    assert not pairs.copies_question(ask + " It is the one in the north, which was set up last and never restarted.", ask)
    assert pairs.copies_question("名前空間を確認する必要がありますか", "名前空間を確認する必要がありますか?") and not pairs.copies_question("設定を変更しました", "名前空間を確認する必要がありますか?")
    assert pairs.body_of("Done. [a b, 7]", frozenset(["a b"])) == "Done." and pairs.body_of("Done. [not an id]") == "Done. [not an id]" and pairs.body_of("Done.\n\n[x__1, x_") == "Done."


def test_languages_are_learned(spark):
    rng = random.Random(3)
    nouns = {"en": "cat house river", "de": "Katze Haus Fluss", "fr": "chat maison rivière", "es": "gato casa río"}

    def say(lang, n=12):
        return " ".join(rng.choice(COMMON[lang].split()) if rng.random() < 0.6 else rng.choice(nouns[lang].split()) for _ in range(n))

    rows = [(say(lang),) for lang in nouns for _ in range(60)] + [(None,), ("",)]
    known = languages.learn(spark.createDataFrame(rows, "q string"), "q", [(r[0], r[1]) for r in common_words(spark).collect()])
    asked = [(lang, say(lang, 14)) for lang in nouns for _ in range(50)]
    got = known.of([t for _, t in asked])
    assert sum(g == lang for g, (lang, _) in zip(got, asked)) >= 0.95 * len(asked) and sum(g not in (lang, None) for g, (lang, _) in zip(got, asked)) <= 4
    assert known.of(["", "cat", "名前空間を確認する", "проверка настроек сервера"]) == [None, None, "ja", "ru"]
    assert languages.learn(spark.createDataFrame([], "q string"), "q", []).of(["the cat", ""]) == [None, None]


# --- tokenizer -------------------------------------------------------------------------------


@needs_vocabulary
def test_encoding_round_trip_and_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    values = [None, "", " ", "Hello  world\n\n 12's don't", "naïve 日本語 🙂 ​", "<|endoftext|>", "x" * 5000, "\x1c\x85 \t", "ab" * 300]
    df = texts(spark, *values, values[3])
    coded = tokenize.encode_corpus(df)
    rows = {r["doc_id"]: r["ids"] for r in coded.collect()}
    for i, t in enumerate(values):
        assert rows[i] == (library.encode(t, add_special_tokens=False).ids if t else [])
    back = {r["doc_id"]: r["text"] for r in tokenize.decode_corpus(coded).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(values))
    assert tokenize.encode_corpus(df.limit(0)).count() == 0


@needs_vocabulary
def test_encoding_of_any_text():
    hypothesis = pytest.importorskip("hypothesis")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    encoder = tokenize.encoder(VOCABULARY)

    @hypothesis.settings(max_examples=300, deadline=None)
    @hypothesis.given(hypothesis.strategies.text())
    def check(text):
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids and encoder.decode(ids) == text

    check()


# --- leaks -----------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(rng.randrange(5, 60))), None if i % 3 else sentence(rng, 30)) for i in range(20)]
    values = [None, "", "short one"]
    for i, q, a in items:
        w = (a or q).split()
        for n in (11, 12, 20):
            at = rng.randrange(0, max(1, len(w) - n))
            values.append(f"{sentence(rng, 9)} foreign {' - '.join(w[at : at + n]).upper()} foreign {sentence(rng, 9)}")
    grams = {}
    for i, q, a in items:
        for t in (q, a):
            w = WORD.findall(t.lower()) if t else []
            for g in zip(*(w[j:] for j in range(12))):
                grams.setdefault(g, set()).add(i)
    want = set()
    for d, t in enumerate(values):
        w = WORD.findall(t.lower()) if t else []
        for g in zip(*(w[j:] for j in range(12))):
            want |= {(d, i) for i in grams.get(g, ())}
    held = spark.createDataFrame([*items, items[0], (99, None, "")], "item_id long, query_text string, reference_answer string")
    df = texts(spark, *values)
    assert want and {tuple(r) for r in leaks.leaked_items(df, held).collect()} == want
    near = leaks.leaked_items(df, held, config=leaks.LeakConfig(edits=1)).collect()
    assert want <= {tuple(r) for r in near} and len(near) == len(set(near))
    # many items meet in a join, with the same result
    assert sorted(leaks.leaked_items(df, held, config=leaks.LeakConfig(index_chars=0)).collect()) == sorted(want)
    assert sorted(leaks.leaked_items(df, held, config=leaks.LeakConfig(edits=1, index_chars=0)).collect()) == sorted(near)
    assert leaks.leaked_items(df.limit(0), held, config=leaks.LeakConfig(index_chars=0)).count() == 0
    assert leaks.leaked_items(df.limit(0), held).count() == leaks.leaked_items(df, held.limit(0)).count() == 0


def test_edits_are_verified_exactly_and_recalled():
    rng = np.random.default_rng(9)
    x = rng.integers(1, 1 << 62, (400, 12), dtype=np.uint64)
    y = x.copy()
    y[np.arange(400), rng.integers(0, 12, 400)] = rng.integers(1, 1 << 62, 400, dtype=np.uint64)
    assert leaks.within_edits(x, y, 1).all() and not leaks.within_edits(x, y, 0).any()
    moved = np.concatenate([x[:, 1:], y[:, :1]], axis=1)
    assert not leaks.within_edits(x, moved, 1).any() and leaks.within_edits(x, moved, 2).all()
    size, draws = leaks.LeakConfig(edits=1).draws
    (a, fit), (b, good) = (leaks.sample_keys(leaks.embed(z), size, draws, 1) for z in (x, y))
    assert ((a == b) & fit & good).any(axis=1).mean() >= 0.9 and draws > 1
    assert leaks.LeakConfig().draws[1] > 1 and leaks.LeakConfig(edits=1, recall=0.1).draws[1] > 1
    every = np.arange(400)
    assert leaks.sharing_piece(x, every, y, every, 1).tolist() == every.tolist() and not len(leaks.sharing_piece(x, every, y, every, 0))


def test_leaks_with_an_inserted_dropped_or_replaced_word(spark):
    rng = random.Random(12)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)), None) for i in range(40)]
    values, want, twice = [], [], []
    for i, passage, _ in items:
        for at in range(1, 11):
            w = passage.split()
            for words in ([*w[:at], "foreign", *w[at:]], [*w[:at], *w[at + 1 :]], [*w[:at], "foreign", *w[at + 1 :]]):
                want.append((len(values), i))
                values.append(" ".join(["some", *words, "more"] if at % 2 else words))
            twice.append(len(values))
            values.append(" ".join([w[0], "foreign", *w[1:at], "foreign", *w[at + 1 :]]))
    held = spark.createDataFrame(items, "item_id long, query_text string, reference_answer string")
    got = {tuple(r) for r in leaks.leaked_items(texts(spark, *values), held, config=leaks.LeakConfig(edits=1)).collect()}
    assert got <= set(want) and not {d for d, _ in got} & set(twice)
    for kind in range(3):
        assert len(got & set(want[kind::3])) >= 0.9 * len(want[kind::3])


def test_recall_of_each_kind_of_edit_in_longer_passages():
    """Passages of 12 to 40 words with one edit anywhere: at least 0.95 of each kind are found."""
    rng = random.Random(14)
    config = leaks.LeakConfig(edits=1)
    for length in (12, 13, 16, 20, 40):
        passages = [[f"w{rng.randrange(10**6)}" for _ in range(length)] for _ in range(300)]
        items = leaks._Items(np.arange(300), [" ".join(p) for p in passages], config)
        for kind in range(3):
            values = []
            for p in passages:
                at = rng.randrange(length)
                values.append(" ".join(["before", *p[:at], *([["new", p[at]], [], ["new"]][kind]), *p[at + 1 :], "after"]))
            doc, item = items.found_in(values)
            assert (doc == item).all() and len(doc) >= 0.95 * 300, (length, kind, len(doc))


def test_beginnings_within_edits_against_the_plain_distance():
    rng = np.random.default_rng(13)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            step = [i]
            for j, y in enumerate(b, 1):
                step.append(min(row[j] + 1, step[-1] + 1, row[j - 1] + (x != y)))
            row = step
        return row[-1]

    for e in (1, 2):
        a, b = rng.integers(1, 3, (500, 6 + e)), rng.integers(1, 3, (500, 6))
        want = [min(distance(x[:n], y) for n in range(6 - e, 7 + e)) <= e for x, y in zip(a.tolist(), b.tolist())]
        assert leaks.within_edits(a, b, e, 2 * e).tolist() == want and 0 < sum(want) < 500


# --- subjects --------------------------------------------------------------------------------


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(10)
    nouns = {
        "tea": ["green leaf", "hot kettle", "china cup", "steep time", "milk jug", "black blend", "loose strainer"], "sea": ["salt wave", "old harbour", "north wind", "deep water", "fishing net", "low tide", "wooden mast"],
        None: ["brown horse", "stone wall", "late train", "long road", "green hill", "paper bag", "iron gate"],
    }
    verbs = ["are often seen together", "belong in one story", "were described last year", "can not be told apart", "need some care", "came up in the talk"]

    def text(share):
        kinds = [k for k, n in share for _ in range(n)]
        rng.shuffle(kinds)
        return " ".join(f"We found that the {rng.choice(nouns[k])} and the {rng.choice(nouns[k])} {rng.choice(verbs)}." for k in kinds)

    shares = [[("tea", 8)], [("sea", 8)], [("tea", 5), ("sea", 5)], [(None, 8)], [("tea", 1), (None, 9)]]
    wanted = [{"tea"}, {"sea"}, {"tea", "sea"}, set(), set()]
    rows = [(i, text(shares[i % 5])) for i in range(200)]
    labels = [(i, s) for i in range(100) for s in (wanted[i % 5] or {None})]
    labels += [(0, "sea"), (12345, "tea")]
    extra = [(900, None), (901, ""), (902, "tea"), (903, "绿茶和海浪。" * 20)]
    df = documents(spark, *((i, t, None, "s", "k") for i, t in [*rows, *extra]))
    areas = spark.createDataFrame([("tea", "green leaf and kettle"), ("sea", "salt wave and harbour")], "subject string, description string")
    found = {}
    for r in subjects.document_subjects(df, spark.createDataFrame(labels, "doc_id long, subject string"), areas, common_words(spark)).collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    held_out = [found.get(i, set()) == wanted[i % 5] for i in range(100, 200)]
    assert sum(held_out) >= 97
    assert not set(found) & {900, 901, 902, 903}
    empty = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.document_subjects(df, empty, areas, common_words(spark)).count() == 0
    # the factorisation decides: without its updates next to nothing is found
    start = subjects.document_subjects(df, spark.createDataFrame(labels, "doc_id long, subject string"), areas, common_words(spark), config=subjects.SubjectConfig(rounds=0))
    found = {}
    for r in start.collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(found.get(i, set()) == wanted[i % 5] for i in range(100, 200)) < 80
    with pytest.raises(ValueError):
        subjects.document_subjects(df, empty, areas, common_words(spark), config=subjects.SubjectConfig(max_subjects=1))


def test_broadcast_only_below_the_bound(spark):
    small, large = broadcast_if_small(spark.range(10), 10), broadcast_if_small(spark.range(11), 10)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
