import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlake.llm import token_counts as tc

E = tc.Encoder()
WORDS = ["the", "a", " ", "  ", "\n", "don't", "x1y2", "ß", "日本", "...", "\t", "l'été", "123", " 's", "-", " ", "emoji😀"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=400), st.lists(st.tuples(st.integers(0, 900), st.integers(0, 60), st.lists(st.sampled_from(WORDS), max_size=20)), max_size=8))
def test_edits_like_encoding_again(words, edits):
    tc_size, tc.SEGMENT = tc.SEGMENT, 16
    try:
        text = " ".join(words)
        tree = tc.Tree.build(text, E)
        assert tree.total == E.count(text)
        for start, length, new in edits:
            s = min(start, len(text))
            text = text[:s] + "".join(new) + text[min(s + length, len(text)) :]
            tree.edit(start, start + length, "".join(new), E)
            assert tree.text == text
            assert tree.total == E.count(text)
            assert int(tree.chars[1]) == len(text)
    finally:
        tc.SEGMENT = tc_size


def test_an_edit_of_a_long_text_encodes_little():
    text = " ".join(f"word{i}" for i in range(50000))
    tree = tc.Tree.build(text, E)
    tree.edit(200_000, 200_010, "changed", E)
    assert tree.total == E.count(tree.text)
    assert tree.encoded < 3 * tc.SEGMENT
    for _ in range(200):  # a leaf that grows is parted
        tree.edit(1000, 1000, " more words" * 60, E)
    assert max(map(len, tree.parts)) <= tc.LEAF and tree.total == E.count(tree.text)


@pytest.mark.parametrize("per_round", [1000, 2])
def test_rows(spark, per_round):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 900)))) for i in range(20)] + [(50, None), (51, ""), (52, "w" * 30000), (None, "x y")]
    edits = [(i, k, rng.randrange(0, 500), rng.randrange(0, 600), rng.choice(["", "new text ", None, "\n\n"])) for i in [*range(15), 50, 51, 52, 99] for k in range(rng.randrange(1, 6))]
    state = tc.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = tc.apply_edits(state, spark.createDataFrame(edits, "id long, seq int, start long, end long, new string"), per_round=per_round).collect()
    assert len(got) == len(docs)
    for r in got:
        text = dict(docs)[r.id] or ""
        for _, _, s, e, new in sorted(x for x in edits if x[0] == r.id):
            s = min(s, len(text))
            text = text[:s] + (new or "") + text[max(s, min(e, len(text))) :]
        assert r.text == text and r.n_tokens == E.count(text) == r.tokens[1]


def test_edits_numbered_by_time(spark):
    state = tc.build(spark.createDataFrame([(1, "one two three"), (2, "x")], "doc_id long, text string"))
    edits = [(1, 1_700_000_000_000_000, 0, 3, "ONE"), (1, 1_800_000_000_000_000, 0, 0, "> "), (1, 1_800_000_000_000_000, 2, 5, "five"), (2, -5, 0, 1, None), (None, 1, 0, 1, "q")]
    got = tc.apply_edits(state, spark.createDataFrame(edits, "id long, seq long, start long, end long, new string"), per_round=2).collect()
    assert {r.id: r.text for r in got} == {1: "> five two three", 2: ""}
    assert tc.apply_edits(state, spark.createDataFrame([], "id long, seq long, start long, end long, new string")).count() == 2


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = tc.op6_token_counts(spark, sf_dir).collect()
    assert len(got) == len(docs) and all(r.n_tokens == E.count(docs[r.doc_id] or "") for r in got)
    assert sum(r.n_reencoded_chars for r in got) < sum(len(x or "") for x in docs.values()) * 2
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tc.build(none).count() == 0


@pytest.mark.parametrize("blank", [" ", "\t", "\n", "　", "\r\n", " \n", "\x85", "\x1c"])
@pytest.mark.parametrize(("before", "after"), [("", ""), ("a", ""), ("", "b"), ("a ", "1"), ("x", "'s"), ("x", "​")])
def test_runs_of_white_space_like_the_pattern(blank, before, after):
    for n in (9_999, 10_000, 10_001, 30_000):
        text = before + blank * n + after
        assert E.count(text) == len(E.encoding.encode_ordinary(text))


@pytest.mark.parametrize(("blank", "tokens"), [(" ", 1), ("\t", 1), ("\n", 2)])
def test_five_million_blanks(spark, blank, tokens):
    n = 5_000_000
    half = E.count(blank * 100_000)
    assert E.count(f"a{blank * n}b") == E.count(blank * (n - 1)) + E.count("a") + E.count(f"{blank}b") and abs(E.count(blank * n) - n * half / 100_000) < 2
    tree = tc.Tree.build(f"one {blank * n}two three", E)
    tree.edit(n // 2, n // 2 + 3, "x", E)
    assert tree.total == E.count(tree.text)
    df = spark.createDataFrame([(1, blank * n), (2, "x")], "doc_id long, text string")
    assert {r.id: r.n_tokens for r in tc.build(df).selectExpr("id", "tokens[1] AS n_tokens").collect()} == {1: E.count(blank * n), 2: 1}
