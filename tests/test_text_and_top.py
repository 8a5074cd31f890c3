import random

import pytest
from pyspark.sql import functions as F

from rosterlake import schemas
from rosterlake.config import ScoringConfig
from rosterlake.functions import text
from rosterlake.functions.arrays import count_while
from rosterlake.operators import extract, matching, normalize, rank, top
from rosterlake.sources import adapter, documents


def made(spark, rng, n_members, n_skills, n_requests, each):
    members = [(f"m{i:05d}", rng.random() < 0.9, rng.choice([None, 0, 12, 24, 36, 48])) for i in range(n_members)]
    skills = [(m, f"s{min(n_skills - 1, int(rng.paretovariate(0.7)))}", rng.random() < 0.1) for m, *_ in members for _ in range(rng.randrange(each))]
    pick = lambda: [f"s{rng.randrange(n_skills + 3)}" for _ in range(rng.randrange(5))]
    asked = [(f"r{i}", pick(), pick(), rng.choice([None, 0, 24, 40, 99]), None, None) for i in range(n_requests)]
    return (
        spark.createDataFrame(asked, "request_id string, mandatory array<string>, preferred array<string>, min_months int, expected_start_date date, requisition_duration_month int"),
        spark.createDataFrame(members, "team_member_id string, is_active boolean, experience_in_months int"),
        spark.createDataFrame(skills, "team_member_id string, skill_id string, is_deleted boolean"),
        spark.createDataFrame([], schemas.TABLES["team_member_allocation"]),
    )


@pytest.mark.parametrize(("seed", "n_skills", "each", "k", "config"), [(1, 8, 4, 5, ScoringConfig()), (2, 60, 3, 40, ScoringConfig()), (3, 30, 6, 7, ScoringConfig(mandatory_weight=0.5, preferred_weight=0.5, skill_weight=0.6, experience_weight=0.4, include_deleted_skills=False)), (4, 5, 2, 500, ScoringConfig()), (5, 10, 3, 3, ScoringConfig(availability_weight=0.5))])
def test_best_from_the_index_like_all_pairs(spark, seed, n_skills, each, k, config):
    args = made(spark, random.Random(seed), 150, n_skills, 25, each)
    rows = lambda df: sorted((r.request_id, r["rank"], r.team_member_id, round(r.final_score, 9)) for r in df.collect())
    got, _ = top.best(*args, k, config)
    assert rows(got) == rows(rank.top_k(matching.candidates(*args, config), k))


def test_few_pairs_are_scored(spark):
    args = made(spark, random.Random(9), 2000, 400, 20, 8)
    _, pairs = top.best(*args, 10)
    assert pairs.count() < 0.1 * 20 * args[1].filter("is_active").count()


@pytest.mark.parametrize("ways", [2, 7, 1000])
def test_ranks_in_ranges(spark, ways):
    rng = random.Random(ways)
    rows = spark.createDataFrame([(f"r{i % 3}", f"m{i // 3}", rng.choice([0.1, 0.5])) for i in range(300)], "request_id string, team_member_id string, final_score double")
    got, want = (sorted(map(tuple, rank.ranked(rows, ways=n).select("request_id", "team_member_id", "rank").collect())) for n in (ways, 1))
    assert got == want


def test_count_while(spark):
    rows = [(sorted(random.Random(i).choices(range(9), k=i)), x) for i in range(12) for x in range(10)]
    df = spark.createDataFrame(rows, "a array<int>, x int")
    assert all(n == sum(v < x for v in a) for a, x, n in df.select("a", "x", count_while(F.col("a"), lambda v: v < F.col("x"))).collect())


def test_shortened_names(spark):
    df = spark.createDataFrame([("abc",), ("",), ("é😀",)], "n string")
    got = {r.n: (sorted(r.one), sorted(r.two)) for r in df.select("n", normalize._shortened(F.col("n"), 1).alias("one"), normalize._shortened(F.col("n"), 2).alias("two")).collect()}
    assert got == {"abc": (["ab", "abc", "ac", "bc"], ["a", "ab", "abc", "ac", "b", "bc", "c"]), "": ([""], [""]), "é😀": (sorted(["é😀", "é", "😀"]), sorted(["é😀", "é", "😀", ""]))}


@pytest.mark.parametrize("most_bytes", [1 << 20, 0])
def test_names_in_text(spark, most_bytes):
    names = spark.createDataFrame([("Node.js", "N"), ("c++", "C"), ("Machine  Learning", "ML"), ("machine learning", "MK"), ("learning machine", "LM"), ("amazon simple storage service", "S3"), ("C", "CC"), ("!!", "X"), (None, "Y")], "skill_name string, skill_id string")
    texts = [(1, "Node.js, C++; node.js"), (2, "machine LEARNING machine learning"), (3, None), (4, ""), (5, "scan nodes.js C"), (6, "we use\nAmazon Simple\tStorage Service, c++x"), (6, "C"), (None, "c")]
    got = extract.names_in_text(spark.createDataFrame(texts, "id long, text string"), names, "id", "text", most_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "N", 2), (1, "C", 1), (2, "MK", 2), (2, "LM", 1), (5, "CC", 1), (6, "S3", 1), (6, "CC", 1), (None, "CC", 1)], key=str)
    assert extract.names_in_text(spark.createDataFrame(texts, "id long, text string"), names.filter("false"), "id", "text", most_bytes).count() == 0


@pytest.mark.parametrize(
    ("text", "low", "high", "lasts", "start"),
    [
        ("3-5 years of experience for 6 months, start date: 2026-06-01", 36, 60, 6, "2026-06-01"), ("At least 4 years' relevant work experience. Duration: 2 years. Starting on 1 June 2026.", 48, None, 24, "2026-06-01"),
        ("up to 18 months of experience, from July 2026", None, 18, None, "2026-07-01"), ("10+ yrs experience", 120, None, None, None), ("2 to 4 years professional experience; available by 31st February 2026", 24, 48, None, None),
        ("no numbers here", None, None, None, None), (None, None, None, None, None), ("for 3 years of experience", 36, None, None, None), ("lasts 12 months, starts in May 2026", None, None, 12, "2026-05-01"), ("start date: 2026-13-40", None, None, None, None),
    ],
)
def test_fields(spark, text, low, high, lasts, start):
    df = spark.createDataFrame([(text,)], "t string").select(extract.experience(F.col("t")).alias("e"), extract.duration_months(F.col("t")).alias("d"), extract.start_date(F.col("t")).cast("string").alias("s"))
    r = df.first()
    assert (r.e.min_months, r.e.max_months, r.d, r.s) == (low, high, lasts, start)


def test_versions(spark):
    rows = ['{"request_id": "a", "schema_version": "1", "job_description": {"title": "t", "mandatory_skills": ["x"]}}', '{"request_id": "b", "schema_version": "1.1", "job_description": {"skills": [{"name": "x", "required": true}, {"name": "y"}], "min_experience_months": 5}}', '{"request_id": "c", "schema_version": "7"}', '{"request_id": "d"}', "{", '{"schema_version": "1.1", "job_description": {"skills": "x"}}', " "]
    got = documents.read_versions(spark.createDataFrame([(r,) for r in rows], "value string"), documents.REQUISITION_READERS).collect()
    assert {r.request_id: (r.job_description.mandatory_skills, r.job_description.preferred_skills) for r in got if r.request_id} == {"a": (["x"], None), "b": (["x"], ["y"])}
    assert sorted((r.unreadable, r.line) for r in got if r.unreadable) == sorted([("unknown_version", rows[2]), ("unknown_version", rows[3]), ("not_json", "{"), ("wrong_type", rows[5])])


def test_letter_case_is_one_to_one(spark):
    """As SQL's upper and lower have it, letter by letter."""
    rows = spark.createDataFrame([("ß ﬁx ŉ ᾳé", "ΑΣ İX")], "a string, b string").select(text.upper(F.col("a")), text.lower(F.col("b"))).first()
    assert tuple(rows) == ("ẞ ﬁX ŉ ᾼÉ", "ας ix".replace("ς", "σ"))
    names = spark.createDataFrame([("schß. ö.",)], "skill_name string").withColumn("skill_id", adapter.skill_id(F.col("skill_name")))
    texts = spark.createDataFrame([(1, "Das Schß. Ö. dort")], "id int, text string")
    assert [r.skill_id for r in extract.names_in_text(texts, names, "id", "text").collect()] == ["SCHẞ._Ö."]
