"""Golden values of scores, windows and availability, by number."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rosterlake.config import ScoringConfig
from rosterlake.operators import availability, explain, matching, normalize, rank, scoring

LISTS = "have array<string>, mandatory array<string>, preferred array<string>"


@pytest.mark.parametrize(
    ("have", "mandatory", "preferred", "config", "want"),
    [
        ("abc", "ab", "d", ScoringConfig(), 0.7), ("ad", "abc", "de", ScoringConfig(), 0.7 / 3 + 0.15), ("ad", "", "de", ScoringConfig(), 0.85), ("ab", "a", "", ScoringConfig(), 1.0),
        ("a", "a", "d", ScoringConfig(mandatory_weight=0.6, preferred_weight=0.4), 0.6), ("", "aab", "", ScoringConfig(), 0.3), ("a", "aab", "", ScoringConfig(), 0.65),
    ],
)
def test_skill_score(spark, have, mandatory, preferred, config, want):
    df = spark.createDataFrame([(list(have), list(mandatory), list(preferred))], LISTS)
    got = df.select(scoring.skill_score(scoring.ratio(F.col("have"), F.col("mandatory")), scoring.ratio(F.col("have"), F.col("preferred")), config)).first()[0]
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize(("months", "least", "want"), [(48, 36, 1.0), (24, 36, 0.0), (72, 36, 1.0), (48, None, 1.0), (None, 1, 0.0), (None, 0, 1.0), (None, None, 1.0), (36, 36, 1.0)])
def test_experience_score(spark, months, least, want):
    df = spark.createDataFrame([(months, least)], "m int, l int")
    assert df.select(scoring.experience_score(F.col("m"), F.col("l"))).first()[0] == want


def test_final_score_and_fit(spark):
    df = spark.createDataFrame([(0.8, 0.6)], "s double, e double")
    assert df.select(scoring.final_score(F.col("s"), F.col("e"))).first()[0] == pytest.approx(0.76)
    assert df.select(scoring.final_score(F.col("s"), F.col("e"), ScoringConfig(skill_weight=0.5, experience_weight=0.5))).first()[0] == pytest.approx(0.7)
    levels = spark.createDataFrame([(x,) for x in (0.75, 0.7499, 0.5, 0.4999)], "x double").select(scoring.fit_level(F.col("x"))).collect()
    assert [r[0] for r in levels] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_window(spark):
    df = spark.createDataFrame([(date(2026, 6, 1), 6), (date(2026, 6, 1), None), (date(2026, 6, 1), 0), (None, 1)], "s date, m int")
    start, end = availability.window(F.col("s"), F.col("m"), ScoringConfig(as_of=date(2026, 1, 1)))
    got = [tuple(r) for r in df.select(start, end).collect()]
    assert got == [(date(2026, 6, 1), date(2026, 11, 28))] * 3 + [(date(2026, 1, 1), date(2026, 1, 31))]


def allocation_rows(spark, rows):
    return spark.createDataFrame([("m", f"p{i}", None if p is None else Decimal(p), s, e, True, d) for i, (p, s, e, d) in enumerate(rows)], "team_member_id string, project_id string, allocation_percentage decimal(5,2), start_date date, end_date date, billable boolean, is_deleted boolean")


Y = (date(2026, 1, 1), date(2026, 12, 31))
WINDOW = (date(2026, 6, 1), date(2026, 12, 1))


@pytest.mark.parametrize(
    ("rows", "window", "total", "n"),
    [
        ([(60, *Y, False)], WINDOW, 60, 1), ([(50, *Y, False), (40, *Y, False)], WINDOW, 90, 2), ([(70, date(2026, 3, 1), date(2026, 9, 30), False)], WINDOW, 70, 1), ([(50, date(2025, 1, 1), date(2025, 6, 30), False)], WINDOW, None, 0),
        ([(40, date(2026, 1, 1), date(2026, 6, 30), False), (30, date(2026, 3, 1), date(2026, 9, 30), False)], (date(2026, 3, 1), date(2026, 9, 1)), 70, 2), ([(50, *Y, False), (25, *Y, True)], WINDOW, 50, 1), ([(50, *Y, False), (25, *Y, None)], WINDOW, 50, 1),
        ([(50, date(2026, 12, 1), date(2026, 12, 31), False)], WINDOW, None, 0), ([(50, date(2026, 1, 1), date(2026, 6, 1), False)], WINDOW, None, 0), ([(50, date(2026, 1, 1), None, False), (50, None, date(2027, 1, 1), False)], WINDOW, None, 0), ([(None, *Y, False)], WINDOW, 0, 1),
    ],
)
@pytest.mark.parametrize("most", [100, 0])
def test_overlaps(spark, rows, window, total, n, most):
    windows = spark.createDataFrame([window], "w_start date, w_end date")
    pairs = availability.overlapping(allocation_rows(spark, rows), windows, most).collect()
    assert len(pairs) == n
    got = availability.allocated(allocation_rows(spark, rows), windows).collect()
    assert [r.allocated for r in got] == ([] if total is None else [total])


def test_both_ways_agree_on_inverted_dates(spark):
    day = lambda m, d: date(2026, m, d)
    rows = [(10, day(9, 20), day(7, 5), False), (20, day(8, 9), day(8, 2), False), (40, day(12, 20), day(10, 1), False), (5, *Y, False), (7, day(9, 1), day(5, 1), False)]
    windows = spark.createDataFrame([WINDOW, (day(10, 15), day(7, 15)), (day(8, 20), day(8, 3))], "w_start date, w_end date")
    want = sorted((f"p{i}", a, b) for i, (_, s, e, _) in enumerate(rows) for a, b in [WINDOW, (day(10, 15), day(7, 15)), (day(8, 20), day(8, 3))] if s < b and e > a)
    assert ("p0", *WINDOW) in want and ("p3", day(10, 15), day(7, 15)) in want
    for most in (100, 0):
        got = availability.overlapping(allocation_rows(spark, rows), windows, most).collect()
        assert sorted((r.project_id, r.w_start, r.w_end) for r in got) == want


def test_candidates_end_to_end(spark):
    members = spark.createDataFrame([("m", True, 48), ("low", True, 12), ("off", False, 99), ("null", None, 99)], "team_member_id string, is_active boolean, experience_in_months int")
    skills = spark.createDataFrame([("m", "a", False), ("m", "b", True), ("low", "a", False)], "team_member_id string, skill_id string, is_deleted boolean")
    allocations = allocation_rows(spark, [(50, *Y, False), (30, *Y, False)])
    asked = spark.createDataFrame([("r", ["a", "b", "b"], [], 36, date(2026, 6, 1), 6), ("none", [], [], None, date(2020, 1, 1), None)], "request_id string, mandatory array<string>, preferred array<string>, min_months int, expected_start_date date, requisition_duration_month int")
    got = {(r.request_id, r.team_member_id): r for r in rank.ranked(matching.with_reasons(matching.candidates(asked, members, skills, allocations))).collect()}
    assert set(got) == {(r, m) for r in ("r", "none") for m in ("m", "low")}
    full = got["r", "m"]
    assert (full.skill_score, full.experience_score, full.final_score, full.is_available, full.rank) == (1.0, 1.0, 1.0, False, 1)
    assert full.availability_score == pytest.approx(0.2) and full.skills_matched == ["a", "b"]
    assert got["r", "low"].skill_score == pytest.approx(0.65) and got["r", "low"].experience_score == 0.0
    assert got["none", "low"].final_score == 1.0 and got["none", "m"].rank == 2
    fewer = matching.candidates(asked, members, skills, allocations, ScoringConfig(include_deleted_skills=False), block=1)
    assert {(r.request_id, r.team_member_id): r.mandatory_score for r in fewer.collect()}["r", "m"] == 0.5


def test_ranks_agree(spark):
    rows = spark.range(500).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("request_id"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("team_member_id"), (F.col("id") % 4 / 4).alias("final_score"))
    one, many = ({(r.request_id, r.team_member_id): r["rank"] for r in rank.ranked(rows, w).collect()} for w in (1, 5))
    assert one == many
    assert rank.top_k(rows, 3).count() == 9 and rank.ranked(rows.filter("false"), 4).count() == 0


def test_normalize(spark):
    dictionary = spark.createDataFrame([("Python", "PY"), ("python", "PX"), ("Kubernetes", "K"), ("Data  Science", "DS"), (None, "N")], "skill_name string, skill_id string")
    raw = [(" PYTHON\t", "PX", "exact"), ("k8s", "K", "alias"), ("gcp", "GCP", "fallback"), ("big data", "BIG_DATA", "fallback"), ("Data  Science", "DS", "exact"), (None, None, "fallback"), ("", "", "fallback")]
    got = normalize.normalize(spark.createDataFrame([(i, r[0]) for i, r in enumerate(raw)], "i int, raw_skill string"), dictionary).orderBy("i").collect()
    assert [(r.skill_id, r.how) for r in got] == [r[1:] for r in raw]
    near = normalize.normalize(spark.createDataFrame([("Kubernetez",)], "raw_skill string"), dictionary, fuzzy=2).first()
    assert (near.skill_id, near.how) == ("K", "fuzzy")


def test_long_names_in_texts(spark):
    names = spark.createDataFrame([("Amazon Simple Storage Service", "S3"), ("Go", "GO"), ("one two three four five six", "SIX"), (None, "N")], "skill_name string, skill_id string")
    texts = spark.createDataFrame([(1, "We use Amazon simple storage service, and go"), (2, "amazon simple storage"), (3, "zero One two three four five six seven"), (4, None)], "id int, text string")
    assert {tuple(r) for r in normalize.skills_in_text(texts, names, "id", "text").collect()} == {(1, "S3"), (1, "GO"), (3, "SIX")}
    assert normalize.skills_in_text(texts, names.filter("false"), "id", "text").count() == 0


def test_explanations(spark):
    row = ("m", 0.615, 1.005, 0.0, 0.1, True, 1 / 3, 0.5, ["A"], ["B"], ["A", "B"])
    df = spark.createDataFrame([row], "team_member_id string, final_score double, skill_score double, experience_score double, availability_score double, is_available boolean, mandatory_score double, preferred_score double, mandatory_matched array<string>, preferred_matched array<string>, skills_matched array<string>")
    r = explain.lines(explain.summaries(explain.strengths_and_gaps(df))).first()
    assert r.explanation == [f"Overall match score: {0.615:.2f} (MEDIUM fit)", f"Skills matched: A, B (score: {1.005:.2f})", "Experience match score: 0.00", "Availability: 10% capacity (Available)"]
    assert r.mandatory_skills_summary == "1 mandatory skills matched (33% of requirements)"
    assert r.strengths == ["Good match on preferred skills", "Available for assignment"] and r.gaps == ["Limited mandatory skills coverage", "Experience may not fully meet requirements"]
