"""What is worked out for pairs is cheap, and the same by each way."""

from datetime import date
from decimal import Decimal

import pytest

from rosterlake.config import ScoringConfig
from rosterlake.operators import availability, matching, rank
from rosterlake.queries import QUERIES
from rosterlake.sources import adapter

ASKED = "request_id string, mandatory array<string>, preferred array<string>, min_months int, expected_start_date date, requisition_duration_month int"
ALLOCATIONS = "team_member_id string, project_id string, allocation_percentage decimal(5,2), start_date date, end_date date, is_deleted boolean"


def _tables(spark):
    ids = [f"S{i:03d}" for i in range(150)]
    asked = [("many", ids[:140], ids[60:70], 12, date(2026, 6, 1), 6), ("ends", [ids[0], ids[63], ids[64], ids[127], ids[128]], [None, ids[63], ids[149]], None, date(2026, 3, 1), 2), ("null", None, [ids[5]], 3, date(2026, 6, 1), 6), ("none", [], [], None, date(2020, 1, 1), None), ("back", [ids[1]], ["unheld"], None, date(2026, 6, 1), -3)]
    members = [(f"m{i}", i % 7 != 3, i * 5) for i in range(20)]
    skills = [(f"m{i}", s, False) for i in range(19) for j, s in enumerate([*ids, "unasked"]) if (i * 7 + j * j) % (i % 4 + 2) == 0]
    allocations = [(f"m{i}", f"p{j}", Decimal(10 * j), date(2026, 1 + j, 1 + i), date(2026, 4 + j, 2 + i), False) for i in range(0, 20, 2) for j in range(1, 5)]
    return (
        spark.createDataFrame(asked, ASKED), spark.createDataFrame(members, "team_member_id string, is_active boolean, experience_in_months int"),
        spark.createDataFrame(skills, "team_member_id string, skill_id string, is_deleted boolean"), spark.createDataFrame(allocations, ALLOCATIONS),
    )


def _rows(df):
    return sorted(map(repr, df.select(*sorted(c for c in df.columns if c != "skill_ids")).collect()))


def test_marks_count_what_sets_count(spark):
    tables = _tables(spark)
    marked = matching.candidates(*tables)
    assert "marks" in marked._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(marked) == _rows(matching.candidates(*tables, most=0)) == _rows(matching.candidates(*tables, most=100))
    assert len(_rows(marked)) == 5 * 17


def test_ranks_need_no_sets_of_ids(spark, sf_dir):
    plan = QUERIES["match_rank_in_ranges"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "bit_or" in plan


def test_ids_of_lines_are_made_before_the_joins(spark, sf_dir):
    plan = adapter.order_lines(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    head = plan[: plan.index("Join")]
    assert "upper" not in head and "lpad" not in head


@pytest.mark.parametrize("weight", [0.0, 0.5])
def test_best_are_the_first_ranks(spark, weight):
    tables, config = _tables(spark), ScoringConfig(availability_weight=weight)
    every = matching.candidates(*tables, config).drop("mandatory", "preferred", "skill_ids")
    got = matching.best(*tables, 4, config)
    assert _rows(got) == _rows(rank.top_k(every, 4)) and got.columns == [*every.columns, "rank"]
    assert {r.is_available for r in every.collect()} == {True, False}


def test_days_of_a_member_are_shuffled_once(spark):
    plan = availability.loads(_tables(spark)[3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # equal dates, and then all of a member
