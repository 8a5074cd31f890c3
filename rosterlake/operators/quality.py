"""Validation: each row with the names of the rules that it breaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


#: A rule is made into a column when it is applied, for a column needs a session.
Rule = Callable[[], Column]


def between(c: str, low: float, high: float | None = None) -> Rule:
    """Null is fine."""
    return lambda: F.coalesce(F.col(c) >= low if high is None else (F.col(c) >= low) & (F.col(c) <= high), F.lit(True))


def one_of(c: str, values: tuple[str, ...]) -> Rule:
    return lambda: F.coalesce(F.col(c).isin(*values), F.lit(False))


def in_order(low: str, high: str) -> Rule:
    """Null in either is fine."""
    return lambda: F.coalesce(F.col(high) >= F.col(low), F.lit(True))


def required(c: str) -> Rule:
    return lambda: F.col(c).isNotNull()


def both(one: Rule, other: Rule) -> Rule:
    return lambda: one() & other()


def check(rows: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """rows with the array broken: names of the rules that do not hold, in the order given."""
    return rows.withColumn("broken", F.array_compact(F.array(*[F.when(~rule(), F.lit(name)) for name, rule in rules.items()])))


def split(rows: DataFrame, rules: dict[str, Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the array broken)."""
    checked = check(rows, rules)
    return checked.filter(F.size("broken") == 0).drop("broken"), checked.filter(F.size("broken") > 0)


MEMBER_RULES = {
    "team_member_id": required("team_member_id"), "full_name": required("full_name"), "status": one_of("team_member_status", schemas.MEMBER_STATUSES),
    "experience_in_months": both(required("experience_in_months"), between("experience_in_months", 0)),
}
SKILL_RULES = {"skill_id": required("skill_id"), "skill_name": required("skill_name"), "rating": between("rating", 1, 10), "experience_in_months": between("experience_in_months", 0)}
ALLOCATION_RULES = {"project_id": required("project_id"), "allocation_percentage": between("allocation_percentage", 0, 100)}
REQUISITION_RULES = {
    "request_id": required("request_id"), "title": required("job_description.title"), "priority": one_of("job_description.priority", schemas.PRIORITIES), "duration": between("job_description.requisition_duration_month", 0),
    "min_months": between("job_description.experience.min_months", 0), "max_months": between("job_description.experience.max_months", 0), "experience": in_order("job_description.experience.min_months", "job_description.experience.max_months"),
}


def known_requests(incoming: DataFrame, requests: DataFrame) -> DataFrame:
    """Incoming requests whose request_id is taken."""
    return incoming.join(requests.select("request_id"), "request_id", "left_semi")


def new_requests(incoming: DataFrame, requests: DataFrame) -> DataFrame:
    return incoming.join(requests.select("request_id"), "request_id", "left_anti")


def orphans(child: DataFrame, columns: list[str], parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of child that point to no row of parent; a null points to nothing and is no orphan."""
    target = parent.select(*[F.col(k).alias(f"parent_{k}") for k in keys])
    on = [F.col(c) == F.col(f"parent_{k}") for c, k in zip(columns, keys, strict=True)]
    return child.dropna(subset=columns).join(target, on, "left_anti")
