"""Scores of one candidate for one requisition, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig


def ratio(have: Column, wanted: Column) -> Column:
    """The share of the distinct wanted ids that are there; 1 if none is wanted."""
    ids = F.array_distinct(wanted)
    return F.when(F.size(ids) > 0, F.size(F.array_intersect(ids, have)) / F.size(ids)).otherwise(1.0)


def skill_score(mandatory: Column, preferred: Column, config: ScoringConfig = DEFAULT) -> Column:
    return F.lit(config.mandatory_weight) * mandatory + F.lit(config.preferred_weight) * preferred


def experience_score(months: Column, least: Column) -> Column:
    """0 for less than the least experience asked for; too much is no fault. Unknown experience is 0 months."""
    return F.when(least.isNotNull() & (F.coalesce(months, F.lit(0)) < least), 0.0).otherwise(1.0)


def final_score(skill: Column, experience: Column, config: ScoringConfig = DEFAULT, availability: Column | None = None) -> Column:
    score = F.lit(config.skill_weight) * skill + F.lit(config.experience_weight) * experience
    return score + F.lit(config.availability_weight) * availability if config.availability_weight and availability is not None else score


def fit_level(score: Column, config: ScoringConfig = DEFAULT) -> Column:
    return F.when(score >= config.high, "HIGH").when(score >= config.medium, "MEDIUM").otherwise("LOW")
