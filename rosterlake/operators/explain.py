"""What a score means, in words. To be applied after the top k are chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..functions.text import fixed, percent
from . import availability, scoring


def _tags(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in pairs]))


def strengths_and_gaps(rows: DataFrame) -> DataFrame:
    """rows with arrays strengths and gaps, in a fixed order."""
    # The words and cut-offs of the service.
    m, p, e, a = F.col("mandatory_score"), F.col("preferred_score"), F.col("experience_score"), F.col("is_available")
    strengths = [(m >= 0.8, "Strong match on mandatory skills"), (p >= 0.5, "Good match on preferred skills"), (e >= 0.8, "Experience level meets requirements"), (a, "Available for assignment")]
    gaps = [(m < 0.5, "Limited mandatory skills coverage"), (p < 0.3, "Few preferred skills present"), (e < 0.5, "Experience may not fully meet requirements"), (~a, "Limited availability")]
    return rows.withColumn("strengths", _tags(strengths)).withColumn("gaps", _tags(gaps))


def summaries(rows: DataFrame) -> DataFrame:
    """rows with mandatory_skills_summary and preferred_skills_summary (needs the matched lists)."""

    def line(kind: str, of: str) -> Column:
        return F.concat(F.size(f"{kind}_matched").cast("string"), F.lit(f" {kind} skills matched ("), percent(f"{kind}_score"), F.lit(f" of {of})"))

    return rows.withColumn("mandatory_skills_summary", line("mandatory", "requirements")).withColumn("preferred_skills_summary", line("preferred", "preferences"))


def details(pairs: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """(request_id, team_member_id, experience_months, required_months, missing_months, allocated, available_from) of pairs as matching.pairs gives them.

    The numbers behind an explanation: experience against what is asked for (null
    if nothing is), and the first day of the window with less than the threshold allocated.
    """
    months = F.coalesce("experience_in_months", F.lit(0))
    at = (F.col("load"), F.col("w_start"), F.col("w_end"))
    return pairs.select(
        "request_id", "team_member_id", months.alias("experience_months"), F.col("min_months").alias("required_months"), F.greatest(F.coalesce("min_months", F.lit(0)) - months, F.lit(0)).alias("missing_months"),
        F.coalesce(availability.load_of(*at), F.col("busy")[F.col("key")], F.lit(0.0)).alias("allocated"), availability.available_from(*at, config).alias("available_from"),
    )


def lines(rows: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    """rows with fit_level and explanation, an array of four lines (needs skills_matched)."""
    rows = rows.withColumn("fit_level", scoring.fit_level(F.col("final_score"), config))
    overall = F.concat(F.lit("Overall match score: "), fixed("final_score"), F.lit(" ("), F.col("fit_level"), F.lit(" fit)"))
    matched = F.concat(F.lit("Skills matched: "), F.array_join("skills_matched", ", "), F.lit(" (score: "), fixed("skill_score"), F.lit(")"))
    skills = F.when(F.size("skills_matched") > 0, matched).otherwise(F.concat(F.lit("Skill match score: "), fixed("skill_score")))
    experience = F.concat(F.lit("Experience match score: "), fixed("experience_score"))
    free = F.concat(F.lit("Availability: "), fixed("availability_score * 100", 0), F.lit("% capacity ("), F.when(F.col("is_available"), "Available").otherwise("Limited availability"), F.lit(")"))
    return rows.withColumn("explanation", F.array(overall, skills, experience, free))
