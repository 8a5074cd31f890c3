"""Synthetic members, allocations and requisitions of any size, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SKILLS = tuple(f"SKILL_{i:02d}" for i in range(40))


def _draw(seed: int, what: str, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(what), *keys)


def _below(n: int | Column, seed: int, what: str, *keys: str) -> Column:
    return F.pmod(_draw(seed, what, *keys), F.lit(n) if isinstance(n, int) else n).cast("int")


def _some(n: Column, seed: int, what: str) -> Column:
    """n distinct skills."""
    order = F.array_sort(F.transform(F.array(*[F.lit(s) for s in SKILLS]), lambda s: F.struct(F.xxhash64(F.lit(seed), F.lit(what), "id", s).alias("h"), s.alias("s"))))
    return F.slice(F.transform(order, lambda x: x["s"]), F.lit(1), n)


def members(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """3-5 primary and 2-4 secondary skills (none twice), 2-20 years of experience."""
    rows = spark.range(n).withColumn("primary", _some(_below(3, seed, "np", "id") + 3, seed, "p"))
    rows = rows.withColumn("secondary", F.slice(F.array_except(_some(F.lit(len(SKILLS)), seed, "s"), "primary"), F.lit(1), _below(3, seed, "ns", "id") + 2))
    return rows.select(F.concat(F.lit("GEN"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("team_member_id"), "primary", "secondary", (12 * (_below(19, seed, "y", "id") + 2)).alias("experience_in_months"), F.lit(True).alias("is_active"), "id")


def allocations(members_: DataFrame, as_of: str, seed: int = 0) -> DataFrame:
    """0-2 a member, of 25, 50, 75 or 100 per cent, begun in the last year, 90 to 540 days long."""
    rows = members_.select("team_member_id", "id", F.explode(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), _below(3, seed, "na", "id"))).alias("k"))
    start = F.date_sub(F.lit(as_of).cast("date"), _below(366, seed, "d", "id", "k"))
    return rows.select("team_member_id", F.concat_ws("-", F.lit("P"), "id", "k").alias("project_id"), ((_below(4, seed, "pct", "id", "k") + 1) * 25).cast("decimal(5,2)").alias("allocation_percentage"), start.alias("start_date"), F.date_add(start, _below(451, seed, "l", "id", "k") + 90).alias("end_date"), F.lit(True).alias("billable"), F.lit(False).alias("is_deleted"))


def requisitions(spark: SparkSession, n: int, as_of: str, seed: int = 0) -> DataFrame:
    """4-8 skills: the first five mandatory, the rest preferred."""
    rows = spark.range(n).withColumn("all", _some(_below(5, seed, "nr", "id") + 4, seed, "r"))
    return rows.select(
        F.concat(F.lit("GENREQ"), F.col("id").cast("string")).alias("request_id"), F.slice("all", 1, 5).alias("mandatory"), F.slice("all", 6, 3).alias("preferred"), (12 * _below(8, seed, "m", "id")).alias("min_months"),
        F.date_add(F.lit(as_of).cast("date"), _below(60, seed, "st", "id")).alias("expected_start_date"), (_below(12, seed, "du", "id") + 1).alias("requisition_duration_month"),
    )
