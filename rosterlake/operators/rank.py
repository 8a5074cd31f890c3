"""Ranks within each requisition: highest final score first, ties by member id."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import count_while
from .upsert import numbered


def _by_score() -> Window:
    return Window.partitionBy("request_id").orderBy(F.desc("final_score"), "team_member_id")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each requisition with their rank; each task sends on k rows a requisition at most."""
    return scored.withColumn("rank", F.row_number().over(_by_score())).filter(F.col("rank") <= k)


#: Members of a requisition that one task sorts.
ROWS_A_TASK = 250_000


def ranked(scored: DataFrame, ways: int | None = None, members: DataFrame | None = None) -> DataFrame:
    """All rows with their rank.

    members: the table of members (team_member_id), from whose number ways is
    chosen. With ways = 1 a requisition's members are sorted in one task (it
    spills). With more the ids are cut into so many ranges: a row's rank is its
    number among equals of its score and range, plus the rows of higher scores
    and of earlier ranges, which are counted first. The ranks are the same.
    """
    if ways is None:
        ways = 1 if members is None else -(-members.count() // ROWS_A_TASK)
    if ways <= 1:
        return scored.withColumn("rank", F.row_number().over(_by_score()))
    ids = numbered((scored if members is None else members).select("team_member_id").distinct(), ["team_member_id"], "no_")
    step = max(1, -(-ids.count() // ways))
    cuts = sorted(r[0] for r in ids.filter((F.col("no_") % step == 0) & (F.col("no_") > 0)).select("team_member_id").collect())  # an id for each range
    array = F.from_json(F.lit(json.dumps(cuts)), "array<string>")
    rows = scored.withColumn("part_", count_while(array, lambda c: c <= F.col("team_member_id")))
    counts = rows.groupBy("request_id", "final_score", "part_").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("request_id").orderBy(F.desc("final_score"), "part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before_", before).drop("n")
    own = F.row_number().over(Window.partitionBy("request_id", "final_score", "part_").orderBy("team_member_id"))
    return rows.withColumn("own_", own).join(counts, ["request_id", "final_score", "part_"]).withColumn("rank", (F.col("own_") + F.col("before_")).cast("int")).drop("own_", "before_", "part_")


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Ranked rows with batch_number, total_batches and records_in_batch, size rows a batch."""
    n = F.count(F.lit(1)).over(Window.partitionBy("request_id"))
    numbered = rows.withColumn("batch_number", F.ceil(F.col("rank") / size).cast("int")).withColumn("total_batches", F.ceil(n / size).cast("int"))
    return numbered.withColumn("records_in_batch", F.least(F.lit(size), n - (F.col("batch_number") - 1) * size).cast("int"))
