"""The best k members of each requisition from an index of skills, without making all pairs.

A member's score is what the requisition gives anyone, plus a share for each
wanted skill that it has, plus one for experience. The index is the list of
members of each skill. Of a requisition the shortest lists are read until they
could hold k members; the k-th best score of these is a bound that the best k
reach. The lists are then read on, shortest first, until all that is left, with
experience, could not reach the bound any more: a member on none of the lists
read is not among the best. Members without any wanted skill differ by
experience alone, so where they can come in, those with the smallest ids fill up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..session import written
from . import matching, rank
from .upsert import numbered

#: What rounding may add to a sum of shares.
SLACK = 1e-9


def _lists(asked: DataFrame, have: DataFrame, config: ScoringConfig) -> DataFrame:
    """(request_id, skill_id, base, share, rest, before): of each wanted skill its share of the score, the shares from its list on, and the members on all shorter lists of the requisition."""
    share = lambda kind, weight: F.transform(F.array_distinct(kind), lambda s: F.struct(s.alias("skill_id"), (F.lit(config.skill_weight * weight) / F.size(F.array_distinct(kind))).alias("share")))
    nothing = lambda kind, weight: F.when(F.size(kind) == 0, config.skill_weight * weight).otherwise(0.0)
    base = nothing("mandatory", config.mandatory_weight) + nothing("preferred", config.preferred_weight)
    rows = asked.select("request_id", base.alias("base"), F.explode(F.concat(share("mandatory", config.mandatory_weight), share("preferred", config.preferred_weight))).alias("s"))
    wanted = rows.groupBy("request_id", "base", "s.skill_id").agg(F.sum("s.share").alias("share"))
    lengths = have.join(wanted.select("skill_id").distinct(), "skill_id", "left_semi").groupBy("skill_id").agg(F.count(F.lit(1)).alias("n"))
    by_length = Window.partitionBy("request_id").orderBy("n", "skill_id")  # the skills of one requisition
    rest = F.sum("share").over(by_length.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    before = F.coalesce(F.sum("n").over(by_length.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return wanted.join(lengths, "skill_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumns({"rest": rest, "before": before}).select("request_id", "skill_id", "base", "share", "rest", "before")


def _kth(scored: DataFrame, k: int) -> DataFrame:
    return rank.top_k(scored.select("request_id", "team_member_id", "final_score"), k).filter(F.col("rank") == k).select("request_id", F.col("final_score").alias("bound"))


def _on_lists(profiles: DataFrame, lists: DataFrame) -> DataFrame:
    """profiles beside each request_id for which they are on one of its lists (request_id, skill_id)."""
    readers = lists.groupBy("skill_id").agg(F.collect_set("request_id").alias("ids")).agg(F.map_from_entries(F.collect_list(F.struct("skill_id", "ids"))).alias("readers_"))
    hit = F.array_distinct(F.flatten(F.transform(F.array_intersect("skill_ids", F.map_keys("readers_")), lambda s: F.col("readers_")[s])))
    return profiles.filter("skill_ids IS NOT NULL").crossJoin(F.broadcast(readers)).select(*profiles.columns, F.explode(hit).alias("request_id"))


def _fill(asked: DataFrame, active: DataFrame, short: DataFrame, k: int) -> DataFrame:
    """(request_id, team_member_id): for short requisitions (request_id, n_scored) enough of the smallest ids, of those with the experience asked for and of all."""
    needs = short.join(asked.select("request_id", F.coalesce("min_months", F.lit(-1)).alias("least")), "request_id").select("request_id", F.explode(F.array(F.struct("least", (F.col("n_scored") + k).alias("need")), F.struct(F.lit(-1).alias("least"), (F.col("n_scored") + 2 * k).alias("need")))).alias("x")).select("request_id", "x.*").distinct()
    most = needs.groupBy("least").agg(F.max("need").alias("most"))
    held = active.select("team_member_id", F.coalesce("experience_in_months", F.lit(0)).alias("months")).join(F.broadcast(most.select("least")), F.col("months") >= F.col("least"))  # a row for each different bound asked for
    placed = numbered(held.select("least", "team_member_id"), ["least", "team_member_id"], "no_")
    first = placed.groupBy("least").agg(F.min("no_").alias("first_"))
    near = placed.join(F.broadcast(first.join(most, "least")), "least").filter(F.col("no_") - F.col("first_") < F.col("most"))
    return needs.join(near.select("least", "team_member_id", (F.col("no_") - F.col("first_")).alias("at_")), "least").filter(F.col("at_") < F.col("need")).select("request_id", "team_member_id")


def pairs_to_score(requisitions: DataFrame, members: DataFrame, skills: DataFrame, profiles: DataFrame, k: int, config: ScoringConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Two tables (request_id, team_member_id): the pairs that are scored, and a few of them among which are the best k of each requisition. A member's id must be its own.

    Scored pairs are made where the members lie, from their skills and the lists
    that each requisition reads, which are broadcast like the requisitions
    themselves; no pair is shuffled, only the k best of each task.
    """
    asked = matching.requisition_windows(requisitions, config)
    wanted = matching.wanted_rows(asked)
    active = members.filter("is_active").select("team_member_id", "experience_in_months")
    if not config.include_deleted_skills:
        skills = skills.filter(~F.coalesce("is_deleted", F.lit(False)))
    have = skills.select("skill_id", "team_member_id").distinct().join(active.select("team_member_id"), "team_member_id", "left_semi")
    lists = written(_lists(asked, have, config), "lists")
    score = lambda pairs: matching.scored(pairs.join(F.broadcast(wanted), "request_id"), config)
    begun = lists.filter(F.col("before") < k)
    bounds = _kth(score(_on_lists(profiles, begun)), k)
    needed = lists.join(bounds, "request_id", "left").filter((F.col("before") < k) | F.col("bound").isNull() | (F.col("base") + F.col("rest") + config.experience_weight >= F.col("bound") - SLACK))
    hits = _on_lists(profiles, written(needed.select("request_id", "skill_id"), "needed"))
    first = written(rank.top_k(score(hits).select("request_id", "team_member_id", "final_score"), k), "first")
    n_scored = hits.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_scored"))
    kth = first.filter(F.col("rank") == k).select("request_id", F.col("final_score").alias("bound"))
    reached = asked.select("request_id").join(n_scored, "request_id", "left").join(kth, "request_id", "left")
    none = lists.groupBy("request_id").agg(F.max("base").alias("base"))
    reached = reached.join(none, "request_id", "left").withColumn("base", F.coalesce("base", F.lit(config.skill_weight * (config.mandatory_weight + config.preferred_weight))))
    short = reached.filter(F.col("bound").isNull() | (F.col("base") + config.experience_weight >= F.col("bound") - SLACK)).select("request_id", F.coalesce("n_scored", F.lit(0)).alias("n_scored"))
    more = written(_fill(asked, active, short, k), "more")
    return hits.select("request_id", "team_member_id").unionByName(more).distinct(), first.select("request_id", "team_member_id").unionByName(more).distinct()


def best(requisitions: DataFrame, members: DataFrame, skills: DataFrame, allocations: DataFrame, k: int, config: ScoringConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(the rows that rank.top_k gives of all candidates, the pairs that were scored for them).

    With availability in the score (config.availability_weight) a skill says too
    little about it, and all pairs are scored.
    """
    asked = matching.requisition_windows(requisitions, config)
    profiles = matching.member_profiles(members, skills, allocations, asked, config)
    if config.availability_weight:
        every = matching.candidates(requisitions, members, skills, allocations, config)
        return rank.top_k(every, k), every.select("request_id", "team_member_id")
    profiles = written(profiles, "profiles")
    pairs, last = pairs_to_score(requisitions, members, skills, profiles, k, config)
    return rank.top_k(matching.scored(last.join(profiles, "team_member_id").join(matching.wanted_rows(asked), "request_id"), config), k), pairs
