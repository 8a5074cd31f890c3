"""Every requisition against every active member.

All that is known of a member is brought into one row first: the set of its
skills and the running sums of its allocations, from which the load of any window
is read. That takes one shuffle by member. The requisitions, the stated queries, are broadcast in blocks of a set
size, so the pairs are made and scored where the members lie.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..session import written
from . import availability, rank, scoring

#: Requisitions that are broadcast at a time, and their bytes.
BLOCK, BLOCK_BYTES = 10_000, 32 << 20
#: Different skills that requisitions want, up to which those of a member are kept as bits, and the bits of a number.
MARKED, WORD = 1024, 64


def _window_key(start: str, end: str) -> F.Column:
    return F.concat_ws("/", F.col(start).cast("string"), F.col(end).cast("string"))


def requisition_windows(requisitions: DataFrame, config: ScoringConfig = DEFAULT) -> DataFrame:
    start, end = availability.window(F.col("expected_start_date"), F.col("requisition_duration_month"), config)
    return requisitions.withColumn("w_start", start).withColumn("w_end", end)


def member_profiles(members: DataFrame, skills: DataFrame, allocations: DataFrame, windows: DataFrame, config: ScoringConfig = DEFAULT, marked: list[str] | None = None) -> DataFrame:
    """Active members (a null flag is not active) with skill_ids, load (see availability.loads), and a map busy from windows that end before they start to allocation.

    With marked (see marked_skills) also marks: the bits of the marked skills that a member has, WORD to a number.
    """
    if not config.include_deleted_skills:
        skills = skills.filter(~F.coalesce("is_deleted", F.lit(False)))
    found = [F.collect_set("skill_id").alias("skill_ids")]
    if marked:
        places = skills.sparkSession.range(0, 1, 1, 1).select(F.posexplode(F.from_json(F.lit(json.dumps(marked)), "array<string>")).alias("no_", "skill_id"))
        skills = skills.join(F.broadcast(places), "skill_id", "left")  # MARKED rows at most
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("no_") % WORD)
        found.append(F.array(*[F.bit_or(F.when(F.floor(F.col("no_") / WORD) == i, bit)) for i in range(_words(marked))]).alias("marks"))
    have = skills.groupBy("team_member_id").agg(*found)
    active = members.filter("is_active").select("team_member_id", "experience_in_months")
    return with_loads(active.join(have, "team_member_id", "left"), allocations, windows)


def with_loads(rows: DataFrame, allocations: DataFrame, windows: DataFrame) -> DataFrame:
    """rows (with a team_member_id) with load and busy (see member_profiles)."""
    out = rows.join(availability.loads(allocations), "team_member_id", "left")
    crossed = windows.filter("w_start > w_end")
    if crossed.isEmpty():
        return out.withColumn("busy", F.lit(None).cast("map<string, double>"))
    busy = availability.allocated(allocations, crossed).select("team_member_id", F.struct(_window_key("w_start", "w_end").alias("key"), F.col("allocated").alias("value")).alias("e"))
    return out.join(busy.groupBy("team_member_id").agg(F.map_from_entries(F.collect_list("e")).alias("busy")), "team_member_id", "left")


def _words(marked: list[str]) -> int:
    return -(-len(marked) // WORD)


def marked_skills(asked: DataFrame, most: int = MARKED) -> list[str]:
    """The different skills that requisitions want, sorted; none if they are more than most."""
    wanted = asked.select(F.explode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("mandatory", "preferred")])).alias("s")).filter("s IS NOT NULL").distinct()
    found = sorted(r.s for r in wanted.limit(most + 1).collect())
    return found if len(found) <= most else []


def _with_marks(wanted: DataFrame, marked: list[str]) -> DataFrame:
    """wanted with the bits of the skills of both lists (see member_profiles)."""

    def bits(kind: str, i: int) -> F.Column:
        place = lambda s: F.array_position(F.from_json(F.lit(json.dumps(marked[i * WORD : (i + 1) * WORD])), "array<string>"), s)
        bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), (place(s) - 1).cast("int"))
        return F.aggregate(F.filter(kind, lambda s: place(s) > 0), F.lit(0).cast("long"), lambda at, s: at.bitwiseOR(bit(s)))

    return wanted.withColumns({f"{kind}_marks": F.array(*[bits(kind, i) for i in range(_words(marked))]) for kind in ("mandatory", "preferred")})


def with_each(rows: DataFrame, asked: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows (with a team_member_id) beside each of asked (request_id, ...), the stated queries, which are broadcast in blocks of bounded number and size.

    Rows are few beside the pairs that are made of them, so they are dealt to
    all tasks first; by their size alone they would be put together in a few.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "team_member_id")
    size = sum((F.octet_length(F.to_json(F.struct(c))) for c in asked.columns), F.lit(64))
    n, total = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-total // block_bytes))
    parts = [asked.filter(F.pmod(F.xxhash64("request_id"), F.lit(blocks)) == i) for i in range(blocks)] if blocks > 1 else [asked]
    return reduce(DataFrame.unionByName, [rows.crossJoin(F.broadcast(p)) for p in parts])


def wanted_rows(asked: DataFrame) -> DataFrame:
    """What a pair needs of its requisition; asked has w_start and w_end (see requisition_windows)."""
    return asked.select(
        "request_id", F.array_distinct("mandatory").alias("mandatory"), F.array_distinct("preferred").alias("preferred"), "min_months",
        F.col("w_start").cast("date").alias("w_start"), F.col("w_end").cast("date").alias("w_end"), _window_key("w_start", "w_end").alias("key"),
    )


def _allocated() -> F.Column:
    return F.coalesce(availability.load_of(F.col("load"), F.col("w_start"), F.col("w_end")), F.col("busy")[F.col("key")], F.lit(0.0))


def scored(pairs: DataFrame, config: ScoringConfig = DEFAULT, words: int = 0) -> DataFrame:
    """The scores of pairs, each with a member's profile and what its requisition wants; words: the numbers of marks, if there are any."""
    none = F.array().cast("array<string>")
    pairs = pairs.withColumn("skill_ids", F.coalesce("skill_ids", none)).withColumn("allocated", _allocated())
    if words:
        hits = lambda kind: sum((F.coalesce(F.bit_count(F.get("marks", F.lit(i)).bitwiseAND(F.get(f"{kind}_marks", F.lit(i)))), F.lit(0)) for i in range(words)), F.lit(0))
        share = lambda kind: F.when(F.size(kind) > 0, hits(kind) / F.size(kind)).otherwise(1.0)
    else:
        share = lambda kind: scoring.ratio(F.col("skill_ids"), F.col(kind))
    pairs = pairs.withColumn("mandatory_score", share("mandatory")).withColumn("preferred_score", share("preferred"))
    pairs = pairs.withColumn("skill_score", scoring.skill_score(F.col("mandatory_score"), F.col("preferred_score"), config))
    pairs = pairs.withColumn("experience_score", scoring.experience_score(F.col("experience_in_months"), F.col("min_months")))
    pairs = pairs.withColumn("availability_score", availability.capacity(F.col("allocated")) / 100.0)
    return pairs.select(
        "request_id", "team_member_id", "mandatory_score", "preferred_score", "skill_score", "experience_score", "availability_score",
        scoring.final_score(F.col("skill_score"), F.col("experience_score"), config, F.col("availability_score")).alias("final_score"),
        availability.is_available(F.col("allocated"), config).alias("is_available"),
        "mandatory", "preferred", "skill_ids",
    )


def _asked(requisitions: DataFrame, config: ScoringConfig) -> DataFrame:
    """The stated queries with their windows, worked out once: they are few, but the dictionary that they are looked up in may be large."""
    return written(requisition_windows(requisitions, config).select("request_id", "mandatory", "preferred", "min_months", "w_start", "w_end"), "asked")


def _pairs(asked: DataFrame, members: DataFrame, skills: DataFrame, allocations: DataFrame, config: ScoringConfig, block: int, marked: list[str]) -> DataFrame:
    wanted = wanted_rows(asked)
    return with_each(member_profiles(members, skills, allocations, asked, config, marked), _with_marks(wanted, marked) if marked else wanted, block)


def pairs(requisitions: DataFrame, members: DataFrame, skills: DataFrame, allocations: DataFrame, config: ScoringConfig = DEFAULT, block: int = BLOCK) -> DataFrame:
    """Each requisition beside each active member: the member's profile and what the requisition wants.

    requisitions: request_id, mandatory, preferred (arrays of skill ids),
    min_months, expected_start_date, requisition_duration_month.
    """
    return _pairs(_asked(requisitions, config), members, skills, allocations, config, block, [])


def candidates(requisitions: DataFrame, members: DataFrame, skills: DataFrame, allocations: DataFrame, config: ScoringConfig = DEFAULT, block: int = BLOCK, most: int = MARKED) -> DataFrame:
    """A row for each requisition and active member with its scores, also without any match; arguments as of pairs.

    Wanted skills are counted by bits if there are at most `most` different ones, and by sets of ids beyond.
    """
    return _candidates(_asked(requisitions, config), members, skills, allocations, config, block, most)


def _candidates(asked: DataFrame, members: DataFrame, skills: DataFrame, allocations: DataFrame, config: ScoringConfig, block: int = BLOCK, most: int = MARKED) -> DataFrame:
    marked = marked_skills(asked, most)
    return scored(_pairs(asked, members, skills, allocations, config, block, marked), config, _words(marked))


def best(requisitions: DataFrame, members: DataFrame, skills: DataFrame, allocations: DataFrame, k: int, config: ScoringConfig = DEFAULT) -> DataFrame:
    """The k best candidates of each requisition with their rank.

    All pairs are scored. Unless availability is in the score, it is looked up
    afterwards, for those k alone.
    """
    asked = _asked(requisitions, config)
    every = _candidates(asked, members, skills, allocations, config).drop("mandatory", "preferred", "skill_ids")
    if config.availability_weight:
        return rank.top_k(every, k)
    few = written(rank.top_k(every.drop("availability_score", "is_available"), k), "best")
    ids = few.select("team_member_id").distinct()
    taken = with_loads(ids, allocations.join(ids, "team_member_id", "left_semi"), asked)
    rows = few.join(taken, "team_member_id").join(wanted_rows(asked).select("request_id", "w_start", "w_end", "key"), "request_id").withColumn("allocated", _allocated())
    return rows.withColumns({"availability_score": availability.capacity(F.col("allocated")) / 100.0, "is_available": availability.is_available(F.col("allocated"), config)}).select(*[c for c in every.columns], "rank")


def with_reasons(scored: DataFrame) -> DataFrame:
    """scored with mandatory_matched, preferred_matched, and skills_matched (both, a skill of both lists twice), in the order of the lists."""
    out = scored.withColumn("mandatory_matched", F.array_intersect("mandatory", "skill_ids")).withColumn("preferred_matched", F.array_intersect("preferred", "skill_ids"))
    return out.withColumn("skills_matched", F.concat("mandatory_matched", "preferred_matched")).drop("mandatory", "preferred", "skill_ids")
