"""Bulk batches into the member tables: merged, logged, and committed as one."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import work_type
from ..operators import quality, upsert
from ..session import LONG, written
from ..sources import documents
from ..sources.commits import Conflict, Database, Layout

MEMBER_ATTRIBUTES = ["designation", "profile_type", "is_active", "experience_in_months", "base_location", "work_type", "profile_url"]
SKILL_ATTRIBUTES = ["rating", "experience_in_months", "is_deleted"]
ALLOCATION_ATTRIBUTES = ["allocation_percentage", "start_date", "end_date", "billable", "is_deleted"]
MERGED = ["team_member", "team_member_skill", "team_member_allocation", "skill_certification", "skill_master", "category_master"]


def member_rows(valid: DataFrame) -> DataFrame:
    """Columns of team_member from a batch's members; the name is not kept."""
    return valid.withColumn("is_active", F.col("team_member_status") == "active").withColumn("work_type", work_type(F.col("work_type"), schemas.WORK_TYPES)).select("team_member_id", "pos", *MEMBER_ATTRIBUTES)


def _stamp(pos: str) -> Column:
    return F.struct(F.col(f"{pos}.batch_number").alias("batch_number"), F.col(f"{pos}.batch_id").alias("batch_id")).alias("batch")


def bulk_upsert(batch: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables team_member, team_member_skill, team_member_allocation, skill_certification, skill_master and category_master after some batches.

    batch: rows of schemas.BATCH, or what documents.read_batches gives. Of a key
    that comes more than once the last counts, by batch_number, batch_id and place
    in the batch (nulls first). Merged rows say in the column batch which one
    they come from; where stored rows have that column too, a batch never
    overwrites what a later one has written, however late it comes. A list that is
    missing leaves what is stored.

    Beside the tables: rejected (members that break a rule; nothing of them is
    stored), rejected_skills and rejected_allocations (entries of valid members
    that break one; the member's other entries are stored), unreadable (lines
    that can't be read, with the reason), log (a row of counts a batch) and
    summary (one row of counts of all). Each merged table has a column action.
    The batches are read and taken apart once.
    """
    return _merged(_entries(batch), tables)


def _entries(batch: DataFrame) -> DataFrame:
    """documents.entries with an id row_ and the rules that members break, written: what is parsed once is kept a row a member, for a reader holds many rows of a file at a time and whole batches are long."""
    return written(quality.check(documents.entries(batch), quality.MEMBER_RULES).withColumn("row_", F.monotonically_increasing_id()), "batches", LONG)


def _merged(entries: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """bulk_upsert for entries that are written."""
    spark = entries.sparkSession
    fixed = documents.entry_members(entries)
    valid, rejected = fixed.filter(F.size("broken") == 0).drop("broken"), fixed.filter(F.size("broken") > 0)
    placed = valid.withColumn("pos", F.struct("batch_number", "batch_id", "pos"))
    members = upsert.last_wins(member_rows(placed), ["team_member_id"], ["pos"]).withColumn("batch", _stamp("pos"))
    # Of a member that comes twice all lists count, the later one over the earlier.
    skills, bad_skills = quality.split(documents.skills(placed), quality.SKILL_RULES)
    skills = skills.withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))
    allocations, bad_allocations = quality.split(documents.allocations(placed), quality.ALLOCATION_RULES)
    names = skills.select("skill_id", "skill_name", F.col("category").alias("category_name"), F.struct("member_pos", "pos", "team_member_id").alias("pos"))
    categories = upsert.with_default_category(tables["category_master"], spark)
    unknown = names.join(tables["skill_master"].select("skill_id"), "skill_id", "left_anti").filter("category_name IS NOT NULL AND category_name <> ''")
    categories = categories.unionByName(upsert.new_ids(unknown, categories, "category_id", "category_name", "pos"))
    last_skills = upsert.last_wins(skills.select("team_member_id", "skill_id", "member_pos", "pos", *SKILL_ATTRIBUTES), ["team_member_id", "skill_id"], ["member_pos", "pos"]).withColumn("batch", _stamp("member_pos"))
    last_allocations = upsert.last_wins(allocations, ["team_member_id", "project_id"], ["member_pos", "pos"]).withColumn("batch", _stamp("member_pos"))
    out = {
        "team_member": upsert.merge(tables["team_member"], members, ["team_member_id"], MEMBER_ATTRIBUTES, stamp="batch"),
        "team_member_skill": upsert.merge(tables["team_member_skill"], last_skills, ["team_member_id", "skill_id"], SKILL_ATTRIBUTES, stamp="batch"),
        "team_member_allocation": upsert.merge(tables["team_member_allocation"], last_allocations, ["team_member_id", "project_id"], ALLOCATION_ATTRIBUTES, stamp="batch"),
        "skill_certification": upsert.merge_certifications(tables["skill_certification"], _certifications(skills), "batch"),
        "skill_master": upsert.add_skills(tables["skill_master"], names, categories),
        "category_master": categories,
        "rejected": rejected,
        "rejected_skills": bad_skills,
        "rejected_allocations": bad_allocations,
        "unreadable": documents.unreadable(entries),
    }
    named = {"members": out["team_member"], "skills": out["team_member_skill"], "allocations": out["team_member_allocation"]}
    out["summary"] = upsert.summary(named, fixed)
    for name, bad in (("failed", rejected), ("skills_failed", bad_skills), ("allocations_failed", bad_allocations), ("unreadable_batches", out["unreadable"])):
        out["summary"] = out["summary"].join(F.broadcast(bad.agg(F.count(F.lit(1)).alias(name))))  # one row each
    out["log"] = _log(documents.heads(entries), fixed, named)
    return out


def _log(batch: DataFrame, fixed: DataFrame, merged: dict[str, DataFrame]) -> DataFrame:
    """(batch_id, batch_number, members_received, failed, and of each table rows inserted and updated) for each batch.

    A row that a later batch of the same call overwrites counts as received there
    and as stored for the later one only.
    """
    ids = batch.select(F.col("metadata.batch_id").alias("batch_id"), F.col("metadata.batch_number").alias("batch_number")).groupBy("batch_id").agg(F.max("batch_number").alias("batch_number"))
    zero = lambda name, n: F.coalesce(n, F.lit(0)).cast("long").alias(name)
    counted = fixed.groupBy(F.col("batch_id").alias("of_")).agg(F.count(F.lit(1)).alias("members_received"), F.count_if(F.size("broken") > 0).alias("failed"))
    out = ids.join(counted, F.col("batch_id").eqNullSafe(F.col("of_")), "left").select("batch_id", "batch_number", *[zero(n, F.col(n)) for n in ("members_received", "failed")])
    for name, table in merged.items():
        counts = table.filter("action IN ('inserted', 'updated')").groupBy(F.col("batch.batch_id").alias("of_")).agg(*[F.count_if(F.col("action") == a).alias(f"{name}_{a}") for a in ("inserted", "updated")])
        own = [f"{name}_{a}" for a in ("inserted", "updated")]
        out = out.join(counts, F.col("batch_id").eqNullSafe(F.col("of_")), "left").select(*out.columns, *[zero(n, F.col(n)) for n in own])
    return out


def _certifications(skills: DataFrame) -> DataFrame:
    """Certifications of the batches; of those with one id the last by batch, place, holder and text counts."""
    rows = skills.select("team_member_id", "skill_id", "member_pos", "pos", F.explode("certifications").alias("c")).select("team_member_id", "skill_id", "member_pos", "pos", "c.*").withColumn("batch", _stamp("member_pos"))
    named = rows.filter("certification_id IS NOT NULL AND certification_id <> ''")
    once = upsert.last_wins(named, ["certification_id"], ["batch", "team_member_id", "skill_id", "certificate", "issued_date"]).drop("n_in_batch")
    return once.unionByName(rows.filter("certification_id IS NULL OR certification_id = ''"))


# ------------------------------------------------------------------ committed

_BATCH = ", batch struct<batch_number: int, batch_id: string>"
LAYOUTS = {
    "team_member": Layout("team_member_id string, designation string, profile_type string, is_active boolean, experience_in_months int, base_location string, work_type string, profile_url string" + _BATCH, "team_member_id"),
    "team_member_skill": Layout("team_member_id string, skill_id string, rating int, experience_in_months int, is_deleted boolean" + _BATCH, "team_member_id"),
    "team_member_allocation": Layout("team_member_id string, project_id string, allocation_percentage decimal(5,2), start_date date, end_date date, billable boolean, is_deleted boolean" + _BATCH, "team_member_id"),
    "skill_certification": Layout("certification_id string, certificate string, issuer string, issued_date date, valid_till date, team_member_id string, skill_id string" + _BATCH, "coalesce(nullif(certification_id, ''), team_member_id)"),
    "skill_master": Layout("skill_id string, skill_name string, category_id int", "skill_id", 8),
    "category_master": Layout("category_id int, category_name string"),
    "sync_logs": Layout("batch_id string, batch_number int, members_received long, failed long, members_inserted long, members_updated long, skills_inserted long, skills_updated long, allocations_inserted long, allocations_updated long, at timestamp", "batch_id", 8),
    "failed_batches": Layout("unreadable string, line string, at timestamp", "line", 8, long=True),
}


def database(spark: SparkSession, path: str, buckets: int = 64) -> Database:
    """The six tables, the log of batches (sync_logs) and the lines that could not be read (failed_batches); buckets: of each large table of a new database."""
    return Database(spark, path, {name: replace(layout, buckets=min(buckets, layout.buckets) if layout.buckets < 64 else buckets) for name, layout in LAYOUTS.items()})


#: Batches in the log that go to every task as a list of ids.
MOST_DONE = 100_000


def _fresh(batch: DataFrame, ids: DataFrame, logged: DataFrame) -> DataFrame:
    """The batches whose id the log lacks. Only ids are shuffled, for the batches are large."""
    done = written(ids.join(logged.select("batch_id"), "batch_id", "left_semi").distinct(), "done").select(F.col("batch_id").alias("done_"))
    n = done.count()
    if not n:
        return batch
    fresh = batch.join(F.broadcast(done) if n <= MOST_DONE else done, F.col("metadata.batch_id") == F.col("done_"), "left_anti")
    return fresh if n <= MOST_DONE else written(fresh, "fresh", LONG)  # read many times


def _new_lines(bad: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of bad (with an id row_ of their own) whose line is not stored, of equal lines one. They are compared by their SHA-256, for they are long."""
    key = F.sha2("line", 256).alias("key_")
    first = bad.select(key, "row_").groupBy("key_").agg(F.min("row_").alias("row_"))
    new = written(first.join(stored.select(key), "key_", "left_anti").select("row_"), "new_lines")
    return bad.join(new, "row_", "left_semi")


def apply(db: Database, batch: DataFrame, at: str, tries: int = 5) -> int:
    """Puts batches into a database in one commit and gives the version that then holds them.

    A batch whose id the log has is left out, so it may come again at any time; of
    one id that comes twice in one call both count as that batch. Only the
    buckets that the batches touch are read and written. Where someone else
    commits meanwhile, the whole is done again on what is there then.
    """
    now = F.lit(at).cast("timestamp").alias("at")
    entries = _entries(batch)
    ids, bad = documents.heads(entries).select(F.col("metadata.batch_id").alias("batch_id")), documents.unreadable(entries, "row_")
    for left in range(tries - 1, -1, -1):
        base = db.version()
        in_log = db.touched("sync_logs", ids)
        logged = db.read("sync_logs", base, in_log)
        fresh = _fresh(entries, ids, logged)
        in_failed = db.touched("failed_batches", bad)
        failed = db.read("failed_batches", base, in_failed)
        lines = _new_lines(bad, failed).select("unreadable", "line", now)
        if documents.heads(fresh).isEmpty() and lines.isEmpty():
            return base
        members = documents.entry_members(fresh)
        certified = members.select("team_member_id", F.explode("skills").alias("s")).select("team_member_id", F.explode("s.certifications").alias("c")).select("team_member_id", "c.certification_id")
        own = db.touched("team_member", members)
        touched = {"team_member": own, "team_member_skill": own, "team_member_allocation": own, "skill_certification": db.touched("skill_certification", certified)}
        out = _merged(fresh, {name: db.read(name, base, touched.get(name)) for name in MERGED})
        changes = {name: (out[name], touched.get(name)) for name in MERGED}
        changes["sync_logs"] = (logged.unionByName(out["log"].select("*", now)), in_log)
        changes["failed_batches"] = (failed.unionByName(lines), in_failed)
        try:
            return db.commit(base, changes, {"at": at})
        except Conflict:
            if not left:
                raise
    raise AssertionError("tries must be 1 or more")


def all_tables(db: Database, version: int | None = None) -> DataFrame:
    """(name, rows): how many rows each of the merged tables has in a version."""
    counts = [db.read(name, version).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows")) for name in MERGED]
    return reduce(DataFrame.unionByName, counts)
