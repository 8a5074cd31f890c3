"""Nested JSON payloads: read with their schema, and taken apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


#: Why a line could not be read: it is no JSON, a value is of another type than its column's, or its schema_version has no reader.
NOT_JSON, WRONG_TYPE, UNKNOWN_VERSION = "not_json", "wrong_type", "unknown_version"


def from_lines(lines: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema, unreadable (why a line can't be read; null if it can) and line (only of such lines).

    lines: a column value, one JSON object a line. Keys that the schema lacks are
    ignored. Of an unreadable line no column is given: a value of the wrong type
    costs the whole line, as it does in the service. Blank lines are left out.
    """
    read = F.from_json("value", f"{schema}, unreadable_ string", {"columnNameOfCorruptRecord": "unreadable_"})
    rows = lines.filter(F.trim("value") != "").select("value", read.alias("r"))
    bad = F.col("r").isNull() | F.col("r.unreadable_").isNotNull() | ~F.coalesce(F.startswith(F.ltrim("value"), F.lit("{")), F.lit(False))
    why = F.when(bad, F.when(F.expr("try_parse_json(value)").isNull(), NOT_JSON).otherwise(WRONG_TYPE))
    names = [f.name for f in lines.sparkSession.createDataFrame([], schema).schema]
    return rows.withColumn("unreadable", why).select(*[F.when(F.col("unreadable").isNull(), F.col(f"r.{c}")).alias(c) for c in names], "unreadable", F.when(F.col("unreadable").isNotNull(), F.col("value")).alias("line"))


@dataclass(frozen=True)
class Reader:
    """How payloads of some schema versions are read: their schema, and what makes a row of the newest table of one."""

    schema: str
    current: Callable[[DataFrame], DataFrame] = lambda rows: rows


def _from_1_1(rows: DataFrame) -> DataFrame:
    """Version 1.1 has one list of skills with a mark, and the bounds of experience in two fields."""
    j = F.col("job_description")
    names = lambda required: F.transform(F.filter(j["skills"], lambda s: F.coalesce(s["required"], F.lit(False)) == required), lambda s: s["name"])
    made = {"experience": F.struct(j["min_experience_months"].alias("min_months"), j["max_experience_months"].alias("max_months")), "mandatory_skills": names(True), "preferred_skills": names(False)}
    return rows.withColumn("job_description", F.struct(*[made.get(c, j[c]).alias(c) for c in schemas.JOB_FIELDS]))


#: Readers by schema_version; 1 and 1.0 are the service's.
REQUISITION_READERS = {"1": Reader(schemas.REQUISITION), "1.0": Reader(schemas.REQUISITION), "1.1": Reader(schemas.REQUISITION_1_1, _from_1_1)}


def read_versions(lines: DataFrame, readers: dict[str, Reader], field: str = "schema_version") -> DataFrame:
    """from_lines for lines (value) of several schema versions, each read by its own reader and brought into the one table.

    A line whose version has no reader, or that has none, is unreadable
    (unknown_version); so is one that its reader finds unreadable.
    """
    version = F.coalesce(F.get_json_object("value", f"$.{field}"), F.lit(""))
    rows = lines.select("value", version.alias("version"))
    parts, by_reader = [], {}
    for name, reader in readers.items():
        by_reader.setdefault(reader, []).append(name)
    for reader, names in by_reader.items():
        parts.append(reader.current(from_lines(rows.filter(F.col("version").isin(names)).select("value"), reader.schema)))
    columns = parts[0].columns
    none = [F.lit(None).cast(parts[0].schema[c].dataType).alias(c) for c in columns if c not in ("unreadable", "line")]
    why = F.when(F.expr("try_parse_json(value)").isNull(), NOT_JSON).otherwise(UNKNOWN_VERSION)
    others = rows.filter(~F.col("version").isin(list(readers)) & (F.trim("value") != "")).select(*none, why.alias("unreadable"), F.col("value").alias("line"))
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in [*parts, others]])


def read_requisitions(spark: SparkSession, path: str) -> DataFrame:
    """One requisition a line, see from_lines."""
    return from_lines(spark.read.text(path), schemas.REQUISITION)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """One batch a line, see from_lines."""
    return from_lines(spark.read.text(path), schemas.BATCH)


def readable(rows: DataFrame) -> DataFrame:
    """Those of from_lines that could be read, or all rows if they come from elsewhere."""
    return rows.filter("unreadable IS NULL").drop("unreadable", "line") if "unreadable" in rows.columns else rows


def unreadable(rows: DataFrame, *more: str) -> DataFrame:
    """(unreadable, line, and more of the columns) of those that could not."""
    if "unreadable" in rows.columns:
        return rows.filter("unreadable IS NOT NULL").select("unreadable", "line", *more)
    none = F.lit(None).cast("string")
    return rows.filter("false").select(none.alias("unreadable"), none.alias("line"), *more)


def parse(payloads: DataFrame, column: str, schema) -> DataFrame:
    """payloads with column parsed in place of its JSON text."""
    return payloads.withColumn(column, F.from_json(column, schema))


def members(batches: DataFrame) -> DataFrame:
    """A row for each member of each batch: batch_number, batch_id, pos (its place), and its fields."""
    rows = batches.select(F.col("metadata.batch_number").alias("batch_number"), F.col("metadata.batch_id").alias("batch_id"), F.posexplode("team_members").alias("pos", "m"))
    return rows.select("batch_number", "batch_id", "pos", "m.*")


def entries(batches: DataFrame) -> DataFrame:
    """What batches hold, in small rows: one for each member (its batch's metadata, pos and fields), one without a pos for a batch that has no members, and one for each line that can't be read (unreadable, line)."""
    none = F.lit(None).cast("string")
    why = ["unreadable", "line"] if "unreadable" in batches.columns else [none.alias("unreadable"), none.alias("line")]
    return batches.select("metadata", *why, F.posexplode_outer("team_members").alias("pos", "m")).select("metadata", "pos", "m.*", "unreadable", "line")


def heads(entries_: DataFrame) -> DataFrame:
    """One of the entries of each batch that could be read."""
    return entries_.filter("unreadable IS NULL AND coalesce(pos, 0) = 0")


def entry_members(entries_: DataFrame) -> DataFrame:
    """Those of entries that are members, as members gives them."""
    fields = [c for c in entries_.columns if c not in ("metadata", "pos", "unreadable", "line", "row_")]
    return entries_.filter("pos IS NOT NULL").select(F.col("metadata.batch_number").alias("batch_number"), F.col("metadata.batch_id").alias("batch_id"), "pos", *fields)


def skills(members_: DataFrame) -> DataFrame:
    rows = members_.select("team_member_id", F.col("pos").alias("member_pos"), F.posexplode("skills").alias("pos", "s"))
    return rows.select("team_member_id", "member_pos", "pos", "s.*")


def certifications(skills_: DataFrame) -> DataFrame:
    return skills_.select("team_member_id", "skill_id", F.explode("certifications").alias("c")).select("team_member_id", "skill_id", "c.*")


def allocations(members_: DataFrame) -> DataFrame:
    rows = members_.select("team_member_id", F.col("pos").alias("member_pos"), F.posexplode("allocations").alias("pos", "a")).select("team_member_id", "member_pos", "pos", "a.*")
    # A percentage that no decimal(5,2) can hold is brought to its ends, where the rules still find it.
    given = F.col("allocation_percentage")
    percentage = F.when(given.isNotNull(), F.least(F.greatest(given, F.lit(-999.99)), F.lit(999.99)).cast("decimal(5,2)"))
    return rows.withColumn("allocation_percentage", percentage).withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))


def jobs(requisitions: DataFrame) -> DataFrame:
    """request_id and the fields of the job description, with defaults for an empty title and role and missing lists."""
    from ..functions.text import default, default_list

    j = F.col("job_description")
    return requisitions.select(
        "request_id", default(j["title"], "Software Engineer").alias("normalized_title"), default(j["role"], "Engineer").alias("normalized_role"), default_list(j["mandatory_skills"]).alias("mandatory_skills"), default_list(j["preferred_skills"]).alias("preferred_skills"),
        j["experience"]["min_months"].alias("min_months"), j["experience"]["max_months"].alias("max_months"), j["expected_start_date"].alias("expected_start_date"), j["requisition_duration_month"].alias("requisition_duration_month"),
    )


def job_skills(jobs_: DataFrame) -> DataFrame:
    """(request_id, kind, pos, raw_skill) of both lists."""
    part = lambda kind: jobs_.select("request_id", F.lit(kind).alias("kind"), F.posexplode(f"{kind}_skills").alias("pos", "raw_skill"))
    return part("mandatory").unionByName(part("preferred"))
