"""Idempotent upserts: a full outer join on the key, and a rewrite.

Of rows with the same key in one batch the last counts, by the order column;
nothing is ever deleted by an upsert. All of them are aggregations and joins on
the key, so a key that repeats very often is reduced before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir


def last_wins(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the one with the largest order (nulls first). Column n_in_batch counts the key's rows."""
    rest = [c for c in batch.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return batch.groupBy(*keys).agg(best.alias("best_"), F.count(F.lit(1)).alias("n_in_batch")).select(*keys, *[F.col(f"best_.{c}").alias(c) for c in rest], "n_in_batch")


def merge(old: DataFrame, new: DataFrame, keys: list[str], attributes: list[str], on_insert: list[str] | None = None, stamp: str | None = None) -> DataFrame:
    """old with new put over it: keys, attributes, on_insert columns, and action ('inserted', 'updated', 'kept', 'late').

    An update replaces all attributes, by nulls too; on_insert columns keep their
    old values. new must have each key once (see last_wins). Rows with a null in
    the key match nothing: old ones stay and new ones are inserted. stamp names a
    column of new, and perhaps of old, that says when a row was made: a new row
    whose stamp is below the old one's changes nothing ('late').
    """
    first = on_insert or []
    if stamp is not None:
        if stamp not in old.columns:
            old = old.withColumn(stamp, F.lit(None).cast(new.schema[stamp].dataType))
        attributes = [*attributes, stamp]
    left = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in attributes + first], F.lit(True).alias("was_"))
    right = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in attributes + first], F.lit(True).alias("is_"))
    both = left.join(right, keys, "full")
    late = F.lit(False) if stamp is None else F.coalesce(F.col(f"new_{stamp}") < F.col(f"old_{stamp}"), F.lit(False))
    value = [F.when(F.col("is_") & ~late, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in attributes]
    value += [F.when(F.col("was_"), F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c) for c in first]
    action = F.when(late, "late").when(F.col("was_") & F.col("is_"), "updated").when(F.col("is_"), "inserted").otherwise("kept")
    return both.select(*keys, *value, action.alias("action"))


def merge_certifications(old: DataFrame, new: DataFrame, stamp: str | None = None) -> DataFrame:
    """Certifications by certification_id, whoever holds them: an update leaves member and skill alone.

    Without an id (null or empty) a certification is always inserted. Updated
    attributes: certificate, issuer, issued_date, valid_till. stamp: as in merge.
    """
    if stamp is not None and stamp not in old.columns:
        old = old.withColumn(stamp, F.lit(None).cast(new.schema[stamp].dataType))
    attributes, who = ["certificate", "issuer", "issued_date", "valid_till"], ["team_member_id", "skill_id"]
    named = F.coalesce(F.col("certification_id"), F.lit("")) != ""
    columns = ["certification_id", *attributes, *who, *([stamp] if stamp else [])]
    merged = merge(old.filter(named), new.filter(named), ["certification_id"], attributes, who, stamp)
    others = old.filter(~named).select(*columns, F.lit("kept").alias("action")).unionByName(new.filter(~named).select(*columns, F.lit("inserted").alias("action")))
    return merged.unionByName(others)


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """rows with a column name: first, first + 1, ... in the order of the columns, without a gap, numbered by many tasks.

    The order columns must tell all rows apart. Rows are dealt into ranges of
    the order and sorted within these; a row's number is its place there plus
    the rows of all ranges before, whose sizes (a number for each task) the
    driver adds up. The ranges are fixed in a checkpoint, so a task that runs
    again gives the same numbers.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    shared_dir(rows.sparkSession)
    fixed = dealt.withColumn("part_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).checkpoint(eager=True)
    before, starts = first, []
    for part, n in sorted(tuple(r) for r in fixed.groupBy("part_").count().collect()):  # a row for each task
        starts.append((part, before))
        before += n
    of = rows.sparkSession.createDataFrame(starts, "part_ int, before_ long")
    return fixed.join(F.broadcast(of), "part_").withColumn(name, F.col("before_") + F.col("place_")).drop("part_", "place_", "before_")


def new_ids(names: DataFrame, existing: DataFrame, id_col: str, name_col: str, first: str) -> DataFrame:
    """(id, name) of names that existing lacks: the largest id + 1, + 2, ... in the order of column first, then the name.

    names may hold a name many times; what is numbered is the distinct new names.
    """
    top = existing.agg(F.coalesce(F.max(id_col).cast("int"), F.lit(0))).first()[0]
    fresh = names.filter(F.col(name_col).isNotNull()).groupBy(name_col).agg(F.min(first).alias("first_")).join(existing.select(name_col), name_col, "left_anti")
    return numbered(fresh, ["first_", name_col], "n_", top + 1).select(F.col("n_").cast("int").alias(id_col), name_col)


def add_skills(skill_master: DataFrame, batch: DataFrame, categories: DataFrame) -> DataFrame:
    """skill_master with the batch's unknown skills; known ones keep their name and category. No category means 1."""
    fresh = batch.groupBy("skill_id").agg(F.min_by("skill_name", "pos").alias("skill_name"), F.min_by("category_name", "pos").alias("category_name")).join(skill_master.select("skill_id"), "skill_id", "left_anti")
    named = fresh.join(categories.select("category_id", "category_name"), "category_name", "left")
    return skill_master.select("skill_id", "skill_name", "category_id").unionByName(named.select("skill_id", "skill_name", F.coalesce("category_id", F.lit(1)).cast("int").alias("category_id")))


def with_default_category(categories: DataFrame, spark) -> DataFrame:
    """categories with (1, 'General') if there is no id 1."""
    general = spark.createDataFrame([(1, "General")], "category_id int, category_name string")
    return categories.select(F.col("category_id").cast("int"), "category_name").unionByName(general.join(categories.select("category_id"), "category_id", "left_anti"))


def summary(merged: dict[str, DataFrame], received: DataFrame) -> DataFrame:
    """One row: members received, and rows inserted and updated of each merged table."""
    out = received.agg(F.count(F.lit(1)).alias("members_received"))
    for name, table in merged.items():
        counts = table.agg(F.count_if(F.col("action") == "inserted").alias(f"{name}_inserted"), F.count_if(F.col("action") == "updated").alias(f"{name}_updated"))
        out = out.join(F.broadcast(counts))
    return out


def update_status(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """requests with the status of changes (request_id, new_status, new_completed_at); a null time leaves the old one. Unknown ids do nothing."""
    out = requests.join(changes, "request_id", "left")
    return out.select(*[c for c in requests.columns if c not in ("status", "completed_at")], F.coalesce("new_status", "status").alias("status"), F.coalesce("new_completed_at", "completed_at").alias("completed_at"))


def delete_like(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """rows whose column is not like the pattern; a null stays."""
    return rows.filter(~F.coalesce(F.col(column).like(pattern), F.lit(False)))


def guarded_delete(rows: DataFrame, kept: DataFrame, dry_run: bool = True, confirmed: bool = False, limit: int = 100) -> tuple[DataFrame, int]:
    """(what is left, how many rows go), for kept as delete_like and delete_flagged give it.

    A dry run only counts and leaves everything. More rows than limit go only if
    that was confirmed.
    """
    gone = rows.count() - kept.count()
    if dry_run:
        return rows, gone
    if gone > limit and not confirmed:
        raise ValueError(f"{gone} rows would go, more than {limit}: confirm it")
    return kept, gone


def delete_flagged(rows: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """rows whose JSON column does not hold the value at the key."""
    return rows.filter(~F.coalesce(F.get_json_object(column, f"$.{key}") == value, F.lit(False)))
