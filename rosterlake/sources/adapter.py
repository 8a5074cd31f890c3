"""The domain's tables, derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import upper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def member_id(key: Column) -> Column:
    return F.concat(F.lit("TM"), F.lpad(key.cast("string"), 9, "0"))


def skill_id(name: Column) -> Column:
    return F.replace(upper(name), F.lit(" "), F.lit("_"))


def team_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.element_at(F.array(F.lit("wfo"), F.lit("wfh"), F.lit("hybrid")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(
        member_id(k).alias("team_member_id"), F.col("c_mktsegment").alias("designation"), (k % 10 != 0).alias("is_active"),
        F.when(k % 97 == 0, None).otherwise((k % 181).cast("int")).alias("experience_in_months"), F.col("c_name").alias("full_name"), kind.alias("work_type"), k.alias("custkey"),
    )


def _name(alias: str = "") -> Column:
    return F.col(f"{alias}p_name")


def skill_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first_part")).select(skill_id(_name()).alias("skill_id"), _name().alias("skill_name"), F.split("p_name", " ")[1].alias("category_name"), "first_part")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their member and skill: what the skills of members are made of. Ids are made before the joins, of rows that are fewer."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"), member_id(F.col("o_custkey")).alias("team_member_id"))
    parts = table(spark, sf_dir, "part").select("p_partkey", skill_id(_name()).alias("skill_id"), _name().alias("skill_name"))
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select("custkey", "team_member_id", "skill_id", "skill_name", "l_linenumber", "l_partkey", "l_orderkey", "l_extendedprice")


def team_member_skill(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """lines: order_lines, if they are at hand. They are dealt by member, so that what is counted of a member next stays where it lies."""
    lines = order_lines(spark, sf_dir) if lines is None else lines
    return lines.select("custkey", "team_member_id", "skill_id", "l_linenumber", "l_partkey").repartition("team_member_id").groupBy("custkey", "team_member_id", "skill_id").agg(F.max("l_linenumber").alias("rating"), (F.min("l_partkey") % 13 == 0).alias("is_deleted"))


def team_member_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        member_id(F.col("o_custkey")).alias("team_member_id"), F.concat(F.lit("PROJ"), o.cast("string")).alias("project_id"), ((o % 4 + 1) * 20).cast("decimal(5,2)").alias("allocation_percentage"),
        start.alias("start_date"), F.date_add(start, (90 + o % 451).cast("int")).alias("end_date"), (F.col("o_orderstatus") == "F").alias("billable"), (o % 11 == 0).alias("is_deleted"), o.alias("orderkey"), F.col("o_custkey").alias("custkey"),
    )


def requisition(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("REQ"), F.lpad(k.cast("string"), 4, "0")).alias("request_id"), F.date_add(F.lit("1996-01-01").cast("date"), (k * 60).cast("int")).alias("expected_start_date"),
        F.when(k % 5 == 0, None).otherwise((k % 9 + 2).cast("int")).alias("requisition_duration_month"), F.when(k % 4 == 0, None).otherwise((k * 3 + 24).cast("int")).alias("min_months"),
        F.when(k % 4 == 1, (k * 3 + 20).cast("int")).otherwise((k * 3 + 60).cast("int")).alias("max_months"), F.col("n_name").alias("title"), F.when(k % 6 == 0, "").otherwise(F.col("n_name")).alias("role"), k.alias("key"),
    )


def requisition_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, kind, pos, raw_skill): five or three parts of each nation's range, written in changing ways."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.when(F.col("n_nationkey") % 7 == 0, 2).otherwise(4))).alias("j"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = n.join(p, F.col("p_partkey") == F.col("n_nationkey") * 5 + F.col("j"))
    raw = F.when(F.col("j") == 1, F.upper("p_name")).when(F.col("j") == 3, F.concat(F.lit(" \t"), F.col("p_name"), F.lit(" "))).otherwise(F.col("p_name"))
    return rows.select(F.concat(F.lit("REQ"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("request_id"), F.when(F.col("p_partkey") % 5 < 3, "mandatory").otherwise("preferred").alias("kind"), F.col("j").alias("pos"), raw.alias("raw_skill"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("request_id"), F.col("event_type").alias("node_name"), F.col("props").alias("state_json"), F.when(F.col("event_id") % 9 != 0, F.floor("value").cast("int")).alias("token_count"), F.col("ts").alias("created_at"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request metrics: endpoint, duration, and whether it failed."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), F.col("value").alias("duration"), (F.col("event_id") % 20 == 0).alias("failed"), F.col("user_id"), F.col("ts"))


def status_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requisition(spark, sf_dir).select("request_id", F.lit(1).alias("status"), F.when(F.col("key") % 3 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("completed_at"))
