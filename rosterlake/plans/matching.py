"""From requisitions to ranked, explained matches, and their envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..functions.text import canonical_json, correlation_id, payload_hash
from ..operators import audit, explain, matching, normalize, rank, upsert
from ..operators.quality import REQUISITION_RULES, new_requests, split
from ..schemas import REQUISITION, REQUISITION_COLUMNS
from ..session import written
from ..sources import documents

#: Keys of schemas.STATUS_SEED.
RECEIVED, COMPLETED, FAILED = 1, 3, 4


def normalized_requisitions(requisitions: DataFrame, raw_skills: DataFrame, skill_master: DataFrame) -> DataFrame:
    """requisitions with arrays mandatory and preferred of canonical ids; without skills the lists are empty."""
    lists = normalize.skill_lists(normalize.normalize(raw_skills, skill_master))
    none = F.array().cast("array<string>")
    return requisitions.join(lists, "request_id", "left").withColumn("mandatory", F.coalesce("mandatory", none)).withColumn("preferred", F.coalesce("preferred", none))


def matches(requisitions: DataFrame, members: DataFrame, skills: DataFrame, allocations: DataFrame, config: ScoringConfig = DEFAULT, k: int | None = None) -> DataFrame:
    """Ranked matches with reasons and explanations; with k only the best k of each requisition."""
    scored = matching.with_reasons(matching.candidates(requisitions, members, skills, allocations, config))  # before the ranks, which move rows: what matched is shorter than all that a member has
    best = rank.ranked(scored, members=members) if k is None else rank.top_k(scored, k)
    return explain.lines(explain.summaries(explain.strengths_and_gaps(best)), config)


#: Matches on a page of an envelope.
PAGE = 50
#: Requests up to which a row for each is broadcast, so that pages are not shuffled to them.
MOST_REQUESTS = 100_000


def envelope(requests: DataFrame, results: DataFrame, page: int | None = None, size: int = PAGE) -> DataFrame:
    """(request_id, status, total_matches, page, matches): a request's results in pages of `size`, in the order of their rank.

    A row for each page (from 1), or with page for that one only; total_matches
    counts all results either way. A request without results yet, or without
    any on the page asked for, has one row without matches; PROCESSING says that
    there are no results. No row holds more than `size` matches. An explanation
    is in the entries if results have one.
    """
    of = F.ceil(F.col("rank") / F.lit(size)).cast("int")
    rows = results.withColumn("page", of) if page is None else results.filter(of == page).withColumn("page", of)
    entry = F.struct("rank", "team_member_id", F.col("final_score").alias("profile_score"), "fit_level", F.col("is_available").alias("availability_match"), *(c for c in ("explanation",) if c in results.columns))
    pages = rows.groupBy("request_id", "page").agg(F.array_sort(F.collect_list(entry)).alias("matches"))
    # Of all pages the totals are counted, so the results are ranked and moved once.
    totals = pages.groupBy("request_id").agg(F.sum(F.size("matches")).alias("n")) if page is None else results.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    heads = requests.select("request_id").join(totals, "request_id", "left")
    if page is None and requests.limit(MOST_REQUESTS + 1).count() <= MOST_REQUESTS:
        none = [F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in ("page", "matches")]
        joined = pages.join(F.broadcast(heads), "request_id").select("request_id", "n", "page", "matches").unionByName(heads.filter("n IS NULL").select("request_id", "n", *none))
    else:
        joined = heads.join(pages, "request_id", "left")
    return joined.select("request_id", F.when(F.col("n").isNull(), "PROCESSING").otherwise("COMPLETED").alias("status"), F.coalesce("n", F.lit(0)).alias("total_matches"), "page", "matches")


def envelope_totals(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """(request_id, status, total_matches, best): the envelope over all candidates without their list, by an aggregation."""
    first = F.min_by("team_member_id", F.struct(-F.col("final_score"), "team_member_id"))
    rows = scored.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), first.alias("best"))
    joined = requests.select("request_id").join(rows, "request_id", "left")
    return joined.select("request_id", F.when(F.col("n").isNull(), "PROCESSING").otherwise("COMPLETED").alias("status"), F.coalesce("n", F.lit(0)).alias("total_matches"), "best")


def register(payloads: DataFrame, requests: DataFrame, received_at) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new request rows with their detail, rejected rows with the rules they break, rows whose id is taken).

    payloads: rows of schemas.REQUISITION. Of payloads that share an id one is taken.
    """
    valid, rejected = split(payloads, REQUISITION_RULES)
    once = valid.groupBy("request_id").agg(F.min_by(F.struct(*[c for c in valid.columns if c != "request_id"]), canonical_json(F.struct(*valid.columns), valid.schema)).alias("p"))
    once = once.select("request_id", "p.*").select(*REQUISITION_COLUMNS)
    fresh = new_requests(once, requests)
    body = canonical_json(F.struct(*REQUISITION_COLUMNS), payloads.sparkSession.createDataFrame([], REQUISITION).schema)
    at = F.lit(received_at).cast("timestamp")
    rows = fresh.withColumn("payload_json", body).select(
        "request_id", F.lit(1).alias("status"), F.coalesce(F.nullif("client_name", F.lit("")), "job_description.client_name").alias("client_name"), correlation_id(F.col("request_id"), at).alias("correlation_id"), at.alias("received_at"), "payload_json", payload_hash(F.col("payload_json")).alias("payload_hash"), "job_description",
    )
    return rows, rejected, once.join(requests.select("request_id"), "request_id", "left_semi")


def process_pending(requests: DataFrame, skill_master: DataFrame, members: DataFrame, skills: DataFrame, allocations: DataFrame, at, config: ScoringConfig = DEFAULT, k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, requests with their new status, checkpoints) of all requests that were received and wait.

    All matches are given, for all are stored; a limit belongs to reading them
    (see page). Runs that share their requests take them by dispatch.claim.

    requests: rows as register gives them. A request whose payload is readable is
    matched and COMPLETED, any other FAILED; those of another status are left
    alone. What was matched belongs into store_results, the requests into their
    table, and the checkpoints are appended.
    """
    parsed = requests.filter(F.col("status") == RECEIVED).select("request_id", F.from_json("payload_json", REQUISITION).alias("p"))
    readable = F.col("p.job_description").isNotNull()
    payloads = parsed.filter(readable).select("request_id", *[F.col(f"p.{c}").alias(c) for c in REQUISITION_COLUMNS if c != "request_id"])
    jobs = documents.jobs(payloads)
    asked = normalized_requisitions(jobs, documents.job_skills(jobs), skill_master)
    found = written(matches(asked, members, skills, allocations, config, k), "matches")  # made once, for the results and their checkpoints
    changes = parsed.select("request_id", F.when(readable, COMPLETED).otherwise(FAILED).alias("new_status"), F.lit(at).cast("timestamp").alias("new_completed_at"))
    errors = parsed.select("request_id", F.when(~F.coalesce(readable, F.lit(False)), "payload is not readable").alias("error_message"))
    named = jobs.select("request_id", "normalized_title", "normalized_role")
    return found, upsert.update_status(requests, changes), audit.pipeline_checkpoints(named, asked, found, found, errors)


def run(payloads: DataFrame, skill_master: DataFrame, members: DataFrame, skills: DataFrame, allocations: DataFrame, config: ScoringConfig = DEFAULT, k: int | None = None) -> DataFrame:
    """Requisition payloads to explained matches: parse, normalize, match, rank, explain."""
    jobs = documents.jobs(payloads)
    return matches(normalized_requisitions(jobs, documents.job_skills(jobs), skill_master), members, skills, allocations, config, k)
