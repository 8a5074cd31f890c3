"""Waiting requests, taken and matched by any number of runs at a time, each once.

Requests, results and checkpoints are tables of one database. A run claims what
waits by a commit that sets its status to PROCESSING with the run's name and the
end of its lease; of two runs that claim at once the second one's commit fails,
and it reads again what is left. Results, final status and checkpoints are one
commit as well, so there is no request with one and without the others. A run
that dies leaves its claims to others once the lease is over, and if it comes
back after that, it writes nothing for a request that is no longer its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, ScoringConfig
from ..schemas import REQUISITION
from ..session import written
from ..sources import documents
from ..sources.commits import Conflict, Database, Layout
from . import matching

PROCESSING = 2
LAYOUTS = {
    "requests": Layout("request_id string, status int, client_name string, correlation_id string, received_at timestamp, payload_json string, payload_hash string, completed_at timestamp, owner string, leased_until timestamp", "request_id"),
    "results": Layout("request_id string, team_member_id string, rank int, final_score double, fit_level string, is_available boolean, explanation array<string>", "request_id"),
    "checkpoints": Layout("request_id string, node_name string, state_json string, token_count int", "request_id"),
    "rejected": Layout("request_id string, broken array<string>, line string", "coalesce(request_id, line)", 8),
}


def database(spark: SparkSession, path: str, buckets: int = 64) -> Database:
    """buckets: of each table of a new database."""
    return Database(spark, path, {name: replace(layout, buckets=buckets) for name, layout in LAYOUTS.items()})


def _commit(db: Database, change: Callable[[int], tuple[dict, dict] | None], tries: int = 20) -> int:
    """Commits what change(version) gives, again for each version that someone else puts in between; nothing if it gives None."""
    for _ in range(tries):
        base = db.version()
        made = change(base)
        if made is None:
            return base
        try:
            return db.commit(base, *made)
        except Conflict:
            continue
    raise Conflict(f"no commit in {tries} tries")


def submit(db: Database, payloads: DataFrame, at: str) -> int:
    """Registers payloads (as documents.read_requisitions gives them) whose id is new, in one commit with the reasons of those that break a rule or can't be read."""
    fixed = written(payloads, "payloads")
    lines = documents.unreadable(fixed)

    def change(base: int) -> tuple[dict, dict]:
        ids = documents.readable(fixed).select("request_id")
        touched = db.touched("requests", ids)
        old = db.read("requests", base, touched)
        rows, rejected, _ = matching.register(documents.readable(fixed), old, at)
        new = rows.withColumns({"completed_at": F.lit(None).cast("timestamp"), "owner": F.lit(None).cast("string"), "leased_until": F.lit(None).cast("timestamp")}).select(*old.columns)
        bad = rejected.select("request_id", "broken", F.lit(None).cast("string").alias("line")).unionByName(lines.select(F.lit(None).cast("string").alias("request_id"), F.array("unreadable").alias("broken"), "line"))
        in_bad = db.touched("rejected", bad)
        return {"requests": (old.unionByName(new), touched), "rejected": (db.read("rejected", base, in_bad).unionByName(bad).distinct(), in_bad)}, {"submitted": at}

    return _commit(db, change)


def claim(db: Database, owner: str, at: str, until: str, most: int | None = None) -> DataFrame:
    """The requests that are now this owner's: those that waited, or whose lease was over at the time `at`; at most so many, the oldest first."""
    now = F.lit(at).cast("timestamp")
    waits = (F.col("status") == matching.RECEIVED) | (F.col("status") == PROCESSING) & (F.col("leased_until") < now)

    def change(base: int) -> tuple[dict, dict] | None:
        free = db.read("requests", base).filter(waits).select("request_id", "received_at")
        free = written(free if most is None else free.orderBy("received_at", "request_id").limit(most), "claims")
        touched = db.touched("requests", free)
        if not touched:
            return None
        rows = db.read("requests", base, touched).join(free.select("request_id", F.lit(True).alias("free_")), "request_id", "left")
        mine = F.col("free_").isNotNull()
        out = rows.withColumns({"status": F.when(mine, PROCESSING).otherwise(F.col("status")), "owner": F.when(mine, F.lit(owner)).otherwise(F.col("owner")), "leased_until": F.when(mine, F.lit(until).cast("timestamp")).otherwise(F.col("leased_until"))})
        return {"requests": (out, touched)}, {"owner": owner}

    _commit(db, change)
    return db.read("requests").filter((F.col("status") == PROCESSING) & (F.col("owner") == owner) & (F.col("leased_until") == F.lit(until).cast("timestamp")))


def finish(db: Database, claimed: DataFrame, owner: str, skill_master: DataFrame, members: DataFrame, skills: DataFrame, allocations: DataFrame, at: str, config: ScoringConfig = DEFAULT) -> int:
    """Matches claimed requests and commits all their results, their status and checkpoints, but for those that are no longer this owner's."""
    waiting = written(claimed.withColumn("status", F.lit(matching.RECEIVED)), "claimed")
    found, after, checkpoints = matching.process_pending(waiting, skill_master, members, skills, allocations, at, config)
    results = found.select(*_columns(db, "results"))
    done = written(after.select("request_id", "status", "completed_at", "leased_until"), "done")
    log = written(checkpoints, "checkpoints")

    def change(base: int) -> tuple[dict, dict] | None:
        touched = db.touched("requests", done)
        if not touched:
            return None
        requests = db.read("requests", base, touched)
        new = done.select("request_id", F.col("status").alias("new_"), F.col("completed_at").alias("at_"), F.col("leased_until").alias("until_"))
        rows = requests.join(new, "request_id", "left")
        still = (F.col("status") == PROCESSING) & (F.col("owner") == owner) & F.col("leased_until").eqNullSafe(F.col("until_"))
        own = rows.filter(still).select("request_id")
        out = rows.withColumns({"status": F.when(still, F.col("new_")).otherwise(F.col("status")), "completed_at": F.when(still, F.col("at_")).otherwise(F.col("completed_at")), "leased_until": F.when(still, None).otherwise(F.col("leased_until"))})
        replaced = lambda name, rows: db.read(name, base, touched).join(own, "request_id", "left_anti").unionByName(rows.join(own, "request_id", "left_semi"))
        return {"requests": (out, touched), "results": (replaced("results", results), touched), "checkpoints": (replaced("checkpoints", log), touched)}, {"finished": owner}

    return _commit(db, change)


def retry(db: Database, at: str) -> int:
    """Requests that FAILED wait again, as if they had come at the time `at`; nothing is committed if there are none."""

    def change(base: int) -> tuple[dict, dict] | None:
        failed = db.read("requests", base).filter(F.col("status") == matching.FAILED)
        touched = db.touched("requests", failed)
        if not touched:
            return None
        rows, again = db.read("requests", base, touched), F.col("status") == matching.FAILED
        reset = {"status": F.when(again, matching.RECEIVED).otherwise(F.col("status")), "received_at": F.when(again, F.lit(at).cast("timestamp")).otherwise(F.col("received_at"))}
        reset |= {c: F.when(~again, F.col(c)) for c in ("completed_at", "owner", "leased_until")}
        return {"requests": (rows.withColumns(reset), touched)}, {"retried": at}

    return _commit(db, change)


def _columns(db: Database, name: str) -> list[str]:
    return db.spark.createDataFrame([], db.tables[name].schema).columns


def start(spark: SparkSession, source: str, path: str, checkpoint: str, owner: str, tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame, DataFrame]], at: str, until: str, once: bool = False) -> StreamingQuery:
    """A stream of requisition files: each micro-batch is registered, and what waits is claimed and matched.

    tables gives skill_master, members, skills and allocations as they are then.
    """
    db = database(spark, path)

    def run(batch: DataFrame, _: int) -> None:
        submit(db, documents.from_lines(batch, REQUISITION), at)
        claimed = claim(db, owner, at, until)
        if not claimed.isEmpty():
            finish(db, claimed, owner, *tables(), at)

    writer = spark.readStream.text(source).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
