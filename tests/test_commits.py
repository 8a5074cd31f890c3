import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rosterlake import schemas
from rosterlake.config import ScoringConfig
from rosterlake.operators import availability, normalize, upsert
from rosterlake.plans import dispatch, ingest
from rosterlake.plans import matching as plan
from rosterlake.sources import documents
from rosterlake.sources.commits import Conflict, Database, Layout


def member(i, **more):
    return {"team_member_id": i, "team_member_status": "active", "experience_in_months": 10, "full_name": "n"} | more


def batch(number, batch_id, *members):
    return {"metadata": {"batch_id": batch_id, "batch_number": number}, "team_members": list(members)}


def lines(spark, *rows, schema=schemas.BATCH):
    return documents.from_lines(spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r),) for r in rows], "value string"), schema)


def test_database(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db", {"a": Layout("k string, v int", "k", 4), "b": Layout("x int")}, keep=2)
    rows = lambda *kv: spark.createDataFrame(list(kv), "k string, v int")
    assert db.version() == 0 and db.read("a").count() == 0
    assert db.commit(0, {"a": (rows(*((f"k{i}", 0) for i in range(20))), None), "b": (spark.createDataFrame([(1,)], "x int"), None)}, {"by": "me"}) == 1
    with pytest.raises(Conflict):
        db.commit(0, {"b": (spark.createDataFrame([(2,)], "x int"), None)})
    assert [r.x for r in db.read("b").collect()] == [1] and db.manifest()["note"] == {"by": "me"}
    new = rows(("k3", 7))
    only = db.touched("a", new)
    assert len(only) == 1 and db.commit(1, {"a": (db.read("a", only=only).filter("k <> 'k3'").unionByName(new), only)}) == 2
    assert {r.k: r.v for r in db.read("a").collect()} == {f"k{i}": 7 * (i == 3) for i in range(20)}
    assert {r.v for r in db.read("a", 1).collect()} == {0}
    assert db.rollback(1) == 3 and {r.v for r in db.read("a").collect()} == {0}
    assert db.versions() == [1, 2, 3] and db.commit(3, {"b": (spark.createDataFrame([], "x int"), None)}) == 4 and db.versions() == [3, 4]
    assert db.read("b").count() == 0 and db.read("a").count() == 20 and db.read("b", 3).count() == 1
    with pytest.raises(Exception, match="no space"):
        db.commit(4, {"a": (rows(), None), "b": (spark.range(1).select(F.raise_error(F.lit("no space")).cast("int").alias("x")), None)})
    assert db.version() == 4 and db.read("a").count() == 20
    assert db.vacuum() == [] and {p.split("/")[1] for p in db.vacuum(older_than=-60)} == {"a", "b"} and db.vacuum(older_than=-60) == []
    assert db.read("a").count() == 20 and db.read("b", 3).count() == 1


def test_batches_in_their_order(spark, tmp_path):
    db = ingest.database(spark, f"file://{tmp_path}/db", 3)
    skill = lambda n, **more: [{"skill_id": "S", "skill_name": f"name {n}", "rating": n, "category": f"c{n}", "certifications": [{"certification_id": "C", "issuer": f"i{n}"}]} | more]
    both = lines(spark, batch(9, "B9", member("x"), member("T", experience_in_months=9, skills=skill(9))), batch(10, "B10", member("T", experience_in_months=10, skills=skill(10), allocations=[{"project_id": "p", "allocation_percentage": 10}])), "{no", None, "", batch("x", "B11"))
    assert ingest.apply(db, both, "2024-01-01") == 1
    late = lines(spark, batch(8, "B8", member("T", experience_in_months=8, skills=skill(8), allocations=[{"project_id": "p", "allocation_percentage": 8}, {"project_id": "q", "allocation_percentage": 8}]), member("bad", experience_in_months=-1)))
    assert ingest.apply(db, late, "2024-01-02") == 2 and ingest.apply(db, late, "2024-01-03") == 2 and ingest.apply(db, both, "2024-01-04") == 2
    got = {r.team_member_id: (r.experience_in_months, r.batch.batch_id) for r in db.read("team_member").collect()}
    assert got == {"T": (10, "B10"), "x": (10, "B9")}
    assert [(r.rating, r.batch.batch_number) for r in db.read("team_member_skill").collect()] == [(10, 10)]
    assert {(r.project_id, float(r.allocation_percentage)) for r in db.read("team_member_allocation").collect()} == {("p", 10), ("q", 8)}
    assert [(r.issuer, r.batch.batch_id) for r in db.read("skill_certification").collect()] == [("i10", "B10")]
    assert [(r.skill_name, r.category_id) for r in db.read("skill_master").collect()] == [("name 9", 2)]
    log = {r.batch_id: (r.members_received, r.failed, r.members_inserted, r.members_updated, r.skills_inserted, r.allocations_inserted) for r in db.read("sync_logs").collect()}
    assert log == {"B9": (2, 0, 1, 0, 0, 0), "B10": (1, 0, 1, 0, 1, 1), "B8": (2, 1, 0, 0, 0, 1)}
    assert sorted(r.unreadable for r in db.read("failed_batches").collect()) == ["not_json", "wrong_type"]
    assert db.read("team_member", 1).count() == 2 and db.read("sync_logs", 1).count() == 2


def test_the_last_of_a_key_in_one_call(spark):
    none = {name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}
    out = ingest.bulk_upsert(lines(spark, batch(10, "B10", member("T", experience_in_months=10)), batch(9, "B9", member("x"), member("T", experience_in_months=9)), batch(None, "B99", member("T", experience_in_months=99)), "oops"), none)
    assert {r.team_member_id: r.experience_in_months for r in out["team_member"].collect()} == {"T": 10, "x": 10}
    assert [(r.unreadable, r.line) for r in out["unreadable"].collect()] == [("not_json", "oops")] and out["summary"].first().unreadable_batches == 1


def test_reasons(spark):
    rows = ['{"request_id": "a", "job_description": {"title": "t"}, "other": 1}', '{"request_id": "b", "job_description": {"requisition_duration_month": "six"}}', '{"request_id": "c"', "[]", "7", "   ", '{"request_id": "d", "job_description": {"expected_start_date": "soon"}}', "null"]
    got = lines(spark, *rows, schema=schemas.REQUISITION)
    assert sorted((r.request_id, r.unreadable, r.line) for r in got.collect() if r.request_id) == [("a", None, None)]
    assert {r.line: r.unreadable for r in documents.unreadable(got).collect()} == {rows[1]: "wrong_type", rows[2]: "not_json", rows[3]: "wrong_type", rows[4]: "wrong_type", rows[6]: "wrong_type", rows[7]: "wrong_type"}
    assert documents.readable(got).count() == 1 and documents.unreadable(documents.readable(got)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 500])
def test_numbered(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(50), f"n{i}") for i in range(n)]
    got = upsert.numbered(spark.createDataFrame(rows, "a int, b string").repartition(7), ["a", "b"], "no", 3)
    assert sorted((r.no, r.a, r.b) for r in got.collect()) == [(i + 3, *r) for i, r in enumerate(sorted(rows))]
    assert "Window" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_nearest_like_comparing_all(spark, edits):
    rng = random.Random(edits)
    make = lambda letters: sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(8))) for _ in range(120)})
    known = spark.createDataFrame([(x, f"ID{i}") for i, x in enumerate(make("abc "))], "skill_key string, skill_id string")
    names = spark.createDataFrame([(x,) for x in [*make("abcdé"), None]], "q string")
    got = {(r.q, r.skill_id, r.distance) for r in normalize.nearest(names, known, "q", edits).collect()}
    pairs = names.crossJoin(known).withColumn("d", F.levenshtein("q", "skill_key")).filter(F.col("d") <= edits)
    assert got == {(r.q, r.b.skill_id, r.b.d) for r in pairs.groupBy("q").agg(F.min(F.struct("d", "skill_id")).alias("b")).collect()} and got
    assert "NestedLoop" not in normalize.nearest(names, known, "q", edits)._jdf.queryExecution().toString()


def odd_allocations(rng, n, days=120):
    day = lambda: None if rng.random() < 0.05 else date(2026, 1, 1) + timedelta(rng.randrange(days))
    return [(f"m{rng.randrange(12)}", f"p{i}", rng.choice([None, 10.0, 33.33, 20.01, 60.0]), day(), day(), rng.random() < 0.2) for i in range(n)]


def test_loads_like_pairs(spark):
    rng = random.Random(4)
    rows = odd_allocations(rng, 300)
    allocations = spark.createDataFrame(rows, "team_member_id string, project_id string, allocation_percentage double, start_date date, end_date date, is_deleted boolean")
    windows = [(date(2026, 1, 1) + timedelta(a), date(2026, 1, 1) + timedelta(b)) for a, b in ((rng.randrange(-5, 125), rng.randrange(-5, 125)) for _ in range(80))] + [(date(2026, 2, 1),) * 2]
    asked = spark.createDataFrame(windows, "w_start date, w_end date")
    at = (F.col("load"), F.col("w_start"), F.col("w_end"))
    got = {(r[0], r[1], r[2]): (r[3], r[4]) for r in availability.loads(allocations).crossJoin(asked).select("team_member_id", "w_start", "w_end", availability.load_of(*at), availability.count_of(*at)).collect()}
    want = {(r[0], r[1], r[2]): (r[3], r[4]) for r in availability.allocated(allocations, asked).collect()}
    for (m, a, b), (percent, n) in got.items():
        if a > b:
            assert percent is None and n is None
        else:
            assert (pytest.approx(percent), n) == want.get((m, a, b), (0, 0))


def test_available_from_like_looking_at_each_day(spark):
    rng = random.Random(5)
    rows = odd_allocations(rng, 120, 60)
    allocations = spark.createDataFrame(rows, "team_member_id string, project_id string, allocation_percentage double, start_date date, end_date date, is_deleted boolean")
    windows = [(date(2026, 1, 1) + timedelta(a), date(2026, 1, 1) + timedelta(a + n)) for a, n in ((rng.randrange(-5, 60), rng.randrange(-3, 40)) for _ in range(60))]
    day = availability.available_from(F.col("load"), F.col("w_start"), F.col("w_end"), ScoringConfig(threshold=75))
    members = spark.createDataFrame([("free",), *((f"m{i}",) for i in range(12))], "team_member_id string").join(availability.loads(allocations), "team_member_id", "left")
    got = members.crossJoin(spark.createDataFrame(windows, "w_start date, w_end date")).select("team_member_id", "w_start", "w_end", day).collect()
    for m, a, b, found in got:
        free = (d for d in (a + timedelta(i) for i in range((b - a).days)) if sum(p or 0 for k, _, p, s, e, gone in rows if k == m and not gone and s and e and s <= d < e) < 75 - 1e-9)
        assert found == next(free, None)


def requisition(i, **job):
    return {"request_id": i, "schema_version": "1", "source_system": "t", "job_description": {"client_name": "c", "title": "t", "priority": "LOW"} | job}


def test_claims(spark, tmp_path):
    db = dispatch.database(spark, f"file://{tmp_path}/db", 3)
    sent = lines(spark, requisition("r1", mandatory_skills=["a b"]), requisition("r2"), requisition("r2"), requisition("bad", priority="NOW"), "{", schema=schemas.REQUISITION)
    dispatch.submit(db, sent, "2024-01-01 00:00:00")
    dispatch.submit(db, sent, "2024-01-01 00:00:30")
    assert db.read("requests").count() == 2 and sorted(r.broken[0] for r in db.read("rejected").collect()) == ["not_json", "priority"]
    other = dispatch.database(spark, f"file://{tmp_path}/db", 3)
    base = db.version()
    commit = Database.commit

    def late(self, version, *rest):  # someone else claims between this run's reading and its commit
        Database.commit = commit
        assert dispatch.claim(other, "two", "2024-01-01 00:01:00", "2024-01-01 00:11:00", most=1).count() == 1
        return commit(self, version, *rest)

    Database.commit = late
    try:
        mine = dispatch.claim(db, "one", "2024-01-01 00:01:00", "2024-01-01 00:10:00")
    finally:
        Database.commit = commit
    assert db.version() == base + 2 and [r.request_id for r in mine.collect()] == ["r2"]
    members = spark.createDataFrame([("m", True, 9), ("n", True, 1)], "team_member_id string, is_active boolean, experience_in_months int")
    skills = spark.createDataFrame([("m", "AB", False)], "team_member_id string, skill_id string, is_deleted boolean")
    rest = (spark.createDataFrame([("A B", "AB")], "skill_name string, skill_id string"), members, skills, spark.createDataFrame([], schemas.TABLES["team_member_allocation"]))
    dispatch.finish(db, mine, "one", *rest, "2024-01-01 00:02:00")
    dispatch.finish(db, mine, "one", *rest, "2024-01-01 00:03:00")
    over = dispatch.claim(db, "three", "2024-01-01 01:00:00", "2024-01-01 01:10:00")
    assert [r.request_id for r in over.collect()] == ["r1"]
    dispatch.finish(db, over, "three", *rest, "2024-01-01 01:01:00")
    assert {(r.request_id, r.status, r.owner, str(r.completed_at)) for r in db.read("requests").collect()} == {("r1", 3, "three", "2024-01-01 01:01:00"), ("r2", 3, "one", "2024-01-01 00:02:00")}
    assert sorted((r.request_id, r.team_member_id, r.rank) for r in db.read("results").collect()) == [("r1", "m", 1), ("r1", "n", 2), ("r2", "m", 1), ("r2", "n", 2)]
    assert db.read("checkpoints").groupBy("request_id").count().filter("count = 5").count() == 2


def test_failed_requests_wait_again(spark, tmp_path):
    db = dispatch.database(spark, f"file://{tmp_path}/db", 3)
    dispatch.submit(db, lines(spark, requisition("r1"), requisition("r2"), schema=schemas.REQUISITION), "2024-01-01 00:00:00")
    rows = db.read("requests").withColumn("payload_json", F.when(F.col("request_id") == "r1", "{").otherwise(F.col("payload_json")))
    db.commit(db.version(), {"requests": (rows, None)})
    members = spark.createDataFrame([("m", True, 9)], "team_member_id string, is_active boolean, experience_in_months int")
    rest = (spark.createDataFrame([], "skill_name string, skill_id string"), members, spark.createDataFrame([], "team_member_id string, skill_id string, is_deleted boolean"), spark.createDataFrame([], schemas.TABLES["team_member_allocation"]))
    dispatch.finish(db, dispatch.claim(db, "one", "2024-01-01 00:01:00", "2024-01-01 00:10:00"), "one", *rest, "2024-01-01 00:02:00")
    state = lambda: {r.request_id: (r.status, r.owner, str(r.received_at)) for r in db.read("requests").collect()}
    assert state() == {"r1": (4, "one", "2024-01-01 00:00:00"), "r2": (3, "one", "2024-01-01 00:00:00")}
    dispatch.retry(db, "2024-01-02 00:00:00")
    assert state() == {"r1": (1, None, "2024-01-02 00:00:00"), "r2": (3, "one", "2024-01-01 00:00:00")}
    version = db.version()
    dispatch.claim(db, "two", "2024-01-02 00:01:00", "2024-01-02 00:10:00")
    assert dispatch.retry(db, "2024-01-03 00:00:00") == version + 1


def test_a_stream_of_requests(spark, tmp_path):
    source, places = tmp_path / "in", [f"file://{tmp_path}/{x}" for x in ("db", "state")]
    source.mkdir()
    dispatch.database(spark, places[0], 3).create()
    members = spark.createDataFrame([("m", True, 9)], "team_member_id string, is_active boolean, experience_in_months int")
    tables = lambda: (spark.createDataFrame([], "skill_name string, skill_id string"), members, spark.createDataFrame([], "team_member_id string, skill_id string, is_deleted boolean"), spark.createDataFrame([], schemas.TABLES["team_member_allocation"]))
    for n in range(2):
        (source / f"{n}.json").write_text("\n".join(json.dumps(requisition(f"r{i}")) for i in range(n + 1)) + "\n{oops\n")
        dispatch.start(spark, f"file://{source}", *places, "me", tables, "2024-01-01 00:00:00", "2024-01-01 01:00:00", once=True).awaitTermination()
    db = dispatch.database(spark, places[0])
    assert {(r.request_id, r.status) for r in db.read("requests").collect()} == {("r0", 3), ("r1", 3)} and db.read("results").count() == 2 and db.read("rejected").count() == 1


def test_pages(spark):
    results = spark.createDataFrame([("r", f"m{i}", i, 0.5, "LOW", True, ["x"]) for i in range(1, 8)], "request_id string, team_member_id string, rank int, final_score double, fit_level string, is_available boolean, explanation array<string>")
    asked = spark.createDataFrame([("r",), ("q",)], "request_id string")
    got = {(r.request_id, r.page): (r.status, r.total_matches, [m.rank for m in r.matches or []]) for r in plan.envelope(asked, results, size=3).collect()}
    assert got == {("r", 1): ("COMPLETED", 7, [1, 2, 3]), ("r", 2): ("COMPLETED", 7, [4, 5, 6]), ("r", 3): ("COMPLETED", 7, [7]), ("q", None): ("PROCESSING", 0, [])}
    got = {(r.request_id, r.page): (r.status, r.total_matches, [m.rank for m in r.matches or []]) for r in plan.envelope(asked, results, page=3, size=3).collect()}
    assert got == {("r", 3): ("COMPLETED", 7, [7]), ("q", None): ("PROCESSING", 0, [])}
