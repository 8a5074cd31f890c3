import json

import pytest
from pyspark.sql import functions as F

from rosterlake import schemas
from rosterlake.functions.text import canonical_json
from rosterlake.operators import audit, quality, upsert
from rosterlake.plans import ingest
from rosterlake.plans import matching as plan
from rosterlake.sources import documents, generate, tables
from rosterlake.streaming import upserts


def batch(spark, members, batch_id="B1"):
    value = json.dumps({"metadata": {"batch_id": batch_id}, "team_members": members, "extra": 1})
    return spark.createDataFrame([(value,)], "value string").select(F.from_json("value", schemas.BATCH).alias("b")).select("b.*")


def member(i, **more):
    return {"team_member_id": i, "team_member_status": "active", "experience_in_months": 10, "full_name": "n"} | more


def empty(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}


SKILLS = [{"skill_id": "S1", "skill_name": "One", "rating": 3, "category": "Lang", "certifications": [{"certification_id": "C1", "issuer": "i"}, {"issuer": "no id"}]}, {"skill_id": "S2", "skill_name": "Two"}, {"skill_id": "S1", "skill_name": "Other", "rating": 5}]


def test_bulk_upsert_inserts_updates_and_rejects(spark):
    first = batch(spark, [member("a", skills=SKILLS, allocations=[{"project_id": "p", "allocation_percentage": 12.5, "start_date": "2026-01-01"}], work_type="WFH"), member("bad", experience_in_months=-1), member("gone", team_member_status="left")])
    out = ingest.bulk_upsert(first, empty(spark))
    s = out["summary"].first()
    assert (s.members_received, s.members_inserted, s.skills_inserted, s.allocations_inserted, s.failed) == (3, 1, 2, 1, 2)
    a = out["team_member"].first()
    assert (a.team_member_id, a.work_type, a.is_active) == ("a", "wfh", True)
    assert {r.skill_id: r.rating for r in out["team_member_skill"].collect()} == {"S1": 5, "S2": None}
    assert {r.skill_id: (r.skill_name, r.category_id) for r in out["skill_master"].collect()} == {"S1": ("One", 2), "S2": ("Two", 1)}
    assert {r.category_name: r.category_id for r in out["category_master"].collect()} == {"General": 1, "Lang": 2}
    assert out["skill_certification"].count() == 2
    # The same batch over its own result updates, and changes nothing but the certification without an id.
    tables_ = {k: out[k].drop("action") for k in ("team_member", "team_member_skill", "team_member_allocation", "skill_certification", "skill_master", "category_master")}
    again = ingest.bulk_upsert(first, tables_)
    s = again["summary"].first()
    assert (s.members_inserted, s.members_updated, s.skills_updated, s.allocations_updated) == (0, 1, 2, 1)
    for k in ("team_member", "team_member_skill", "team_member_allocation"):
        assert sorted(map(str, again[k].drop("action").collect())) == sorted(map(str, tables_[k].collect()))
    assert again["skill_certification"].count() == 3
    assert again["skill_master"].count() == 2 and again["category_master"].count() == 2


def test_last_wins_and_merge_by_null_keys(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, None), ("k", 2, "b"), ("j", 1, "x")], "id string, pos int, v string")
    got = {r.id: (r.v, r.n_in_batch) for r in upsert.last_wins(rows, ["id"], ["pos"]).collect()}
    assert got == {"k": (None, 3), "j": ("x", 1)}
    old = spark.createDataFrame([("a", 1), (None, 2)], "id string, v int")
    new = spark.createDataFrame([("a", None), (None, 3)], "id string, v int")
    assert sorted(map(str, [tuple(r) for r in upsert.merge(old, new, ["id"], ["v"]).collect()])) == sorted(map(str, [("a", None, "updated"), (None, 2, "kept"), (None, 3, "inserted")]))


def test_status_delete_orphans(spark):
    req = spark.createDataFrame([("r1", 1, None), ("r2", 1, "t0")], "request_id string, status int, completed_at string")
    changes = spark.createDataFrame([("r2", 3, None), ("zz", 4, "t")], "request_id string, new_status int, new_completed_at string")
    assert {r.request_id: (r.status, r.completed_at) for r in upsert.update_status(req, changes).collect()} == {"r1": (1, None), "r2": (3, "t0")}
    rows = spark.createDataFrame([("TEST-1", '{"f": true}'), ("x", None), (None, "{}")], "id string, j string")
    assert upsert.delete_like(rows, "id", "TEST-%").count() == 2 and upsert.delete_flagged(rows, "j", "f", "true").count() == 2
    child = spark.createDataFrame([(1, 2), (1, None), (5, 5)], "a int, b int")
    assert [tuple(r) for r in quality.orphans(child, ["a", "b"], spark.createDataFrame([(1, 2)], "x int, y int"), ["x", "y"]).collect()] == [(5, 5)]


@pytest.mark.parametrize("value", [{"b": 1, "a": None, "c": ["x", "é\"\\\n", None]}, {"b": None, "a": "😀 \x7f", "c": []}])
def test_canonical_json(spark, value):
    schema = "struct<b: int, a: string, c: array<string>>"
    df = spark.createDataFrame([(value,)], f"p {schema}")
    assert df.select(canonical_json(F.col("p"), df.schema["p"].dataType)).first()[0] == json.dumps(value, sort_keys=True)


def payload(i, **job):
    return json.dumps({"request_id": i, "schema_version": "1", "source_system": "t", "job_description": {"client_name": "c", "title": "t", "priority": "LOW"} | job})


def test_register_and_run(spark):
    rows = [payload("r1", mandatory_skills=["a b"], experience={"min_months": 5}), payload("r1"), payload("taken"), payload("bad", experience={"min_months": 60, "max_months": 36}), payload("bad2", priority="NOW")]
    df = spark.createDataFrame([(r,) for r in rows], "value string").select(F.from_json("value", schemas.REQUISITION).alias("b")).select("b.*")
    new, rejected, taken = plan.register(df, spark.createDataFrame([("taken",)], "request_id string"), "2024-01-02 03:04:05")
    assert [r.request_id for r in new.collect()] == ["r1"] and new.first().correlation_id == "CORR-20240102030405-r1" and len(new.first().payload_hash) == 64
    assert {r.request_id: r.broken for r in rejected.collect()} == {"bad": ["experience"], "bad2": ["priority"]} and taken.count() == 1
    members = spark.createDataFrame([("m", True, 9)], "team_member_id string, is_active boolean, experience_in_months int")
    skills = spark.createDataFrame([("m", "AB", False)], "team_member_id string, skill_id string, is_deleted boolean")
    dictionary = spark.createDataFrame([("A B", "AB")], "skill_name string, skill_id string")
    got = plan.run(df.limit(1), dictionary, members, skills, spark.createDataFrame([], schemas.TABLES["team_member_allocation"]), k=5).first()
    assert (got.final_score, got.fit_level, got.skills_matched) == (1.0, "HIGH", ["AB"])
    done = plan.envelope(spark.createDataFrame([("r1",), ("r2",)], "request_id string"), plan.run(df.limit(1), dictionary, members, skills, spark.createDataFrame([], schemas.TABLES["team_member_allocation"])))
    assert {r.request_id: (r.status, r.total_matches) for r in done.collect()} == {"r1": ("COMPLETED", 1), "r2": ("PROCESSING", 0)}


def test_audit(spark):
    cp = spark.createDataFrame([(1, "r", "a", 500, 1), (2, "r", "b", 300, 2), (3, "r", "a", 800, 3), (4, "q", "a", None, 1)], "id int, request_id string, node_name string, token_count int, created_at int")
    assert {r.request_id: r.total_tokens for r in audit.token_totals(cp).collect()} == {"r": 1600, "q": 0}
    assert [r.id for r in audit.checkpoints_of(cp, "r").collect()] == [1, 2, 3]
    assert {(r.request_id, r.node_name): r.id for r in audit.latest(cp).collect()} == {("r", "a"): 3, ("r", "b"): 2, ("q", "a"): 4}


def test_versions_stream_and_ledger(spark, tmp_path):
    source, places = tmp_path / "in", [f"file://{tmp_path}/{x}" for x in ("database", "state")]
    source.mkdir()
    ingest.database(spark, places[0], 3).create()
    for n, (b, exp) in enumerate([("B1", 10), ("B2", 20), ("B1", 99)]):
        (source / f"{n}.json").write_text(json.dumps({"metadata": {"batch_id": b}, "team_members": [member("a", experience_in_months=exp), member(f"m{n}")]}) + "\n")
        upserts.start(spark, f"file://{source}", *places, "2024-01-01", once=True).awaitTermination()
    got = {r.team_member_id: r.experience_in_months for r in ingest.database(spark, places[0]).read("team_member").collect()}
    assert got == {"a": 20, "m0": 10, "m1": 10}
    tables.store_results(spark.createDataFrame([("r", 1), ("q", 1)], "request_id string, v int"), f"file://{tmp_path}/res")
    tables.store_results(spark.createDataFrame([("r", 2)], "request_id string, v int"), f"file://{tmp_path}/res")
    assert {(r.request_id, r.v) for r in spark.read.parquet(f"file://{tmp_path}/res").collect()} == {("r", 2), ("q", 1)}
    assert tables.probe(spark)


def test_generated(spark):
    members = generate.members(spark, 200)
    rows = members.collect()
    assert all(3 <= len(r.primary) <= 5 and 2 <= len(r.secondary) <= 4 and not set(r.primary) & set(r.secondary) and 24 <= r.experience_in_months <= 240 for r in rows)
    assert generate.members(spark, 200).collect() == rows
    per = [r["count"] for r in generate.allocations(members, "2024-06-01").groupBy("team_member_id").count().collect()]
    assert max(per) == 2 and len(per) < 200
    assert all(4 <= len(r.mandatory) + len(r.preferred) <= 8 for r in generate.requisitions(spark, 50, "2024-06-01").collect())


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text(payload("r1", mandatory_skills=["x", "y"], title="") + "\nnot json\n")
    jobs = documents.jobs(documents.read_requisitions(spark, f"file://{tmp_path}/r.json").filter("request_id IS NOT NULL"))
    assert (jobs.first().normalized_title, documents.job_skills(jobs).count()) == ("Software Engineer", 2)


def test_versions_of_buckets(spark, tmp_path):
    table = tables.VersionedTable(spark, f"file://{tmp_path}/t", "k", buckets=4, keep=1)
    assert table.read() is None
    rows = lambda n, v: spark.createDataFrame([(f"k{i}", v) for i in range(n)], "k string, v int")
    table.write(rows(40, 0))
    for v in range(1, 6):
        new = spark.createDataFrame([("k7", v)], "k string, v int")
        touched = table.touched(new)
        assert len(touched) == 1
        table.write(table.read(touched).filter("k <> 'k7'").unionByName(new), touched)
    got = {r.k: r.v for r in table.read().collect()}
    assert len(got) == 40 and got.pop("k7") == 5 and set(got.values()) == {0}
    assert sorted(n for n in table._names() if n.endswith("0") or n.endswith("5")) == ["v0", "v5"] and len(table._versions()) == 2
    (other,) = table.touched(spark.createDataFrame([("k8",)], "k string"))
    table.write(rows(0, 0), [other])
    assert 0 < table.read().count() < 40 and table.read([other]) is None
    other_writer = tables.VersionedTable(spark, f"file://{tmp_path}/t", "k", buckets=4)
    assert table._fs.createNewFile(table._at(f"v{max(table._versions()) + 1}.lock"))  # a writer that is at work
    other_writer.write(rows(40, 9))
    assert {r.v for r in table.read().collect()} == {9}


def test_results_are_cleared(spark, tmp_path):
    path = f"file://{tmp_path}/res"
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "request_id string")
    tables.clear_results(spark, path, ids("r1"))
    assert tables.read_results(spark, path) is None
    tables.store_results(spark.createDataFrame([(f"r{i}", 1) for i in range(200)], "request_id string, v int"), path)
    tables.store_results(spark.createDataFrame([("r5", 2), ("r5", 3)], "request_id string, v int"), path)
    tables.clear_results(spark, path, ids("r7", "r8", "unknown"))
    got = [(r.request_id, r.v) for r in tables.read_results(spark, path).collect()]
    assert sorted(got) == sorted([(f"r{i}", 1) for i in range(200) if i not in (5, 7, 8)] + [("r5", 2), ("r5", 3)])
    tables.clear_results(spark, path, ids(*(f"r{i}" for i in range(200))))
    assert tables.read_results(spark, path) is None or tables.read_results(spark, path).count() == 0
    tables.clear_results(spark, path)
    assert tables.read_results(spark, path) is None


def test_lookup_append_and_jdbc(spark, tmp_path):
    rows = spark.createDataFrame([(2, "a", 1), (1, "a", 2), (3, "b", 3)], "id int, c string, v int")
    tables.append(rows, f"file://{tmp_path}/log")
    tables.append(rows, f"file://{tmp_path}/log")
    log = spark.read.parquet(f"file://{tmp_path}/log")
    assert log.count() == 6 and tables.lookup(log, "c", "a").first().v == 2 and tables.lookup(log, "c", "zz").count() == 0
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        rows.write.format("jdbc").option("url", url).option("dbtable", "t").save()
    except Exception as e:
        pytest.skip(f"no JDBC driver here: {type(e).__name__}")
    for part in ({}, {"key": "id", "bounds": (1, 3), "parts": 2}):
        got = tables.read_jdbc(spark, url, "t", **part)
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in rows.collect())
    assert got.rdd.getNumPartitions() == 2


def test_guarded_delete(spark):
    rows = spark.range(300).select(F.concat(F.lit("TEST-"), F.col("id").cast("string")).alias("id"))
    some, many = upsert.delete_like(rows, "id", "TEST-1_"), upsert.delete_like(rows, "id", "TEST-%")
    left, n = upsert.guarded_delete(rows, some)
    assert (left.count(), n) == (300, 10)
    left, n = upsert.guarded_delete(rows, some, dry_run=False)
    assert (left.count(), n) == (290, 10)
    with pytest.raises(ValueError, match="300 rows"):
        upsert.guarded_delete(rows, many, dry_run=False)
    assert upsert.guarded_delete(rows, many, dry_run=False, confirmed=True)[0].count() == 0


def test_rules_within_members(spark):
    skills = [{"skill_id": "s1", "skill_name": "n", "rating": 99}, {"skill_id": "s2", "skill_name": "n", "rating": 10}, {"skill_id": None, "skill_name": "n"}, {"skill_id": "s4"}]
    allocations = [{"project_id": "p1", "allocation_percentage": 100.5}, {"project_id": "p2", "allocation_percentage": 1e9}, {"project_id": "p3"}, {"project_id": "p4", "allocation_percentage": 100}]
    batch = json.dumps({"metadata": {"batch_id": "B"}, "team_members": [member("a", skills=skills, allocations=allocations), member("b", experience_in_months=-1)]})
    df = spark.createDataFrame([(batch,)], "value string").select(F.from_json("value", schemas.BATCH).alias("b")).select("b.*")
    out = ingest.bulk_upsert(df, {name: spark.createDataFrame([], s) for name, s in schemas.TABLES.items()})
    assert {r.skill_id for r in out["team_member_skill"].collect()} == {"s2"}
    assert {str(r.skill_id): r.broken for r in out["rejected_skills"].collect()} == {"s1": ["rating"], "None": ["skill_id"], "s4": ["skill_name"]}
    assert {r.project_id for r in out["team_member_allocation"].collect()} == {"p3", "p4"} and {r.project_id for r in out["rejected_allocations"].collect()} == {"p1", "p2"}
    total = out["summary"].first()
    assert (total.members_received, total.failed, total.skills_failed, total.allocations_failed) == (2, 1, 3, 2)


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 4.0)]
    source = tmp_path / "ev"
    source.mkdir()
    (source / "1.json").write_text("".join(json.dumps({"ts": t, "event_type": e, "value": v}) + "\n" for t, e, v in rows))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").json(f"file://{source}")
    query = upserts.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((str(r.window_start), r.event_type, r.n, r.total) for r in spark.table("windows").collect()) == [("2024-01-01 00:00:00", "a", 2, 3.0), ("2024-01-01 01:00:00", "b", 1, 4.0)]


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_percentiles_are_exact(spark, ranges):
    values = [float(i * 37 % 101) for i in range(500)] + [50.0] * 3000
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("c", None), (None, 2.0), (None, 4.0)], "l string, v double")
    want = {r.l: (r.p, r.q) for r in rows.filter("v IS NOT NULL").groupBy("l").agg(F.percentile("v", 0.95).alias("p"), F.percentile("v", 0.99).alias("q")).collect()}
    got = {r.l: (r.p95, r.p99) for r in audit.percentiles(rows, "l", "v", ranges=ranges).collect()}
    assert got.keys() == want.keys()
    for k, (p, q) in want.items():
        assert got[k] == (pytest.approx(p), pytest.approx(q))
