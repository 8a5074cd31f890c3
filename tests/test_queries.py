"""Every query with SQL gives the rows that the SQL gives."""

import duckdb
import pytest

from rosterlake.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def canon(rows):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in ORACLES:
        assert rows
        return
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert canon(rows) == canon([tuple(r[i] for i in order) for r in found.fetchall()])
    assert rows or name in ("requisition_rejects",)


@pytest.mark.parametrize("name", ["matched_skill_lists", "explanation_lines", "strengths_gaps", "match_rank"])
def test_a_row_for_each_candidate(spark, sf_dir, name):
    key = ["request_id", "team_member_id"]
    every = QUERIES["final_score"](spark, sf_dir).select(*key)
    got = QUERIES[name](spark, sf_dir)
    assert got.count() == every.count() and got.select(*key).exceptAll(every).isEmpty()


def test_envelope_counts_every_candidate(spark, sf_dir):
    n = {r.request_id: r["count"] for r in QUERIES["final_score"](spark, sf_dir).groupBy("request_id").count().collect()}
    rows = QUERIES["match_envelope"](spark, sf_dir).collect()
    done = [r for r in rows if r.status == "COMPLETED"]
    assert 0 < len(done) < len(rows) and all(r.total_matches == n[r.request_id] > 50 for r in done)


def test_upserts_leave_no_row_out(spark, sf_dir):
    members = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    for name, n in (("upsert_members", members), ("upsert_allocations", orders), ("upsert_certifications", orders), ("upsert_skills", QUERIES["json_ingest"](spark, sf_dir).count())):
        rows = QUERIES[name](spark, sf_dir).groupBy("action").count().collect()
        assert {r.action for r in rows} == {"kept", "inserted", "updated"} and sum(r["count"] for r in rows) == n
