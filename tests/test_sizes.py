"""What is shuffled and written is kept small."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rosterlake import session
from rosterlake.operators import top
from rosterlake.plans import ingest
from rosterlake.plans import matching as plan
from rosterlake.sources import adapter, documents
from rosterlake.sources.commits import Database, Layout


def test_pairs_of_an_index_are_not_shuffled(spark):
    profiles = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"]), ("c", None), ("d", ["z"])], "team_member_id string, skill_ids array<string>")
    lists = spark.createDataFrame([("r1", "x"), ("r1", "y"), ("r2", "y")], "request_id string, skill_id string")
    pairs = top._on_lists(profiles, lists)
    assert sorted((r.request_id, r.team_member_id) for r in pairs.collect()) == [("r1", "a"), ("r1", "b"), ("r2", "a"), ("r2", "b")]
    assert "team_member_id" not in "".join(line for line in pairs._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in line)


def test_long_rows_are_written_in_small_pages(spark):
    rows = spark.range(60).repartition(1).select(F.concat(F.col("id").cast("string"), F.expr("repeat(uuid(), 3000)")).alias("line"))
    kept = session.written(rows, "long")
    assert kept.count() == 60
    (name,) = {n.removeprefix("file://") for n in kept.inputFiles()}
    assert ".zstd." in name  # a codec without a buffer of a whole page


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db", {"a": Layout("k string, v long", "k", 2)})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        db.commit(0, {"a": (spark.range(500).select(F.lit("one").alias("k"), F.col("id").alias("v")), None)})
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(glob.glob(f"{tmp_path}/db/data/a/*/bucket_*=*/*.parquet")) > 1
    assert sorted(r.v for r in db.read("a").collect()) == list(range(500))


def test_batches_are_not_shuffled_to_find_the_new_ones(spark):
    batch = spark.createDataFrame([("B1", None), ("B2", None), (None, None)], "id string, unreadable string").select(F.struct(F.col("id").alias("batch_id")).alias("metadata"), "unreadable")
    ids = batch.select(F.col("metadata.batch_id").alias("batch_id"))
    for logged, left in (([], 3), (["B2"], 2)):
        fresh = ingest._fresh(batch, ids, spark.createDataFrame([(x,) for x in logged], "batch_id string"))
        assert "Exchange hash" not in fresh._jdf.queryExecution().executedPlan().toString()
        assert fresh.count() == left


def test_failed_lines_once(spark):
    bad = spark.createDataFrame([("not_json", "{a", 1), ("not_json", "{a", 2), ("not_json", "{b", 3)], "unreadable string, line string, row_ long")
    new = ingest._new_lines(bad, spark.createDataFrame([("{b",)], "line string"))
    assert [r.line for r in new.collect()] == ["{a"]


def groups(*patterns):
    """(rows, bytes unpacked) of the largest row groups of some files."""
    found = [g for p in patterns for f in glob.glob(p, recursive=True) for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(i) for i in range(m.num_row_groups))]
    return max(g.num_rows for g in found), max(g.total_byte_size for g in found)


def test_long_lines_are_read_few_at_a_time(spark, tmp_path):
    db = ingest.database(spark, f"file://{tmp_path}/db", 1)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.sha2(F.concat_ws("/", "id", i), 256)), "")
    rows = spark.range(160).repartition(1).select(F.struct(F.lit("B").alias("batch_id"), F.lit(1).alias("batch_number")).alias("metadata"), F.lit("not_json").alias("unreadable"), text.alias("line"), F.lit(None).cast(documents.schemas.BATCH.split("team_members ")[1]).alias("team_members"))
    assert ingest.apply(db, rows, "2024-01-01") == 1 and db.read("failed_batches").distinct().count() == 160
    assert groups(f"{tmp_path}/db/data/failed_batches/**/*.parquet")[1] < 4 << 20
    kept = ingest._entries(rows)
    assert kept.count() == 160 and groups(*[f.removeprefix("file://") for f in kept.inputFiles()])[1] < 4 << 20


def test_batches_are_kept_a_row_a_member(spark, tmp_path):
    one = lambda i: f'{{"team_member_id": "{i}", "team_member_status": "active", "experience_in_months": 1, "full_name": "n", "skills": [{{"skill_id": "S", "skill_name": "s"}}]}}'
    of = lambda b, members: f'{{"metadata": {{"batch_id": "{b}", "batch_number": 1}}, "team_members": {members}}}'
    many = [one(i) for i in range(3000)]
    texts = [of("A", f"[{', '.join(many)}]"), of("B", "[]"), of("C", "null"), of("D", f"[null, {one('x')}]"), "{no"]
    batch = documents.from_lines(spark.createDataFrame([(t,) for t in texts], "value string"), documents.schemas.BATCH)
    kept = ingest._entries(batch)
    assert groups(*[f.removeprefix("file://") for f in kept.inputFiles()])[0] <= 1024
    assert sorted(r.metadata.batch_id for r in documents.heads(kept).collect()) == ["A", "B", "C", "D"]
    by = lambda df: sorted((r.batch_id, r.pos, r.team_member_id) for r in df.collect())
    assert by(documents.entry_members(kept)) == by(documents.members(documents.readable(batch))) and kept.count() == 3005
    db = ingest.database(spark, f"file://{tmp_path}/db", 1)
    ingest.apply(db, batch, "2024-01-01")
    assert {r.batch_id: (r.members_received, r.failed, r.members_inserted, r.skills_inserted) for r in db.read("sync_logs").collect()} == {"A": (3000, 0, 3000, 3000), "B": (0, 0, 0, 0), "C": (0, 0, 0, 0), "D": (2, 1, 1, 1)}


def test_lines_of_batches_are_no_column_of_a_table(spark, sf_dir):
    """A text is read a line at a time."""
    from rosterlake import queries

    for name in ("bulk_commit_rollback", "unreadable_batches"):
        before = set(glob.glob(f"{session.shared_dir(spark).removeprefix('file://')}/*"))
        assert queries.QUERIES[name](spark, sf_dir).count()
        new = set(glob.glob(f"{session.shared_dir(spark).removeprefix('file://')}/*")) - before
        assert not [f for d in new for f in glob.glob(f"{d}/*.parquet") if "value" in pq.ParquetFile(f).schema_arrow.names]


def test_pages_are_not_shuffled_to_their_requests(spark):
    rows = [("a", r, f"m{r}", 1 - r / 100, "HIGH", True) for r in range(1, 8)]
    results = spark.createDataFrame(rows, "request_id string, rank int, team_member_id string, final_score double, fit_level string, is_available boolean")
    requests = spark.createDataFrame([("a",), ("none",)], "request_id string")
    for found in (results, results.withColumn("explanation", F.array(F.lit("x")))):
        pages = plan.envelope(requests, found, size=3)
        assert "strategy=broadcast" in pages._jdf.queryExecution().analyzed().toString()
        got = sorted(((r.request_id, r.status, r.total_matches, r.page or 0, [m.rank for m in r.matches or []]) for r in pages.collect()))
        assert got == [("a", "COMPLETED", 7, 1, [1, 2, 3]), ("a", "COMPLETED", 7, 2, [4, 5, 6]), ("a", "COMPLETED", 7, 3, [7]), ("none", "PROCESSING", 0, 0, [])]
        assert ("explanation" in pages.schema["matches"].dataType.elementType.names) == ("explanation" in found.columns)


def test_skills_of_a_member_are_shuffled_once(spark, sf_dir):
    have = adapter.team_member_skill(spark, sf_dir).groupBy("team_member_id").agg(F.count("skill_id").alias("n"))
    exchanges = [line for line in have._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in line and "team_member_id" in line]
    assert len(exchanges) == 1 and have.count()
