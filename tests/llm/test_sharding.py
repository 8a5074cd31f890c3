import zlib

import pytest
from pyspark.sql import functions as F

from rosterlake.llm import sharding


def check(placed, rows, shards, spread):
    got = placed.toPandas()
    assert len(got) == len(rows)
    assert got.shard.between(0, shards - 1).all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = got.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    assert (sizes - sizes.mean()).abs().max() <= spread
    return got


def test_hot_text_is_subdivided_and_small_groups_stay_whole(spark):
    rows = [(i, "hot text " * 3) for i in range(3000)] + [(i, f"text {i // 3} " * (i % 7)) for i in range(3000, 9000)] + [(None, None), (None, None), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    total = sum(len(t or "") + 16 for _, t in rows)
    got = check(sharding.assign(df, 8, range_bytes=4096), rows, 8, 0.02 * total / 8 + 60)
    rest = got[(got.text.notna()) & ~got.text.str.startswith("hot", na=True) & (got.text != "")]
    assert (rest.groupby("text").shard.nunique() == 1).all()
    again = sharding.assign(df.repartition(3), 8, range_bytes=4096).toPandas()
    key = ["doc_id", "shard", "slot"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_only_a_group_too_large_for_a_shard_is_cut(spark):
    rows = [(i, "x") for i in range(30_000)] + [(30_000 + 3 * g + j, f"group {g}") for g in range(30_000) for j in range(3)] + [(200_000 + i, "a large group that fits " * 20) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    total = sum(len(t) + 16 for _, t in rows)
    got = check(sharding.assign(df, 10), rows, 10, 0.01 * total / 10)
    shards = got.groupby("text").shard.nunique()
    assert sum(len(t) + 16 for _, t in rows if t == "x") > total / 10 and shards["x"] > 1
    assert (shards.drop("x") == 1).all()


def test_pack():
    home, room = sharding.pack([(1, 60), (2, 60), (3, 60), (4, 30), (5, 200)], 4, 400)
    assert home[5] is None and len({home[k] for k in (1, 2, 3, 4)}) == 4 and sorted(room) == [40, 40, 40, 70]
    assert sharding.pack([], 3, 0) == ({}, [0, 0, 0])


def test_query_bytes_and_groups(spark, sf_dir):
    got = sharding.op2_sharding(spark, f"{sf_dir}/../sf0.01").toPandas()
    sizes = got.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert (sizes - sizes.mean()).abs().max() <= max(0.01 * sizes.mean(), got["size"].max())
    groups = got.groupby(["text_crc32", "size"])
    fits = groups["size"].sum() <= sizes.mean() / 4
    assert (groups.shard.nunique()[fits] == 1).all()


def test_clashing_names_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, "a", "x", 2), (2, None, "y", 3)], "doc_id long, text string, key_ string, shard int")
    got = sharding.assign(df, 40).toPandas()
    assert sorted(got.columns) == ["doc_id", "key_", "shard", "size", "slot", "text"]
    assert sorted(got["size"]) == [16, 17]
    assert sharding.assign(df.filter("false"), 40).count() == 0


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i if i % 5 else None, f"t{i // 2}" if i % 7 else None) for i in range(200)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, df.collect()))
    for shard in range(4):
        slots = [r.slot for r in back.filter(F.col("shard") == shard).collect()]
        assert sorted(slots) == list(range(len(slots)))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id").text
    got = sharding.op2_sharding(spark, sf_dir).toPandas()
    assert len(got) == len(docs)
    for r in got.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


@pytest.mark.parametrize("n", [1, 3])
def test_sample_is_weighted_by_size(spark, n):
    df = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") < 1000, 900).otherwise(100).cast("long").alias("s"), F.col("id").alias("t"))
    bounds = sharding.splitters(df, "k", "s", "t", 1_200_000, 4 * n)
    assert len(bounds) == 4 * n - 1 and bounds[len(bounds) // 2] < 1000
