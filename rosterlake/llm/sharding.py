"""Sharding by sampled splitters.

Rows are put in the order of a key, the hash of their text, so that equal texts
lie together, and that order is cut into shards of near equal bytes:

1. Key, size and a tie are taken from each row once and fixed in the shared
   folder; all that follows but the last step reads these narrow rows.
2. Groups of equal texts that fill over ``heavy`` of a shard are few (under
   shards / heavy of them). The largest first, each goes whole to the shard with
   the most room. One that fits in no shard's room is cut: its rows go on as if
   each were a group.
3. Of all other rows a size-weighted sample of keys is drawn: a row is taken with
   a chance in proportion to its size, decided by a hash of the row, so the
   sample is the same each time. Its quantiles are the boundaries of ranges, more
   and smaller than the shards.
4. An overfull range, one with a text that is cut, is subdivided: the rows of
   that text alone are dealt to its parts by a hash of their id. Groups that were
   placed whole are parted in the same way while they are numbered.
5. Records are range-partitioned; sums along the order of each range, put on the
   totals of the ranges before, give each group's place in bytes, and that place
   its shard: the shards' rooms are laid end to end.

What the driver holds is bounded: at most ``MOST_RANGES`` ranges, ``SAMPLE`` keys
and ``MOST_HEAVY`` groups, whatever the number of rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .common import checkpoint, table, temp_name

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
LAW = "bytes"
#: Bounds of what the driver holds and broadcasts.
MOST_RANGES, SAMPLE, MOST_HEAVY = 1 << 16, 1 << 20, 1 << 18


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (a null text has none) plus ROW_BYTES."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def splitters(rows: DataFrame, key: str, size: str, tie: str, total: int, ranges: int, per_range: int = 64) -> list[int]:
    """Boundaries of about equal bytes: quantiles of a size-weighted sample of about per_range keys a range (SAMPLE in all)."""
    wanted = min(per_range * ranges, SAMPLE)
    chance = F.pmod(F.xxhash64(F.lit(17), key, tie), F.lit(1 << 52)) / float(1 << 52)
    sample = rows.filter(chance < F.col(size) * (wanted / max(1, total))).select(key)
    keys = np.sort(sample.toArrow().column(0).to_numpy())  # about `wanted` of them
    if not len(keys):
        return []
    at = (np.arange(1, ranges) * len(keys)) // ranges
    return np.unique(keys[at]).tolist()


def _above(edges: list, value: Column, kind: str) -> Column:
    """How many of the sorted edges are not above the value."""
    edges_ = np.array(edges, np.int64 if kind == "long" else np.float64)

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges_, v.to_numpy(), "right").astype(np.int32))

    return place(value)


@dataclass
class Names:
    """Columns that are put beside those of the input, named so that none clashes."""

    key: str
    size: str
    tie: str
    id: str
    home: str
    own: str
    parts: str
    rng: str
    sub: str
    row: str
    end: str
    group: str
    mid: str
    before: str
    lift: str
    shard: str

    @classmethod
    def beside(cls, df: DataFrame) -> Names:
        return cls(**{name: temp_name(df, f"{name}_") for name in cls.__dataclass_fields__})


@dataclass
class Plan:
    """Where rows go: boundaries, the heavy groups' rows (key, shard or none, range or none, parts), rooms' ends, bytes before each part of a range, and the slots before."""

    bounds: list[int]
    heavy: list[tuple[int, int | None, int | None, int]]
    ends: list[float]
    starts: list[tuple[int, int, int]]
    lifts: list[tuple[int, int, int, int]]


def pack(groups: list[tuple[int, int]], shards: int, total: int) -> tuple[dict[int, int | None], list[float]]:
    """(key: shard, None where it fits in no room) for (key, bytes) groups, and the room that is left in each shard."""
    room = [(-total / shards, s) for s in range(shards)]
    home: dict[int, int | None] = {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        free, shard = room[0]
        home[key] = shard if size <= -free else None
        if home[key] is not None:
            heapq.heapreplace(room, (free + size, shard))
    return home, [-free for free, _ in sorted(room, key=lambda r: r[1])]


def _parted(rows: DataFrame, c: Names, plan: Plan) -> DataFrame:
    """rows with the range, its part, and the shard of groups that were placed whole."""
    known = rows.sparkSession.createDataFrame(plan.heavy, f"`{c.key}` long, `{c.home}` int, `{c.own}` int, `{c.parts}` int")
    out = rows.join(F.broadcast(known), c.key, "left")  # at most MOST_HEAVY rows
    out = out.withColumn(c.rng, F.coalesce(c.own, _above(plan.bounds, F.col(c.key), "long")))
    return out.withColumn(c.sub, F.pmod(F.col(c.tie), F.coalesce(c.parts, F.lit(1))).cast("int"))


def _placed(rows: DataFrame, c: Names, plan: Plan) -> DataFrame:
    """_parted rows with their row in their part and their shard."""
    by_row = Window.partitionBy(c.rng, c.sub).orderBy(c.key, c.tie, c.id)
    starts = rows.sparkSession.createDataFrame(plan.starts, f"`{c.rng}` int, `{c.sub}` int, `{c.before}` long")
    out = (
        rows.withColumn(c.row, F.row_number().over(by_row).cast("long") - 1)
        .withColumn(c.mid, F.sum(c.size).over(by_row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn(c.group, F.sum(c.size).over(Window.partitionBy(c.rng, c.sub, c.key)))
        .withColumn(c.end, F.max(c.mid).over(Window.partitionBy(c.rng, c.sub, c.key)))
        .join(F.broadcast(starts), [c.rng, c.sub], "left")  # a row for each part of a range
    )
    # A group stays together at its middle; the rows of one that is cut (it has parts, but no home) stand for themselves.
    at = F.when(F.col(c.parts).isNull(), F.col(c.end) - F.col(c.group) / 2).otherwise(F.col(c.mid) - F.col(c.size) / 2) + F.coalesce(c.before, F.lit(0))
    last = F.lit(len(plan.ends) - 1)
    return out.withColumn(c.shard, F.coalesce(c.home, F.least(last, _above(plan.ends[:-1], at.cast("double"), "double"))))


def _plan(rows: DataFrame, c: Names, shards: int, range_bytes: int, least_ranges: int, heavy: float) -> Plan:
    """rows: narrow and fixed."""
    total, n = rows.agg(F.coalesce(F.sum(c.size), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(least_ranges * shards, min(MOST_RANGES, -(-total // range_bytes)))
    limit = max(heavy, shards / MOST_HEAVY) * total / shards
    sums = rows.groupBy(c.key).agg(F.sum(c.size).alias("n"), F.count(F.lit(1)).alias("rows")).filter(F.col("n") > limit)
    found = [(r[c.key], r["n"], r["rows"]) for r in sums.collect()]  # under shards / heavy of them, MOST_HEAVY at most
    home, room = pack([(k, size) for k, size, _ in found], shards, total)
    most_bytes, most_rows = max(1, 2 * total / ranges), max(1, 2 * n / ranges)
    plan = Plan([], [], list(accumulate(room)), [], [])
    for i, (k, size, count) in enumerate(sorted(found)):
        parts = int(-(-max(size / most_bytes, count / most_rows) // 1))
        plan.heavy.append((k, home[k], None if home[k] is None else ranges + i, parts))
    whole = [k for k, shard, _, _ in plan.heavy if shard is not None]
    rest = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in whole], f"`{c.key}` long")), c.key, "left_anti") if whole else rows
    plan.bounds = splitters(rest, c.key, c.size, c.tie, int(sum(room)), ranges)

    own = checkpoint(_parted(rows, c, plan))
    sizes = own.filter(F.col(c.home).isNull()).groupBy(c.rng, c.sub).agg(F.sum(c.size).alias("n")).collect()  # one for each part of a range
    sizes = sorted((r[c.rng], r[c.sub], r["n"]) for r in sizes)
    plan.starts = [(r, p, before) for (r, p, _), before in zip(sizes, accumulate((x for _, _, x in sizes), initial=0), strict=False)]
    counts = _placed(own, c, plan).groupBy(c.rng, c.sub, c.shard).agg(F.count(F.lit(1)).alias("n"), F.min(c.row).alias("first")).collect()
    seen: dict[int, int] = {}
    for rng, sub, shard, rows_, first in sorted(tuple(r) for r in counts):
        plan.lifts.append((rng, sub, shard, seen.get(shard, 0) - first))
        seen[shard] = seen.get(shard, 0) + rows_
    return plan


def assign(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 64 << 20, least_ranges: int = 4, heavy: float = 0.005) -> DataFrame:
    """df with columns shard (0 to shards-1), slot (gapless from 0 in each shard) and size.

    Shards have near equal bytes: but for single records that are larger, each
    is within ``heavy`` of the mean. Equal texts are in one shard, unless all of
    them together fit in no shard beside the larger groups. A null text is no
    bytes and is put with the empty ones. Repeated ids, null ids and repeated
    rows are rows like others. Columns of df named like the three new ones are
    replaced, others kept. No rows give no rows; with few rows shards may be
    empty. df is read twice and must give the same rows each time.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ("shard", "slot", "size")])
    c = Names.beside(df)
    rows = df.withColumns({
        c.size: record_size(F.col(text_col)),
        c.key: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
        c.tie: F.xxhash64(F.lit(5), id_col),
        c.id: F.col(id_col),
    })
    plan = _plan(checkpoint(rows.select(c.key, c.size, c.tie, c.id)), c, shards, range_bytes, least_ranges, heavy)
    lifts = df.sparkSession.createDataFrame(plan.lifts, f"`{c.rng}` int, `{c.sub}` int, `{c.shard}` int, `{c.lift}` long")
    out = _placed(_parted(rows, c, plan), c, plan).join(F.broadcast(lifts), [c.rng, c.sub, c.shard])
    return out.select(*df.columns, F.col(c.shard).alias("shard"), (F.col(c.row) + F.col(c.lift)).alias("slot"), F.col(c.size).alias("size"))


def write_shards(df: DataFrame, path: str, shards: int, **options) -> None:
    """df's records as Parquet below path, a folder shard=n for each shard, in the order of the slots.

    What assign gives is fixed in the shared folder first, so that a task that
    runs again finds the same shards.
    """
    fixed = shared_path(df.sparkSession, "shards")
    assign(df, shards, **options).write.parquet(fixed)
    placed = df.sparkSession.read.parquet(fixed)
    placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents")
    keys = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = assign(keys, 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
