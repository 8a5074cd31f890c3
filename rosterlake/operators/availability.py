"""Requisition windows, overlapping allocations, and what capacity they leave.

The load of a window needs no pairs. Of a member's allocations, those that start
before the window's end but for those that end by its start overlap it; so with
running sums over the starts and over the ends, both sorted, a load is the
difference of two of these sums, each found by bisection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ScoringConfig
from ..functions.arrays import count_while

#: Windows beyond this number or these bytes are not broadcast; they meet the allocations by month instead.
BROADCAST_WINDOWS, BROADCAST_BYTES = 20_000, 8 << 20
#: Parts of a per cent that loads are counted in, so that sums are exact.
PARTS = 1_000_000


def window(start: Column, months: Column, config: ScoringConfig = DEFAULT) -> tuple[Column, Column]:
    """(start, end): a missing start is today, missing or no months the default; a month is a number of days."""
    today = F.current_date() if config.as_of is None else F.lit(config.as_of)
    first = F.coalesce(start, today)
    length = F.coalesce(F.nullif(months, F.lit(0)), F.lit(config.default_months))
    return first, F.date_add(first, (length * config.days_per_month).cast("int"))


def overlaps(start: Column, end: Column, from_: Column, to: Column) -> Column:
    """Whether intervals share a day; those that only touch don't, and a null end never does."""
    return (start < to) & (end > from_)


def _month(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c)


def overlapping(allocations: DataFrame, windows: DataFrame, most: int = BROADCAST_WINDOWS) -> DataFrame:
    """Rows of allocations that are not deleted, joined with each window (w_start, w_end, ...) that they overlap.

    These are pairs, for those who want them listed; loads come from `loads`.
    """
    live = allocations.filter(~F.col("is_deleted"))
    hit = overlaps(F.col("start_date"), F.col("end_date"), F.col("w_start"), F.col("w_end"))
    size = F.sum(sum((F.octet_length(F.to_json(F.struct(c))) for c in windows.columns), F.lit(64)))
    n, total = windows.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if n <= most and total <= BROADCAST_BYTES:
        return live.join(F.broadcast(windows), hit)
    # Both sides by month: a pair meets in each month that it shares, and the first of these counts.
    # Dates the wrong way round are spread like others; what overlaps is for hit alone to say.
    from_ = lambda a, b: _month(F.least(F.col(a), F.col(b)))
    spread = lambda a, b: F.explode(F.sequence(from_(a, b), _month(F.greatest(F.col(a), F.col(b)))))
    left = live.withColumn("month_", spread("start_date", "end_date"))
    right = windows.withColumn("month_", spread("w_start", "w_end"))
    first = F.greatest(from_("start_date", "end_date"), from_("w_start", "w_end"))
    return left.join(right, "month_").filter(hit & (F.col("month_") == first)).drop("month_")


def allocated(allocations: DataFrame, windows: DataFrame) -> DataFrame:
    """(team_member_id, w_start, w_end, allocated, n_allocations) where there is an overlap, summed over pairs; a null percentage is 0."""
    pairs = overlapping(allocations, windows.select("w_start", "w_end").distinct())
    percent = F.coalesce(F.col("allocation_percentage").cast("double"), F.lit(0.0))
    return pairs.groupBy("team_member_id", "w_start", "w_end").agg(F.sum(percent).alias("allocated"), F.count(F.lit(1)).alias("n_allocations"))


def loads(allocations: DataFrame) -> DataFrame:
    """(team_member_id, load): what any window's load can be read off from, one row a member.

    load.starts and load.ends hold (day, percent, n): the running sums of
    percentages (in millionths of a per cent) and of allocations up to each day.
    load.odd holds the allocations (start, end, percent, n) that end on or before
    the day they start, which two sums can't tell. Allocations of equal dates
    are summed before they are shuffled, so a member's arrays are as long as it
    has distinct days, however many allocations it has. A null percentage is 0;
    deleted allocations, and those without a start or end, never overlap.
    """
    percent = (F.coalesce(F.col("allocation_percentage"), F.lit(0)).cast("decimal(18,6)") * PARTS).cast("long")
    live = allocations.filter(~F.col("is_deleted") & F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    dates = live.groupBy("team_member_id", F.col("start_date").cast("date").alias("start"), F.col("end_date").cast("date").alias("end")).agg(F.sum(percent).alias("percent"), F.count(F.lit(1)).alias("n"))
    odd = F.col("start") >= F.col("end")
    entry = lambda kind, start, end: F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
    none = F.lit(None).cast("date")
    dates = dates.repartition("team_member_id")  # all that follows is of one member, and stays where it lies
    kinds = F.when(odd, F.array(entry(2, F.col("start"), F.col("end")))).otherwise(F.array(entry(0, F.col("start"), none), entry(1, none, F.col("end"))))
    days = dates.select("team_member_id", F.explode(kinds).alias("e"), "percent", "n").groupBy("team_member_id", "e").agg(F.sum("percent").alias("percent"), F.sum("n").alias("n"))
    # Days of one member only: as many as a calendar has.
    order = Window.partitionBy("team_member_id", "e.kind").orderBy(F.coalesce("e.start", "e.end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = days.withColumns({"upto": F.sum("percent").over(order), "n_upto": F.sum("n").over(order)})
    kind, day = F.col("e.kind"), F.coalesce("e.start", "e.end")

    def running(k: int) -> Column:
        return F.array_sort(F.collect_list(F.when(kind == k, F.struct(day.alias("day"), F.col("upto").alias("percent"), F.col("n_upto").alias("n")))))

    rest = F.collect_list(F.when(kind == 2, F.struct(F.col("e.start").alias("start"), F.col("e.end").alias("end"), "percent", "n")))
    return sums.groupBy("team_member_id").agg(F.struct(running(0).alias("starts"), running(1).alias("ends"), rest.alias("odd")).alias("load"))


def _upto(sums: Column, day: Column, and_day: bool) -> Column:
    """The running sum (percent, n) of all days before `day` (with and_day: and of it), by bisection; null if there are none."""
    return F.get(sums, count_while(sums, lambda x: x["day"] <= day if and_day else x["day"] < day) - 1)


def _read(load: Column, w_start: Column, w_end: Column, what: str) -> Column:
    value = lambda sums, day, and_day: F.coalesce(_upto(load[sums], day, and_day)[what], F.lit(0))
    some = F.aggregate(F.filter(load["odd"], lambda x: overlaps(x["start"], x["end"], w_start, w_end)), F.lit(0).cast("long"), lambda at, x: at + x[what])
    straight = value("starts", w_end, False) - value("ends", w_start, True)
    return F.when(w_start > w_end, None).when(load.isNull(), F.lit(0).cast("long")).otherwise(straight + some)


def load_of(load: Column, w_start: Column, w_end: Column) -> Column:
    """Per cent allocated in a window; null for a window that ends before it starts, which takes pairs (see `allocated`)."""
    return _read(load, w_start, w_end, "percent") / F.lit(float(PARTS))


def count_of(load: Column, w_start: Column, w_end: Column) -> Column:
    """Allocations that overlap a window; null like load_of."""
    return _read(load, w_start, w_end, "n")


def available_from(load: Column, w_start: Column, w_end: Column, config: ScoringConfig = DEFAULT) -> Column:
    """The first day of a window on which less than the threshold is allocated; null if there is none.

    A day is taken by the allocations that start on or before it and end after
    it. The load falls on days only on which something ends, so the window's
    start and these days are looked at. A member without a load is free from the
    start. A window that has no day has none that is free.
    """
    taken = lambda d: F.coalesce(_upto(load["starts"], d, True)["percent"], F.lit(0)) - F.coalesce(_upto(load["ends"], d, True)["percent"], F.lit(0))
    days = F.concat(F.array(w_start), F.transform(load["ends"], lambda e: e["day"]))
    free = F.filter(days, lambda d: (d >= w_start) & (d < w_end) & (taken(d) < F.lit(round(config.threshold * PARTS))))
    return F.when(load.isNull(), F.when(w_start < w_end, w_start)).otherwise(F.array_min(free))


def capacity(allocated_: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - allocated_)


def is_available(allocated_: Column, config: ScoringConfig = DEFAULT) -> Column:
    return allocated_ < config.threshold
