"""Checkpoints, token totals and request metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpoints_of(checkpoints: DataFrame, request_id: str) -> DataFrame:
    """A request's checkpoints in the order of their creation."""
    return checkpoints.filter(F.col("request_id") == request_id).orderBy("created_at", "id")


def latest(checkpoints: DataFrame) -> DataFrame:
    """The last checkpoint of each request and node."""
    rest = [c for c in checkpoints.columns if c not in ("request_id", "node_name")]
    best = F.max_by(F.struct(*rest), F.struct("created_at", "id"))
    return checkpoints.groupBy("request_id", "node_name").agg(best.alias("b")).select("request_id", "node_name", *[F.col(f"b.{c}").alias(c) for c in rest])


def token_totals(checkpoints: DataFrame) -> DataFrame:
    """(request_id, total_tokens); null counts are 0."""
    return checkpoints.groupBy("request_id").agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"))


def node_presence(checkpoints: DataFrame, node: str) -> DataFrame:
    return checkpoints.groupBy("request_id").agg(F.bool_or(F.col("node_name") == node).alias("has_node"))


def counters(requests: DataFrame, labels: list[str]) -> DataFrame:
    return requests.groupBy(*labels).agg(F.count(F.lit(1)).alias("n_requests"))


#: Upper ends of the buckets of durations.
BUCKETS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)


def histogram(requests: DataFrame, label: str, value: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(label, le, n): rows with a value of at most le; le is null for the bucket of all. One pass, one row a task and label."""
    counts = requests.groupBy(label).agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(value).alias("all_"))
    pairs = [F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("all_").alias("n")))
    return counts.select(label, F.explode(F.array(*pairs)).alias("p")).select(label, "p.le", "p.n")


def percentiles(requests: DataFrame, label: str, value: str, accuracy: int | None = None, ranges: int = 256) -> DataFrame:
    """(label, p95, p99): exact, or with an accuracy approximate in bounded memory. Null values don't count.

    Exact ones are read off counts: equal values of a label are counted before
    anything else, the distinct values are cut into ranges at approximate
    quantiles, and running sums within ranges stand on the totals of the ranges
    before. So a label with a third of all rows is sorted by many tasks. Between
    two neighbours a percentile is interpolated.
    """
    shares = {"p95": 0.95, "p99": 0.99}
    if accuracy is not None:
        return requests.groupBy(label).agg(*[F.percentile_approx(value, q, accuracy).cast("double").alias(name) for name, q in shares.items()])
    counts = requests.filter(F.col(value).isNotNull()).groupBy(label, F.col(value).alias("v_")).agg(F.count(F.lit(1)).alias("n_"))
    edges = counts.groupBy(label).agg(F.percentile_approx("v_", [i / ranges for i in range(1, ranges)], 4 * ranges).alias("edges_"), F.sum("n_").alias("all_"))
    keyed = edges.select(F.col(label).alias("label_"), "edges_", "all_")  # one row a label
    rows = counts.join(keyed, F.col(label).eqNullSafe(F.col("label_"))).withColumn("range_", F.size(F.filter("edges_", lambda e: e < F.col("v_")))).drop("edges_", "label_")
    totals = rows.groupBy(F.col(label).alias("label_"), F.col("range_").alias("r_")).agg(F.sum("n_").alias("in_range_"))
    earlier = F.sum("in_range_").over(Window.partitionBy("label_").orderBy("r_").rowsBetween(Window.unboundedPreceding, -1))  # at most `ranges` rows a label
    totals = totals.withColumn("before_", F.coalesce(earlier, F.lit(0))).drop("in_range_")
    upto = F.sum("n_").over(Window.partitionBy(label, "range_").orderBy("v_").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("upto_", upto).join(totals, F.col(label).eqNullSafe(F.col("label_")) & (F.col("range_") == F.col("r_")))
    reached = F.col("upto_") + F.col("before_")
    found = []
    for name, q in shares.items():
        place = F.lit(q) * (F.col("all_") - 1)
        found += [F.min(F.when(reached > at(place), F.col("v_"))).alias(f"{name}_{end}_") for end, at in (("lo", F.floor), ("hi", F.ceil))]
    out = rows.groupBy(label, "all_").agg(*found)
    for name, q in shares.items():
        place = F.lit(q) * (F.col("all_") - 1)
        out = out.withColumn(name, F.col(f"{name}_lo_") + (place - F.floor(place)) * (F.col(f"{name}_hi_") - F.col(f"{name}_lo_")))
    return out.select(label, *shares)


def error_rate(requests: DataFrame, label: str, error: str) -> DataFrame:
    return requests.groupBy(label).agg(F.avg(F.col(error).cast("int")).alias("error_rate"))


def gauge(samples: DataFrame, label: str, value: str, at: str) -> DataFrame:
    """(label, value): the last sample of each label."""
    return samples.groupBy(label).agg(F.max_by(value, at).alias(value))


def exposition(counts: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    """One text line a row, as scrapers read it."""
    return counts.select(F.concat(F.lit(f'{metric}{{{label}="'), F.col(label), F.lit('"} '), F.col(value).cast("string")).alias("line"))


def first_error(*messages: Column) -> Column:
    """The first message that is neither null nor empty: no later stage overwrites the error of an earlier one."""
    return F.coalesce(*[F.nullif(m, F.lit("")) for m in messages])


def pipeline_checkpoints(parsed: DataFrame, normalized: DataFrame, scored: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """(request_id, node_name, state_json, token_count) for each stage of a run that gave something, and for errors.

    parsed: request_id and columns of the requisition; normalized: request_id,
    mandatory, preferred; scored and results: a row a candidate; errors:
    request_id, error_message.
    """
    none = F.lit(None).cast("int").alias("token_count")

    def rows(df: DataFrame, node: str, state: Column) -> DataFrame:
        return df.select("request_id", F.lit(node).alias("node_name"), F.to_json(state).alias("state_json"), none)

    n_scored = scored.groupBy("request_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    n_results = results.groupBy("request_id").agg(F.count(F.lit(1)).alias("result_count"))
    parts = [
        rows(parsed, "jd_parsing", F.struct(*[c for c in parsed.columns if c != "request_id"])), rows(normalized, "skill_normalization", F.struct("mandatory", "preferred")),
        rows(n_scored, "matching_scoring", F.struct("candidate_count")), rows(n_scored, "explanation_generation", F.struct("candidate_count")),
        rows(n_results, "result_aggregation", F.struct("result_count", F.lit("completed").alias("status"))), rows(errors.filter("error_message IS NOT NULL AND error_message <> ''"), "error", F.struct("error_message")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
