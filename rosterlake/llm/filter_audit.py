r"""How five document filters overlap: a relational word pipeline.

Words are rows: texts are dealt out by document, exploded into words, counted by
(document, word), and these counts give each document's words and distinct
words, all on that one shuffle. The flags that need no words (characters,
signs, equal texts) and the labels are joined to them, so each document has five
bits. What a filter order removes hangs on nothing but how many documents of a
part have each of the 32 combinations, so one aggregation with 32 conditional
counts (and as many of good and of toxic documents) answers all 120 orders.

Failure conditions: A under 200 words; B under half of the words distinct;
C over 2 % of the characters are A-Z; D one of ``#$%&*|``; E the text of a
document with a smaller id.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table
from .simhash import lookup

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
#: Bytes of text that a task explodes, as long as that makes no more tasks than MOST_TASKS; beyond that tasks grow, and the counts of words spill.
TASK_BYTES, MOST_TASKS = 8 << 20, 50_000


def word_counts(docs: DataFrame, tasks: int) -> DataFrame:
    """(id, h, words, distinct_words) of docs (id, h, text), words being maximal runs of ``[^\\x20\\x09-\\x0D]``; no row where a text has none.

    Texts are dealt out by (id, h) and stay there: the words are counted by
    (id, h, word) and by (id, h) without another shuffle. Rows that repeat an id
    and text count together.
    """
    words = docs.repartition(tasks, "id", "h").select("id", "h", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    each = words.groupBy("id", "h", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("id", "h").agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("distinct_words"))


def failures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(id, part, mask) for each row of df: bit i of mask is set if the document fails filter i.

    A null text counts as empty, a null part as the empty string. A document
    without words fails A and not B. A row with a null id has no smaller id
    anywhere, so it never fails E, nor does it make another row fail it. Rows that
    repeat an id are documents of their own; none of them fails E for the other's
    sake. Other columns are not looked at. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))  # tells rows with one id apart
    plain = checkpoint(docs.select(
        "id", "part", "h", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.octet_length("text").cast("long").alias("bytes"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 2 * F.length("text")).alias("c"), F.col("text").rlike(r"[#$%&*|]").alias("d"),
    ))
    total = plain.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    counts = word_counts(docs.select("id", "h", "text"), max(1, min(MOST_TASKS, -(-total // task_bytes))))
    repeats = plain.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n_rows"))
    of_words = repeats.withColumnsRenamed({"id": "id_", "h": "h_"}).join(counts, F.col("id_").eqNullSafe(F.col("id")) & (F.col("h_") == F.col("h")), "left").select(
        "id_", "h_", (F.coalesce("words", F.lit(0)) / F.col("n_rows")).cast("long").alias("words"), F.coalesce("distinct_words", F.lit(0)).alias("distinct_words"),
    )
    first = plain.groupBy("digest").agg(F.min("id").alias("first"))
    rows = lookup(plain.select("id", "part", "h", "digest", "c", "d"), "digest", first, "id").join(of_words, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")))
    failed = [F.col("words") < 200, 100 * F.col("distinct_words") < 50 * F.col("words"), F.col("c"), F.col("d"), F.coalesce(F.col("first") < F.col("id"), F.lit(False))]
    return rows.select("id", "part", sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0)).alias("mask"))


def combination_counts(failed: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(part, n, good, toxic): arrays of 32 counts of the documents with each mask, of the good and of the toxic ones.

    failed: as failures gives it. labels: (id, good, toxic) booleans; of labels
    that repeat an id any true one counts, null ids and values count for nothing.
    """
    if labels is None:
        rows = failed.withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    else:
        of = labels.filter("id IS NOT NULL").groupBy("id").agg(F.bool_or("good").alias("good"), F.bool_or("toxic").alias("toxic"))
        rows = failed.join(of, "id", "left").withColumns({x: F.coalesce(x, F.lit(False)) for x in ("good", "toxic")})
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = rows.groupBy("part").agg(*[F.count_if((F.col("mask") == m) & which).alias(f"{kind}_{m}") for kind, which in kinds.items() for m in range(MASKS)])
    return counts.select("part", *[F.array(*[f"{kind}_{m}" for m in range(MASKS)]).alias(kind) for kind in kinds])


def audit(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order of the filters, and step.

    From combination_counts alone: a document with mask m reaches a step if none
    of the earlier filters is in m, and of the k filters in m each comes first
    in 120 / k of the orders.
    """
    steps = [(order, i + 1, 1 << FILTERS.index(x), sum(1 << FILTERS.index(y) for y in order[:i])) for order in map("".join, permutations(FILTERS)) for i, x in enumerate(order)]
    step = F.explode(F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"b":{b},"e":{e}}}' for o, s, b, e in steps) + "]"), "array<struct<o:string,s:int,b:int,e:int>>")).alias("x")
    masks = F.array(*[F.lit(m) for m in range(MASKS)])
    shares = F.array(*[F.lit(120 // m.bit_count() if m else 0) for m in range(MASKS)])

    def total(of: str, holds, weight: Column | None = None) -> Column:
        value = lambda m: F.col(of)[m] if weight is None else F.col(of)[m] * weight[m]
        return F.aggregate(masks, F.lit(0).cast("long"), lambda at, m: at + F.when(holds(m), value(m)).otherwise(0))

    bit, earlier = F.col("x.b"), F.col("x.e")
    reaches = lambda m: m.bitwiseAND(earlier) == 0
    fails = lambda m: m.bitwiseAND(bit) != 0
    taken = lambda m: reaches(m) & fails(m)
    return counts.select("part", "n", "good", "toxic", step).select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"), total("n", lambda m: reaches(m) & ~fails(m)).alias("kept"), total("n", taken).alias("removed"), total("n", lambda m: ~reaches(m) & fails(m)).alias("redundant"),
        F.col("n")[bit].alias("unique_fails"), total("good", taken).alias("good_lost"), total("toxic", taken).alias("toxic_lost"), total("n", fails, shares).alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Each source's documents through all orders of the five filters, step by step."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return audit(combination_counts(failures(table(spark, sf_dir, "documents")), labels))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM d),
f AS (SELECT doc_id, part, (len(words) < 200)::INT AS a, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS b, (100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * len(t))::INT AS c,
  regexp_matches(t, '[#$%&*|]')::INT AS d, (min(doc_id) OVER (PARTITION BY t) < doc_id)::INT AS e FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM x p, x q, x r, x s, x t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, step, coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM m, s GROUP BY part, filter_order, step
"""
