"""Exact deduplication behind a two-pass Bloom filter, in DataFrame operations only.

Pass 1 puts each row's text hash into a Bloom filter of m bits at k places and
keeps the bits that two or more rows touched. Pass 2 tests each row against
those bits. A row with an untouched or once-touched bit has a text that occurs
once: it passes straight through, without a shuffle. The other rows, the
possibly repeated ones, are shuffled by the SHA-256 of their text and settled
exactly, so false positives of the filter cost time but change nothing.

The filter is broadcast, so its size is bounded by ``max_bits`` (128 MB by
default). Where the rows ask for more, they are dealt into parts by a hash of
their text first, in one write without a shuffle, and each part is handled with a
filter of its own: equal texts are in one part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path
from .common import checkpoint, spread, table, temp_name

#: 64-bit words in one bucket of the filter (a bucket is one broadcast row).
BUCKET_WORDS = 512


def filter_bits(rows: int, bits_per_row: int = 16) -> int:
    """A power of two of at least 2^16 with bits_per_row bits a row."""
    return 1 << max(16, (rows * bits_per_row - 1).bit_length())


def _places(text: Column, bits: int, k: int) -> list[Column]:
    return [F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(bits)) for seed in range(k)]


def repeated_bits(texts: DataFrame, text: str, bits: int, k: int = 2) -> DataFrame:
    """Pass 1: (bucket, words) of the bits that two or more rows touched.

    The positions are counted with map-side partial sums, so a text that fills
    a third of the rows costs k rows a task.
    """
    place = texts.select(F.explode(F.array(*_places(F.col(text), bits, k))).alias("place"))
    word = F.shiftright("place", 6)
    touched = (
        place.groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(word.alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.expr("bit_or(bit)").alias("bits"))
        .groupBy(F.expr(f"word div {BUCKET_WORDS}").alias("bucket"))
        .agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % BUCKET_WORDS).cast("int").alias("at"), "bits"))).alias("m"))
    )  # at most BUCKET_WORDS words meet in a bucket
    return touched.select("bucket", F.expr(f"transform(sequence(0, {BUCKET_WORDS - 1}), i -> coalesce(m[i], 0L))").alias("words"))


def _tested(df: DataFrame, text: str, flag: str, repeated: DataFrame, bits: int, k: int) -> DataFrame:
    """Pass 2: df with a boolean column flag, true for the possibly repeated rows. repeated: what pass 1 gave, at most bits / 8 bytes."""
    repeated = F.broadcast(repeated)
    out, hit = df, F.lit(True)
    for j, place in enumerate(_places(F.col(text), bits, k)):
        p, b, w = (temp_name(df, f"{x}{j}_") for x in ("place", "bucket", "words"))
        out = out.withColumn(p, place)
        out = out.join(repeated.select(F.col("bucket").alias(b), F.col("words").alias(w)), F.expr(f"`{p}` div {64 * BUCKET_WORDS}") == F.col(b), "left")
        word = F.get(F.col(w), F.expr(f"cast((`{p}` >> 6) % {BUCKET_WORDS} as int)"))
        hit = hit & F.coalesce(F.getbit(word, (F.col(p) % 64).cast("int")) == 1, F.lit(False))
    return out.withColumn(flag, hit).select(*df.columns, flag)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, bits_per_row: int = 16, max_bits: int = 1 << 30, ways: int = 64) -> DataFrame:
    """df's rows with keep_id, group_size, kept and text_sha256.

    Texts are equal when their UTF-8 bytes are (compared by SHA-256); null
    counts as the empty text. Of equal texts the row with the largest id stays,
    null ids being the smallest; of repeated rows with the same id exactly one
    stays. Ids need not be unique. All columns of df are kept, whatever their
    names, unless they are named like the four results, which replace them.
    An empty table gives an empty result. df is read more than once and must
    give the same rows each time.
    """
    results = ["keep_id", "group_size", "kept", "text_sha256"]
    df = df.drop(*[c for c in df.columns if c.lower() in results and c not in (id_col, text_col)])
    bits = filter_bits(df.count(), bits_per_row)  # of Parquet: read from the footers
    if bits <= max_bits:
        return _settled(df, id_col, text_col, k, bits, ways)
    part, path = temp_name(df, "part"), shared_path(df.sparkSession, "texts")
    parts = bits // max_bits
    df.withColumn(part, F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(97)), F.lit(parts)).cast("int")).write.partitionBy(part).parquet(path)
    dealt = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField(part, T.IntegerType())])).parquet(path)
    return reduce(DataFrame.unionByName, [_settled(dealt.filter(F.col(part) == i).select(*df.columns), id_col, text_col, k, max_bits, ways) for i in range(parts)])


def _settled(df: DataFrame, id_col: str, text_col: str, k: int, bits: int, ways: int) -> DataFrame:
    """exact_groups with one filter."""
    text, tie, flag, salt, best, n = (temp_name(df, x) for x in ("whole_text", "tie", "maybe", "salt", "best", "n"))
    own = df.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    own = _tested(own, text, flag, checkpoint(repeated_bits(own, text, bits, k)), bits, k).withColumn("text_sha256", F.sha2(F.col(text).cast("binary"), 256)).drop(text)
    once = own.filter(~F.col(flag)).select(*df.columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    # Fixed, so that the numbers by which rows with one id are told apart stay theirs when a task runs again.
    maybe = checkpoint(own.filter(F.col(flag)).drop(flag)).withColumn(tie, F.monotonically_increasing_id())
    maybe = maybe.withColumn(salt, spread(F.col(tie), ways))
    # A group is counted by (hash, salt), then by hash, and goes back to the salts it has: a group with a third of the rows meets its result in `ways` tasks.
    parts = maybe.groupBy("text_sha256", salt).agg(F.max(F.struct(F.col(id_col).alias("id"), F.col(tie).alias("tie"))).alias(best), F.count(F.lit(1)).alias(n))
    groups = parts.groupBy("text_sha256").agg(F.max(best).alias(best), F.sum(n).alias(n), F.collect_set(salt).alias(salt))
    sha_of, salt_of = temp_name(maybe, "of_sha"), temp_name(maybe, "of_salt")
    back = groups.select(F.col("text_sha256").alias(sha_of), F.explode(salt).alias(salt_of), best, n)
    settled = maybe.join(back, (maybe["text_sha256"] == back[sha_of]) & (maybe[salt] == back[salt_of])).select(
        *[maybe[c] for c in df.columns],
        back[best]["id"].alias("keep_id"), back[n].alias("group_size"), (back[best]["tie"] == maybe[tie]).alias("kept"), maybe["text_sha256"],
    )
    return once.unionByName(settled)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the copies that exact_groups drops; its columns as they were."""
    return exact_groups(df, id_col, text_col, **options).filter("kept").select(*df.columns)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Each document with the one that stays of its equal texts; a null text counts as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
