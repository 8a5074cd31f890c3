"""What a free text says: names of a dictionary, experience, duration, and the first day.

The dictionary's names are put into one automaton, which is walked once over each
text, whatever the number of names. It is sent to the tasks while it is of a
checked size; a larger dictionary meets the runs of words of the texts by an
equality join instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lower

#: Bytes of names up to which the dictionary goes to every task.
DICTIONARY_BYTES = 32 << 20
#: Rows and bytes of a batch that goes to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def words_of(text: Column) -> Column:
    """A text's words in lower case: runs of letters, digits, dots, pluses and hashes."""
    return F.filter(F.split(lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}.+#]+"), lambda w: w != "")


def names_in_text(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(id, skill_id, n_mentions): which of names (skill_name, skill_id) a text says as whole words, and how often.

    Names and texts are compared word by word, see words_of; mentions may
    overlap. Of names with the same words the smallest id counts. A name without
    words is never found; rows that repeat an id and text give their rows again.
    """
    known = names.select(F.array_join(words_of(F.col("skill_name")), " ").alias("key"), "skill_id").filter("key <> ''").groupBy("key").agg(F.min("skill_id").alias("skill_id"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0))).first()[0]
    of = texts.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    found = _walked(of, known) if size <= most_bytes else _joined(of, known)
    return found.select(F.col("id").alias(id_col), "skill_id", "n_mentions")


def _walked(of: DataFrame, known: DataFrame) -> DataFrame:
    spark = of.sparkSession
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)
    sent = spark.sparkContext.broadcast([tuple(r) for r in known.collect()])  # at most DICTIONARY_BYTES
    schema = T.StructType([of.schema["id"], known.schema["skill_id"], T.StructField("n_mentions", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for number, (key, _) in enumerate(sent.value):
            automaton.add_word(f" {key} ", number)
        automaton.make_automaton()
        ids = pa.array([x for _, x in sent.value], pa.string())
        for batch in batches:
            rows, which, counts = [], [], []
            for i, text in enumerate(batch.column(1)):
                said: dict[int, int] = {}
                for _, number in automaton.iter(text.as_py()) if len(sent.value) else ():
                    said[number] = said.get(number, 0) + 1
                rows += [i] * len(said)
                which += said.keys()
                counts += said.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), ids.take(pa.array(which, pa.int64())), pa.array(counts, pa.int64())], names=schema.names)

    return of.select("id", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("text")).mapInArrow(run, schema)


def _joined(of: DataFrame, known: DataFrame) -> DataFrame:
    def runs(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1))), lambda i: i + (n - 1) <= F.size("words"))
        return F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))

    lengths = sorted(r[0] for r in known.select(F.size(F.split("key", " "))).distinct().collect()) or [1]  # a few small numbers
    said = of.withColumn("row_", F.monotonically_increasing_id()).select("row_", "id", F.explode(F.concat(*[runs(n) for n in lengths])).alias("key"))
    counted = said.groupBy("row_", "id", "key").agg(F.count(F.lit(1)).alias("n_mentions"))
    return counted.join(known, "key").select("id", "skill_id", "n_mentions")


_UNIT = r"(years?|yrs?|months?|mos?)"
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, n), F.lit(""))


def _in_months(number: Column, unit: Column) -> Column:
    return number.cast("int") * F.when(F.lower(unit).startswith("y"), 12).otherwise(1)


def experience(text: Column) -> Column:
    """(min_months, max_months) that a text asks for: "3-5 years of experience", "at least 4 years' experience", "up to 18 months of experience".

    The first range counts; without one the first lower and the first upper bound.
    A number without words for a bound is a lower one. Null where nothing is said.
    """
    about = r"\s*\+?\s*" + _UNIT + r"['’]?\s+(?:of\s+)?(?:[\p{L}-]+\s+){0,3}?experience"
    pair = r"(?i)\b(\d{1,3})\s*(?:-|–|to)\s*(\d{1,3})" + about
    upper = r"(?i)\b(?:up to|at most|no more than|less than)\s+(\d{1,3})" + about
    lower = r"(?i)(?<!up to )(?<!at most )(?<!more than )(?<!less than )(?<![\d–-])\b(\d{1,3})" + about
    low, high, unit = (_group(text, pair, i) for i in (1, 2, 3))
    single = _in_months(_group(text, lower, 1), _group(text, lower, 2))
    most = _in_months(_group(text, upper, 1), _group(text, upper, 2))
    return F.struct(F.when(low.isNotNull(), _in_months(low, unit)).otherwise(single).alias("min_months"), F.when(low.isNotNull(), _in_months(high, unit)).otherwise(most).alias("max_months"))


def duration_months(text: Column) -> Column:
    """How long an assignment lasts: "for 6 months", "duration: 2 years"; null where nothing is said."""
    pattern = r"(?i)\b(?:for|duration(?: of)?:?|lasts|lasting)\s+(\d{1,3})\s+" + _UNIT + r"\b(?!['’]?\s+(?:of\s+)?(?:[\p{L}-]+\s+){0,3}?experience)"
    return _in_months(_group(text, pattern, 1), _group(text, pattern, 2))


def start_date(text: Column) -> Column:
    """The day after "start", "starting", "from" or "available by": 2026-06-01, 1 June 2026 or June 2026 (its first day); null where none is said or it is no day."""
    word = r"(?i)\b(?:start(?:s|ing|ing date| date)?|from|available by|beginning)(?:\s+(?:on|in|from|is))?:?\s+"
    names = "|".join(_MONTHS)
    iso = F.try_to_date(_group(text, word + r"(\d{4}-\d{2}-\d{2})\b", 1), "yyyy-MM-dd")
    written = word + rf"(?:(\d{{1,2}})(?:st|nd|rd|th)?\s+)?({names})\s+(\d{{4}})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(_group(text, written, 2)))
    spelt = F.concat_ws("-", _group(text, written, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.coalesce(_group(text, written, 1), F.lit("1")), 2, "0"))
    return F.coalesce(iso, F.when(month > 0, F.try_to_date(spelt, "yyyy-MM-dd")))
