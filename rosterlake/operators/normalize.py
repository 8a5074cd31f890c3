"""Free-text skills to canonical ids: the dictionary, then aliases, then a synthetic id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from . import extract

# The aliases and the names that they stand for.
ALIASES = {
    "js": "JavaScript", "ts": "TypeScript", "py": "Python", "postgres": "PostgreSQL", "pg": "PostgreSQL", "k8s": "Kubernetes", "docker": "Docker", "react": "React", "vue": "Vue.js", "angular": "Angular",
    "node": "Node.js", "nodejs": "Node.js", "aws": "AWS", "azure": "Azure", "gcp": "Google Cloud Platform",
}


def dictionary(skill_master: DataFrame) -> DataFrame:
    """(skill_key, skill_id): of names that differ in case alone the smallest id counts."""
    return skill_master.filter(F.col("skill_name").isNotNull()).groupBy(F.lower("skill_name").alias("skill_key")).agg(F.min("skill_id").alias("skill_id"))


def normalize(raw: DataFrame, skill_master: DataFrame, column: str = "raw_skill", fuzzy: int = 0) -> DataFrame:
    """raw with columns skill_id and how ('exact', 'alias', 'fallback', or 'fuzzy').

    A name that neither the dictionary nor an alias knows becomes its upper-cased
    text with underscores for spaces. With fuzzy > 0 the dictionary's nearest
    name is looked up first (see nearest), if one is at most so many edits away.
    The aliases are a fixed short list; how the dictionary is joined is left to
    Spark, for it may be large.
    """
    known = dictionary(skill_master)
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in (pair[0], pair[1].lower())])
    name = strip(F.col(column))
    rows = raw.withColumn("name_", name).withColumn("key_", F.lower("name_")).withColumn("alias_", aliases[F.col("key_")])
    hit = known.select(F.col("skill_key").alias("key_"), F.col("skill_id").alias("exact_"))
    second = known.select(F.col("skill_key").alias("alias_"), F.col("skill_id").alias("by_alias_"))
    rows = rows.join(hit, "key_", "left").join(second, "alias_", "left")
    found = F.coalesce("exact_", "by_alias_")
    if fuzzy:
        unknown = rows.filter(found.isNull()).select("key_").distinct()
        rows = rows.join(nearest(unknown, known, "key_", fuzzy).select("key_", F.col("skill_id").alias("near_")), "key_", "left")
    else:
        rows = rows.withColumn("near_", F.lit(None).cast("string"))
    how = F.when(F.col("exact_").isNotNull(), "exact").when(F.col("by_alias_").isNotNull(), "alias").when(F.col("near_").isNotNull(), "fuzzy").otherwise("fallback")
    return rows.select(*raw.columns, F.coalesce("exact_", "by_alias_", "near_", F.replace(F.upper("name_"), F.lit(" "), F.lit("_"))).alias("skill_id"), how.alias("how"))


def _shortened(name: F.Column, edits: int) -> F.Column:
    """The name and all that is left of it without one character, without two, and so on up to edits."""

    def without(v: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.char_length(v)), lambda i: F.concat(F.substr(v, F.lit(1), i - 1), F.substr(v, i + 1)))

    out = F.array(name)
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda v: F.char_length(v) > 0), without))))
    return out


def nearest(names: DataFrame, known: DataFrame, column: str, edits: int) -> DataFrame:
    """(column, skill_id, distance): for each of names the known one (skill_key, skill_id) with the fewest edits, at most `edits`; ties go to the smallest id.

    Two names are at most so many insertions, deletions and substitutions apart
    only if both become the same text by taking out at most so many characters of
    each. So the names meet by equality of such shortened texts, and only those
    that meet are compared; no name is held against the whole dictionary. A
    name of n characters has about n^edits / edits! of them.
    """
    short = lambda df, name: df.withColumn("short_", F.explode(F.transform(_shortened(F.col(name), edits), lambda v: F.xxhash64(v))))
    met = short(names.select(column).filter(F.col(column).isNotNull()).distinct(), column).join(short(known.select("skill_key", "skill_id"), "skill_key"), "short_").select(column, "skill_key", "skill_id").distinct()
    near = met.withColumn("distance", F.levenshtein(column, "skill_key")).filter(F.col("distance") <= edits)
    best = near.groupBy(column).agg(F.min(F.struct("distance", "skill_id")).alias("best_"))
    return best.select(column, "best_.skill_id", "best_.distance")


def skill_lists(normalized: DataFrame) -> DataFrame:
    """(request_id, mandatory, preferred): distinct ids in the order of the requisition's lists (column pos)."""

    def ids(kind: str) -> F.Column:
        rows = F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "skill_id")))
        return F.array_distinct(F.transform(F.array_sort(rows), lambda x: x["skill_id"])).alias(kind)

    return normalized.groupBy("request_id").agg(ids("mandatory"), ids("preferred"))


def with_text_skills(raw: DataFrame, texts: DataFrame, skill_master: DataFrame, kind: str = "mandatory") -> DataFrame:
    """raw (request_id, kind, pos, raw_skill) united with the dictionary names found in texts (request_id, text).

    A name that the requisition lists already, in whatever case and under either
    kind, is not put in again; the others follow its list of that kind in the
    order of their names.
    """
    names = skill_master.filter(F.col("skill_name").isNotNull()).groupBy(F.col("skill_id").alias("of_")).agg(F.min("skill_name").alias("name_"))
    found = skills_in_text(texts.filter(F.col("request_id").isNotNull()), skill_master, "request_id", "text").join(names, F.col("skill_id") == F.col("of_")).select("request_id", "name_")
    listed = raw.select("request_id", F.lower(strip(F.col("raw_skill"))).alias("key_")).distinct()
    new = found.withColumn("key_", F.lower("name_")).join(listed, ["request_id", "key_"], "left_anti")
    last = raw.filter(F.col("kind") == kind).groupBy("request_id").agg(F.max("pos").alias("last_"))
    place = F.row_number().over(Window.partitionBy("request_id").orderBy("key_", "name_"))  # at most the dictionary's names in a text
    new = new.withColumn("n_", place).join(last, "request_id", "left")
    more = new.select("request_id", F.lit(kind).alias("kind"), (F.coalesce("last_", F.lit(-1)) + F.col("n_")).cast(raw.schema["pos"].dataType).alias("pos"), F.col("name_").alias("raw_skill"))
    return raw.select("request_id", "kind", "pos", "raw_skill").unionByName(more)


def skills_in_text(texts: DataFrame, skill_master: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, skill_id): dictionary names that occur in a text, as whole words."""
    return extract.names_in_text(texts, skill_master, id_col, text_col).select(id_col, "skill_id").distinct()
