"""The registered queries, each over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import text as fn
from .operators import audit, availability, explain, extract, matching, normalize, quality, rank, scoring, top, upsert
from .plans import dispatch, ingest
from .plans import matching as plan
from .session import shared_path, written
from .sources import adapter as src
from .sources import documents, tables
from .streaming import upserts

TOP, BATCH = 50, 100
#: Buckets of the databases that queries make for themselves: the test tables are small.
FEW = 4

# --------------------------------------------------------------- SQL pieces

CTES = {
    "tm": """tm AS (SELECT 'TM' || lpad(c_custkey::VARCHAR, 9, '0') AS team_member_id, c_mktsegment AS designation, c_custkey % 10 <> 0 AS is_active,
        CASE WHEN c_custkey % 97 <> 0 THEN (c_custkey % 181)::INT END AS experience_in_months, c_name AS full_name, (['wfo', 'wfh', 'hybrid'])[c_nationkey % 3 + 1] AS work_type, c_custkey AS custkey FROM customer)""",
    "sm": "sm AS (SELECT upper(replace(p_name, ' ', '_')) AS skill_id, p_name AS skill_name, split_part(p_name, ' ', 2) AS category_name, min(p_partkey) AS first_part FROM part GROUP BY p_name)",
    "ol": """ol AS (SELECT o_custkey AS custkey, 'TM' || lpad(o_custkey::VARCHAR, 9, '0') AS team_member_id, upper(replace(p_name, ' ', '_')) AS skill_id, p_name AS skill_name, l_linenumber, l_partkey, l_orderkey, l_extendedprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "ms": "ms AS (SELECT custkey, team_member_id, skill_id, max(l_linenumber) AS rating, min(l_partkey) % 13 = 0 AS is_deleted FROM ol GROUP BY ALL)",
    "al": """al AS (SELECT 'TM' || lpad(o_custkey::VARCHAR, 9, '0') AS team_member_id, 'PROJ' || o_orderkey AS project_id, ((o_orderkey % 4 + 1) * 20)::DECIMAL(5,2) AS allocation_percentage, o_orderdate::DATE AS start_date,
        o_orderdate::DATE + (90 + o_orderkey % 451)::INT AS end_date, o_orderstatus = 'F' AS billable, o_orderkey % 11 = 0 AS is_deleted, o_orderkey AS orderkey, o_custkey AS custkey FROM orders)""",
    "rq": """rq AS (SELECT 'REQ' || lpad(n_nationkey::VARCHAR, 4, '0') AS request_id, DATE '1996-01-01' + (60 * n_nationkey)::INT AS expected_start_date, CASE WHEN n_nationkey % 5 <> 0 THEN 2 + n_nationkey % 9 END AS requisition_duration_month,
        CASE WHEN n_nationkey % 4 <> 0 THEN 24 + 3 * n_nationkey END AS min_months, CASE WHEN n_nationkey % 4 = 1 THEN 20 + 3 * n_nationkey ELSE 60 + 3 * n_nationkey END AS max_months, n_name AS title, CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE n_name END AS role, n_nationkey AS key FROM nation)""",
    "rw": "rw AS (SELECT *, expected_start_date AS w_start, expected_start_date + (30 * coalesce(nullif(requisition_duration_month, 0), 6))::INT AS w_end FROM rq)",
    "rs": """rs AS (SELECT DISTINCT 'REQ' || lpad(n_nationkey::VARCHAR, 4, '0') AS request_id, CASE WHEN p_partkey % 5 < 3 THEN 'mandatory' ELSE 'preferred' END AS kind, upper(replace(p_name, ' ', '_')) AS skill_id, min(p_partkey) AS pos
        FROM nation JOIN part ON p_partkey >= 5 * n_nationkey AND p_partkey < 5 * n_nationkey + CASE WHEN n_nationkey % 7 = 0 THEN 3 ELSE 5 END GROUP BY ALL)""",
    "busy": "busy AS (SELECT request_id, team_member_id, sum(allocation_percentage::DOUBLE) AS allocated, count(*) AS n_allocations FROM al JOIN rw ON start_date < w_end AND end_date > w_start WHERE NOT is_deleted GROUP BY ALL)",
    "sc": """wanted AS (SELECT request_id, count(*) FILTER (kind = 'mandatory') AS nm, count(*) FILTER (kind = 'preferred') AS np FROM rs GROUP BY request_id),
        hits AS (SELECT request_id, team_member_id, count(*) FILTER (kind = 'mandatory') AS hm, count(*) FILTER (kind = 'preferred') AS hp FROM rs JOIN ms USING (skill_id) GROUP BY ALL),
        parts AS (SELECT rw.request_id, tm.team_member_id, CASE WHEN coalesce(nm, 0) > 0 THEN coalesce(hm, 0)::DOUBLE / nm ELSE 1.0::DOUBLE END AS mandatory_score, CASE WHEN coalesce(np, 0) > 0 THEN coalesce(hp, 0)::DOUBLE / np ELSE 1.0::DOUBLE END AS preferred_score,
            CASE WHEN min_months IS NOT NULL AND coalesce(experience_in_months, 0) < min_months THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS experience_score, greatest(0.0::DOUBLE, 100.0::DOUBLE - coalesce(allocated, 0)) / 100.0::DOUBLE AS availability_score, coalesce(allocated, 0) < 80 AS is_available
            FROM rw CROSS JOIN tm LEFT JOIN wanted USING (request_id) LEFT JOIN hits USING (request_id, team_member_id) LEFT JOIN busy USING (request_id, team_member_id) WHERE is_active),
        s1 AS (SELECT *, 0.7::DOUBLE * mandatory_score + 0.3::DOUBLE * preferred_score AS skill_score FROM parts),
        sc AS (SELECT *, 0.8::DOUBLE * skill_score + 0.2::DOUBLE * experience_score AS final_score FROM s1),
        rk AS (SELECT *, (row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, team_member_id))::INT AS rank, CASE WHEN final_score >= 0.75 THEN 'HIGH' WHEN final_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS fit_level FROM sc)""",
    "ml": """ml AS (SELECT request_id, team_member_id, coalesce(string_agg(skill_id, ', ' ORDER BY kind, pos), '') AS skills_matched, count(*) FILTER (kind = 'mandatory') AS nmm, count(*) FILTER (kind = 'preferred') AS npm FROM rs JOIN ms USING (skill_id) GROUP BY ALL)""",
    "cp": "cp AS (SELECT event_id AS id, user_id::VARCHAR AS request_id, event_type AS node_name, props AS state_json, CASE WHEN event_id % 9 <> 0 THEN floor(value)::INT END AS token_count, ts AS created_at FROM events)",
    "rm": "rm AS (SELECT event_type AS endpoint, value AS duration, event_id % 20 = 0 AS failed FROM events)",
}
SCORES = ("tm", "ol", "ms", "al", "rw", "rs", "busy", "sc")


def _sql(select: str, *names: str) -> str:
    names_ = [n for x in names for n in (("rq", "rw") if x == "rw" else (x,))]
    return "WITH " + ",\n".join(CTES[n] for n in dict.fromkeys(names_)) + "\n" + select  # select may go on with tables of its own after a comma


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a query under its function's name, with its SQL after the named common tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _sql(sql, *ctes) if ctes else sql
        return f

    return add


# ------------------------------------------------------------ shared inputs


def _requisitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.normalized_requisitions(src.requisition(spark, sf_dir), src.requisition_skill(spark, sf_dir), src.skill_master(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidates(_requisitions(spark, sf_dir), src.team_member(spark, sf_dir), src.team_member_skill(spark, sf_dir), src.team_member_allocation(spark, sf_dir))


def _explained(rows: DataFrame) -> DataFrame:
    return explain.lines(explain.summaries(explain.strengths_and_gaps(matching.with_reasons(rows))))


# ------------------------------------------------------- members and skills


@query("SELECT team_member_id, experience_in_months::VARCHAR AS experience_in_months, designation, work_type FROM tm WHERE is_active", "tm")
def active_members(spark, sf_dir):
    return src.team_member(spark, sf_dir).filter("is_active").select("team_member_id", F.col("experience_in_months").cast("string").alias("experience_in_months"), "designation", "work_type")


@query("SELECT team_member_id, count(skill_id) AS n_skills, coalesce(string_agg(skill_id, ',' ORDER BY skill_id), '') AS skills FROM tm LEFT JOIN ms USING (team_member_id) GROUP BY team_member_id", "tm", "ol", "ms")
def member_skill_sets(spark, sf_dir):
    have = src.team_member_skill(spark, sf_dir).groupBy("team_member_id").agg(F.array_sort(F.collect_set("skill_id")).alias("s"))
    rows = src.team_member(spark, sf_dir).select("team_member_id").join(have, "team_member_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<string>")))
    return rows.select("team_member_id", F.size("s").cast("long").alias("n_skills"), F.array_join("s", ",").alias("skills"))


@query("SELECT DISTINCT request_id, kind, skill_id, 'exact' AS how FROM rs", "rs")
def skill_normalize_exact(spark, sf_dir):
    return normalize.normalize(src.requisition_skill(spark, sf_dir), src.skill_master(spark, sf_dir)).select("request_id", "kind", "skill_id", "how").distinct()


#: Names that the aliases stand for, as a dictionary of its own; some are missing on purpose.
_TECH = [("python", "PYTHON"), ("JavaScript", "JAVASCRIPT"), ("KUBERNETES", "KUBERNETES"), ("PostgreSQL", "POSTGRESQL"), ("Node.js", "NODE_JS"), ("aws", "AWS"), ("Aws", "AWS_2"), ("React", "REACT")]
_RAW = ["js", " JS\t", "py", "Python", "k8s", "pg", "postgres", "node", "NodeJS", "aws", "azure", "gcp", "react", "ts", "vue"]
_ALIAS_SQL = f"""WITH tech(skill_name, skill_id) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _TECH)}),
    raw(i, raw_skill) AS (VALUES {", ".join(f"({i}, replace('{r}', chr(9), chr(9)))" for i, r in enumerate(_RAW))}),
    ali(k, v) AS (VALUES {", ".join(f"('{k}', '{v.lower()}')" for k, v in normalize.ALIASES.items())}),
    d AS (SELECT lower(skill_name) AS key, min(skill_id) AS skill_id FROM tech GROUP BY 1),
    n AS (SELECT n_nationkey, raw_skill, regexp_replace(raw_skill, '^\\s+|\\s+$', '', 'g') AS name FROM nation JOIN raw ON n_nationkey % 15 = i)
    SELECT n_nationkey, coalesce(a.skill_id, b.skill_id, upper(replace(name, ' ', '_'))) AS skill_id, CASE WHEN a.skill_id IS NOT NULL THEN 'exact' WHEN b.skill_id IS NOT NULL THEN 'alias' ELSE 'fallback' END AS how
    FROM n LEFT JOIN d a ON lower(name) = a.key LEFT JOIN ali ON lower(name) = k LEFT JOIN d b ON v = b.key"""


@query(_ALIAS_SQL)
def skill_normalize_alias(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(r) for r in _RAW]), (F.col("n_nationkey") % len(_RAW) + 1).cast("int"))
    rows = src.table(spark, sf_dir, "nation").select("n_nationkey", raw.alias("raw_skill"))
    return normalize.normalize(rows, spark.createDataFrame(_TECH, "skill_name string, skill_id string")).select("n_nationkey", "skill_id", "how")


@query("SELECT c_custkey, upper(replace(trim(c_name || ' ' || c_mktsegment), ' ', '_')) AS skill_id, 'fallback' AS how FROM customer")
def skill_normalize_fallback(spark, sf_dir):
    rows = src.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" "), F.col("c_name"), F.lit(" "), F.col("c_mktsegment"), F.lit("\n")).alias("raw_skill"))
    return normalize.normalize(rows, src.skill_master(spark, sf_dir)).select("c_custkey", "skill_id", "how")


_MISSPELT = """t AS (SELECT p_partkey, p_name, 1 + p_partkey % length(p_name) AS pos FROM part), m AS (SELECT p_partkey, trim(CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 1, pos - 1) || substr(p_name, pos + 1) WHEN 1 THEN substr(p_name, 1, pos - 1) || 'x' || substr(p_name, pos)
    WHEN 2 THEN substr(p_name, 1, pos - 1) || 'x' || substr(p_name, pos + 1) ELSE substr(p_name, 1, pos - 1) || substr(p_name, pos + 1) || 'q' END) AS name FROM t)"""


@query(
    f"""WITH {CTES['sm']}, {_MISSPELT}, d AS (SELECT DISTINCT name FROM m),
    near AS (SELECT name, s.skill_id, levenshtein(name, lower(skill_name)) AS edits FROM d JOIN sm s ON levenshtein(name, lower(skill_name)) <= 2 QUALIFY row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, lower(skill_name)), s.skill_id) = 1)
    SELECT p_partkey, coalesce(skill_id, upper(replace(name, ' ', '_'))) AS skill_id, CASE WHEN edits = 0 THEN 'exact' WHEN edits > 0 THEN 'fuzzy' ELSE 'fallback' END AS how FROM m LEFT JOIN near USING (name)"""
)
def skill_normalize_fuzzy(spark, sf_dir):
    """Every part's name with one or two errors in it, brought back to the dictionary."""
    name, k = F.col("p_name"), F.col("p_partkey")
    pos = (1 + k % F.length(name)).cast("int")
    head, tail, rest = F.substr(name, F.lit(1), pos - 1), F.substr(name, pos), F.substr(name, pos + 1)
    raw = F.when(k % 4 == 0, F.concat(head, rest)).when(k % 4 == 1, F.concat(head, F.lit("x"), tail)).when(k % 4 == 2, F.concat(head, F.lit("x"), rest)).otherwise(F.concat(head, rest, F.lit("q")))
    rows = src.table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw_skill"))
    return normalize.normalize(rows, src.skill_master(spark, sf_dir), fuzzy=2).select("p_partkey", "skill_id", "how")


@query("SELECT request_id, CASE WHEN title = '' THEN 'Software Engineer' ELSE title END AS title, CASE WHEN role = '' THEN 'Engineer' ELSE role END AS role FROM rq", "rq")
def job_defaults(spark, sf_dir):
    return src.requisition(spark, sf_dir).select("request_id", fn.default(F.col("title"), "Software Engineer").alias("title"), fn.default(F.col("role"), "Engineer").alias("role"))


# ------------------------------------------------------------- availability


@query("SELECT request_id, w_start::DATE::VARCHAR AS w_start, w_end::DATE::VARCHAR AS w_end FROM rw", "rw")
def requisition_window(spark, sf_dir):
    rows = matching.requisition_windows(src.requisition(spark, sf_dir))
    return rows.select("request_id", F.col("w_start").cast("string").alias("w_start"), F.col("w_end").cast("string").alias("w_end"))


@query("SELECT request_id, team_member_id, project_id FROM al JOIN rw ON start_date < w_end AND end_date > w_start WHERE NOT is_deleted", "al", "rw")
def overlap_allocations(spark, sf_dir):
    windows = matching.requisition_windows(src.requisition(spark, sf_dir)).select("request_id", "w_start", "w_end")
    return availability.overlapping(src.team_member_allocation(spark, sf_dir), windows).select("request_id", "team_member_id", "project_id")


@query("SELECT request_id, team_member_id, project_id FROM al JOIN rw ON start_date < w_end AND end_date > w_start WHERE NOT is_deleted", "al", "rw")
def overlap_allocations_by_month(spark, sf_dir):
    """The same by the way that serves more windows than can be broadcast."""
    windows = matching.requisition_windows(src.requisition(spark, sf_dir)).select("request_id", "w_start", "w_end")
    return availability.overlapping(src.team_member_allocation(spark, sf_dir), windows, most=0).select("request_id", "team_member_id", "project_id")


@query("SELECT request_id, team_member_id, availability_score * 100 AS capacity, is_available FROM sc", *SCORES)
def member_availability(spark, sf_dir):
    return _scored(spark, sf_dir).select("request_id", "team_member_id", (F.col("availability_score") * 100).alias("capacity"), "is_available")


@query("SELECT request_id, team_member_id, coalesce(allocated, 0)::DOUBLE AS allocated, coalesce(n_allocations, 0)::BIGINT AS n_allocations FROM rw CROSS JOIN tm LEFT JOIN busy USING (request_id, team_member_id)", "tm", "al", "rw", "busy")
def member_window_load(spark, sf_dir):
    """What each member is allocated in each requisition's window, read off running sums."""
    windows = matching.requisition_windows(src.requisition(spark, sf_dir)).select("request_id", "w_start", "w_end")
    members = src.team_member(spark, sf_dir).select("team_member_id").join(availability.loads(src.team_member_allocation(spark, sf_dir)), "team_member_id", "left")
    at = (F.col("load"), F.col("w_start"), F.col("w_end"))
    return matching.with_each(members, windows).select("request_id", "team_member_id", availability.load_of(*at).alias("allocated"), availability.count_of(*at).alias("n_allocations"))


_TAKEN = """, day AS (SELECT request_id, w_start AS d FROM rw), ends AS (SELECT DISTINCT team_member_id, request_id, end_date AS d FROM al JOIN rw ON end_date > w_start AND end_date < w_end WHERE NOT is_deleted),
    cand AS (SELECT team_member_id, request_id, d FROM tm CROSS JOIN day UNION SELECT team_member_id, request_id, d FROM ends),
    taken AS (SELECT c.team_member_id, request_id, d, coalesce(sum(allocation_percentage), 0) AS n FROM cand c LEFT JOIN al a ON a.team_member_id = c.team_member_id AND start_date <= d AND end_date > d AND NOT is_deleted GROUP BY ALL)"""


@query(f"{_TAKEN} SELECT request_id, team_member_id, strftime(min(d) FILTER (n < 80), '%Y-%m-%d') AS available_from FROM taken JOIN tm USING (team_member_id) GROUP BY ALL", "tm", "al", "rw")
def availability_date(spark, sf_dir):
    """The first day of each requisition's window on which each member is available; null if there is none."""
    windows = matching.requisition_windows(src.requisition(spark, sf_dir)).select("request_id", "w_start", "w_end")
    members = src.team_member(spark, sf_dir).select("team_member_id").join(availability.loads(src.team_member_allocation(spark, sf_dir)), "team_member_id", "left")
    day = availability.available_from(F.col("load"), F.col("w_start"), F.col("w_end"))
    return matching.with_each(members, windows).select("request_id", "team_member_id", day.cast("string").alias("available_from"))


@query(
    f"""{_TAKEN}, d AS (SELECT request_id, team_member_id, strftime(min(d) FILTER (n < 80), '%Y-%m-%d') AS available_from FROM taken GROUP BY ALL)
    SELECT request_id, team_member_id, coalesce(experience_in_months, 0)::INT AS experience_months, min_months::VARCHAR AS required_months, greatest(coalesce(min_months, 0) - coalesce(experience_in_months, 0), 0)::INT AS missing_months, coalesce(allocated, 0)::DOUBLE AS allocated, available_from
    FROM tm CROSS JOIN rw LEFT JOIN busy USING (request_id, team_member_id) LEFT JOIN d USING (request_id, team_member_id) WHERE is_active""",
    "tm", "al", "rw", "busy",
)
def explanation_details(spark, sf_dir):
    """The numbers behind each explanation: experience against what is asked for, load, and the first free day."""
    pairs = matching.pairs(_requisitions(spark, sf_dir), src.team_member(spark, sf_dir), src.team_member_skill(spark, sf_dir), src.team_member_allocation(spark, sf_dir))
    return explain.details(pairs).withColumns({"required_months": F.col("required_months").cast("string"), "available_from": F.col("available_from").cast("string")})


# ------------------------------------------------------------------ scoring


@query("SELECT request_id, team_member_id, mandatory_score, preferred_score, skill_score FROM sc", *SCORES)
def skill_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("request_id", "team_member_id", "mandatory_score", "preferred_score", "skill_score")


@query("SELECT request_id, team_member_id, CASE WHEN min_months IS NOT NULL AND coalesce(experience_in_months, 0) < min_months THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS experience_score FROM tm CROSS JOIN rq WHERE is_active", "tm", "rq")
def experience_score(spark, sf_dir):
    asked = src.requisition(spark, sf_dir).select("request_id", "min_months")
    rows = matching.with_each(src.team_member(spark, sf_dir).filter("is_active"), asked)
    return rows.select("request_id", "team_member_id", scoring.experience_score(F.col("experience_in_months"), F.col("min_months")).alias("experience_score"))


@query("SELECT request_id, team_member_id, final_score FROM sc", *SCORES)
def final_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("request_id", "team_member_id", "final_score")


@query("SELECT request_id, fit_level, count(*) AS n FROM rk GROUP BY ALL", *SCORES)
def fit_level_histogram(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("request_id", scoring.fit_level(F.col("final_score")).alias("fit_level")).agg(F.count(F.lit(1)).alias("n"))


_RANKED = "SELECT request_id, team_member_id, rank, final_score, skill_score, experience_score, availability_score, is_available, fit_level FROM rk"


@query(_RANKED, *SCORES)
def match_rank(spark, sf_dir):
    """The flagship: every requisition's members, scored and ranked."""
    rows = rank.ranked(_scored(spark, sf_dir).drop("mandatory", "preferred", "skill_ids"), members=src.team_member(spark, sf_dir))
    return rows.select("request_id", "team_member_id", "rank", "final_score", "skill_score", "experience_score", "availability_score", "is_available", scoring.fit_level(F.col("final_score")).alias("fit_level"))


@query("SELECT request_id, team_member_id, rank FROM rk", *SCORES)
def match_rank_in_ranges(spark, sf_dir):
    """The same ranks by counting, for more members than a task should sort."""
    return rank.ranked(_scored(spark, sf_dir).select("request_id", "team_member_id", "final_score"), ways=8).select("request_id", "team_member_id", "rank")


@query(f"{_RANKED} WHERE rank <= {TOP}", *SCORES)
def match_top_k(spark, sf_dir):
    best = matching.best(_requisitions(spark, sf_dir), src.team_member(spark, sf_dir), src.team_member_skill(spark, sf_dir), src.team_member_allocation(spark, sf_dir), TOP)
    return best.select("request_id", "team_member_id", "rank", "final_score", "skill_score", "experience_score", "availability_score", "is_available", scoring.fit_level(F.col("final_score")).alias("fit_level"))


@query(f"{_RANKED} WHERE rank <= {TOP}", *SCORES)
def match_top_k_indexed(spark, sf_dir):
    """The same rows from an index of skills, without making all pairs."""
    best, _ = top.best(_requisitions(spark, sf_dir), src.team_member(spark, sf_dir), src.team_member_skill(spark, sf_dir), src.team_member_allocation(spark, sf_dir), TOP)
    return best.select("request_id", "team_member_id", "rank", "final_score", "skill_score", "experience_score", "availability_score", "is_available", scoring.fit_level(F.col("final_score")).alias("fit_level"))


@query(f"SELECT request_id, team_member_id, rank, ceil(rank / {BATCH}.0)::INT AS batch_number, ceil(n / {BATCH}.0)::INT AS total_batches, least({BATCH}, n - (ceil(rank / {BATCH}.0)::INT - 1) * {BATCH})::INT AS records_in_batch FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM rk)", *SCORES)
def match_batches(spark, sf_dir):
    return rank.batches(rank.ranked(_scored(spark, sf_dir).select("request_id", "team_member_id", "final_score"), members=src.team_member(spark, sf_dir)), BATCH).drop("final_score")


# ------------------------------------------------------------- explanations


def _matched_lists(rows: DataFrame) -> DataFrame:
    return rows.select("request_id", "team_member_id", F.array_join("skills_matched", ", ").alias("skills_matched"), F.size("mandatory_matched").alias("n_mandatory"), F.size("preferred_matched").alias("n_preferred"))


@query("SELECT request_id, team_member_id, coalesce(skills_matched, '') AS skills_matched, coalesce(nmm, 0)::INT AS n_mandatory, coalesce(npm, 0)::INT AS n_preferred FROM rk LEFT JOIN ml USING (request_id, team_member_id)", *SCORES, "ml")
def matched_skill_lists(spark, sf_dir):
    """Of every candidate, as the service gives them."""
    return _matched_lists(_explained(_scored(spark, sf_dir)))


@query(
    """SELECT request_id, team_member_id, concat_ws('; ', CASE WHEN mandatory_score >= 0.8 THEN 'Strong match on mandatory skills' END, CASE WHEN preferred_score >= 0.5 THEN 'Good match on preferred skills' END, CASE WHEN experience_score >= 0.8 THEN 'Experience level meets requirements' END, CASE WHEN is_available THEN 'Available for assignment' END) AS strengths,
    concat_ws('; ', CASE WHEN mandatory_score < 0.5 THEN 'Limited mandatory skills coverage' END, CASE WHEN preferred_score < 0.3 THEN 'Few preferred skills present' END, CASE WHEN experience_score < 0.5 THEN 'Experience may not fully meet requirements' END, CASE WHEN NOT is_available THEN 'Limited availability' END) AS gaps FROM sc""",
    *SCORES,
)
def strengths_gaps(spark, sf_dir):
    return explain.strengths_and_gaps(_scored(spark, sf_dir)).select("request_id", "team_member_id", F.array_join("strengths", "; ").alias("strengths"), F.array_join("gaps", "; ").alias("gaps"))


def _explanations(rows: DataFrame) -> DataFrame:
    return rows.select("request_id", "team_member_id", F.array_join("explanation", "\n").alias("explanation"), F.col("mandatory_skills_summary").alias("mandatory_summary"), F.col("preferred_skills_summary").alias("preferred_summary"))


@query(
    """SELECT request_id, team_member_id, printf('Overall match score: %.2f (%s fit)', final_score, fit_level) || chr(10) || CASE WHEN skills_matched <> '' THEN printf('Skills matched: %s (score: %.2f)', skills_matched, skill_score) ELSE printf('Skill match score: %.2f', skill_score) END || chr(10) ||
    printf('Experience match score: %.2f', experience_score) || chr(10) || printf('Availability: %.0f', availability_score * 100) || '% capacity (' || CASE WHEN is_available THEN 'Available' ELSE 'Limited availability' END || ')' AS explanation,
    coalesce(nmm, 0) || ' mandatory skills matched (' || printf('%.0f', mandatory_score * 100) || '% of requirements)' AS mandatory_summary, coalesce(npm, 0) || ' preferred skills matched (' || printf('%.0f', preferred_score * 100) || '% of preferences)' AS preferred_summary
    FROM rk LEFT JOIN ml USING (request_id, team_member_id)""",
    *SCORES, "ml",
)
def explanation_lines(spark, sf_dir):
    """Of every candidate, as the service gives them."""
    return _explanations(_explained(_scored(spark, sf_dir)))


@query(
    "SELECT rq.request_id, CASE WHEN max_months < min_months THEN 'PROCESSING' ELSE 'COMPLETED' END AS status, CASE WHEN max_months < min_months THEN 0 ELSE count(rank) END AS total_matches, CASE WHEN max_months < min_months THEN NULL ELSE min(team_member_id) FILTER (rank = 1) END AS best FROM rq LEFT JOIN rk r USING (request_id) GROUP BY rq.request_id, max_months, min_months",
    *SCORES,
)
def match_envelope(spark, sf_dir):
    """Every candidate counted; a requisition whose range of experience is empty is not answered."""
    asked = src.requisition(spark, sf_dir)
    done = quality.split(asked, {"experience": quality.in_order("min_months", "max_months")})[0].select("request_id")
    return plan.envelope_totals(asked, _scored(spark, sf_dir).join(done, "request_id", "left_semi"))


@query(
    """, paged AS (SELECT request_id, ceil(rank / 50.0)::INT AS page, count(*)::INT AS n_matches, string_agg(team_member_id || ' ' || rank || ' ' || fit_level || ' ' || CASE WHEN is_available THEN 'yes' ELSE 'no' END, ',' ORDER BY rank) AS matches FROM rk JOIN rq USING (request_id) WHERE coalesce(max_months >= min_months, true) GROUP BY ALL),
    n AS (SELECT request_id, sum(n_matches)::BIGINT AS total FROM paged GROUP BY 1)
    SELECT request_id, CASE WHEN total IS NULL THEN 'PROCESSING' ELSE 'COMPLETED' END AS status, coalesce(total, 0) AS total_matches, page::VARCHAR AS page, coalesce(n_matches, 0) AS n_matches, coalesce(matches, '') AS matches FROM rq LEFT JOIN n USING (request_id) LEFT JOIN paged USING (request_id)""",
    *SCORES, "rq",
)
def match_pages(spark, sf_dir):
    """The envelope with its list: every match of every requisition, in pages of fifty. Entries come without their explanation, which no column here gives (see explanation_lines)."""
    asked = src.requisition(spark, sf_dir)
    done = quality.split(asked, {"experience": quality.in_order("min_months", "max_months")})[0].select("request_id")
    scored = _scored(spark, sf_dir).join(done, "request_id", "left_semi").select("request_id", "team_member_id", "final_score", "is_available")
    ranked = rank.ranked(scored, members=src.team_member(spark, sf_dir))
    pages = plan.envelope(asked, ranked.withColumn("fit_level", scoring.fit_level(F.col("final_score"))))
    one = lambda m: F.concat_ws(" ", m["team_member_id"], m["rank"].cast("string"), m["fit_level"], F.when(m["availability_match"], "yes").otherwise("no"))
    n = F.coalesce(F.size("matches"), F.lit(0))
    return pages.select("request_id", "status", "total_matches", F.col("page").cast("string").alias("page"), F.greatest(n, F.lit(0)).alias("n_matches"), F.coalesce(F.array_join(F.transform("matches", one), ","), F.lit("")).alias("matches"))


# -------------------------------------------------------------------- audit


@query("SELECT id, request_id, node_name, token_count::VARCHAR AS token_count, created_at FROM cp WHERE request_id = '7'", "cp")
def checkpoint_log(spark, sf_dir):
    return audit.checkpoints_of(src.checkpoints(spark, sf_dir), "7").select("id", "request_id", "node_name", F.col("token_count").cast("string").alias("token_count"), "created_at")


@query("SELECT request_id, node_name, id, token_count::VARCHAR AS token_count FROM cp QUALIFY row_number() OVER (PARTITION BY request_id, node_name ORDER BY created_at DESC, id DESC) = 1", "cp")
def checkpoint_latest(spark, sf_dir):
    return audit.latest(src.checkpoints(spark, sf_dir)).select("request_id", "node_name", "id", F.col("token_count").cast("string").alias("token_count"))


@query("SELECT request_id, coalesce(sum(token_count), 0)::BIGINT AS total_tokens FROM cp GROUP BY request_id", "cp")
def token_totals(spark, sf_dir):
    return audit.token_totals(src.checkpoints(spark, sf_dir))


@query("SELECT request_id, bool_or(node_name = 'error') AS has_node FROM cp GROUP BY request_id", "cp")
def node_presence(spark, sf_dir):
    return audit.node_presence(src.checkpoints(spark, sf_dir), "error")


@query("SELECT endpoint, failed, count(*) AS n_requests FROM rm GROUP BY ALL", "rm")
def request_counters(spark, sf_dir):
    return audit.counters(src.requests(spark, sf_dir), ["endpoint", "failed"])


@query(f"SELECT endpoint, le::DOUBLE AS le, count(*) FILTER (le IS NULL OR duration <= le) AS n FROM rm CROSS JOIN (SELECT unnest([{', '.join(map(str, audit.BUCKETS))}, NULL]) AS le) GROUP BY ALL", "rm")
def latency_histogram(spark, sf_dir):
    return audit.histogram(src.requests(spark, sf_dir), "endpoint", "duration")


@query("SELECT endpoint, round(quantile_cont(duration, 0.95), 6) AS p95, round(quantile_cont(duration, 0.99), 6) AS p99 FROM rm GROUP BY endpoint", "rm")
def latency_percentiles(spark, sf_dir):
    return audit.percentiles(src.requests(spark, sf_dir), "endpoint", "duration").select("endpoint", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@query("SELECT endpoint, avg(failed::INT) AS error_rate FROM rm GROUP BY endpoint", "rm")
def error_rate(spark, sf_dir):
    return audit.error_rate(src.requests(spark, sf_dir), "endpoint", "failed")


@query("SELECT event_type AS endpoint, arg_max(value, event_id) AS duration FROM events GROUP BY event_type")
def request_gauge(spark, sf_dir):
    rows = src.table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), F.col("value").alias("duration"), "event_id")
    return audit.gauge(rows, "endpoint", "duration", "event_id")


@query("SELECT 'requests_total{endpoint=\"' || endpoint || '\"} ' || count(*) AS line FROM rm GROUP BY endpoint", "rm")
def metrics_exposition(spark, sf_dir):
    return audit.exposition(audit.counters(src.requests(spark, sf_dir), ["endpoint"]), "requests_total", "endpoint", "n_requests")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf_dir):
    return upserts.windowed_counts(src.table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(
    """SELECT request_id, node_name, n FROM (SELECT request_id, 'jd_parsing' AS node_name, 1::BIGINT AS n FROM rq UNION ALL SELECT request_id, 'skill_normalization', 1 FROM rq UNION ALL SELECT DISTINCT request_id, 'matching_scoring', 1 FROM rk UNION ALL SELECT DISTINCT request_id, 'explanation_generation', 1 FROM rk
    UNION ALL SELECT DISTINCT request_id, 'result_aggregation', 1 FROM rk UNION ALL SELECT request_id, 'error', 1 FROM rq WHERE max_months < min_months)""",
    *SCORES,
)
def pipeline_checkpoints(spark, sf_dir):
    asked, scored = _requisitions(spark, sf_dir), written(_scored(spark, sf_dir).select("request_id", "team_member_id"), "scored")  # made once for all stages
    errors = src.requisition(spark, sf_dir).select("request_id", F.when(F.col("max_months") < F.col("min_months"), "experience range is empty").alias("error_message"))
    rows = audit.pipeline_checkpoints(asked.select("request_id", "title", "role"), asked, scored, scored, errors)
    return rows.groupBy("request_id", "node_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT request_id, CASE WHEN max_months < min_months THEN 'experience range is empty' WHEN role = '' THEN 'role is missing' WHEN requisition_duration_month IS NULL THEN 'duration is missing' END AS error_message FROM rq
    WHERE max_months < min_months OR role = '' OR requisition_duration_month IS NULL""",
    "rq",
)
def pipeline_errors(spark, sf_dir):
    """What stops each requisition, where several stages found fault: the earliest one's message."""
    found = [F.when(F.col("max_months") < F.col("min_months"), "experience range is empty"), F.when(F.col("role") == "", "role is missing"), F.when(F.col("requisition_duration_month").isNull(), "duration is missing")]
    return src.requisition(spark, sf_dir).select("request_id", audit.first_error(*found).alias("error_message")).filter("error_message IS NOT NULL")


@query("SELECT id, request_id, node_name, token_count::VARCHAR AS token_count FROM cp", "cp")
def checkpoint_append(spark, sf_dir):
    """A log that is only ever appended to: first the checkpoints of errors, then all others."""
    path = shared_path(spark, "checkpoints")
    rows = src.checkpoints(spark, sf_dir).select("id", "request_id", "node_name", F.col("token_count").cast("string").alias("token_count"))
    tables.append(rows.filter("node_name = 'error'"), path)
    tables.append(rows.filter("node_name IS DISTINCT FROM 'error'"), path)
    return spark.read.parquet(path)


@query(
    """(SELECT 'request' AS what, request_id AS found FROM rq WHERE request_id = 'REQ0007') UNION ALL (SELECT 'checkpoint', id::VARCHAR FROM cp WHERE request_id = '7' ORDER BY id LIMIT 1)
    UNION ALL (SELECT 'allocation', project_id FROM al WHERE start_date = DATE '1996-01-02' ORDER BY orderkey LIMIT 1)""",
    "rq", "cp", "al",
)
def point_lookups(spark, sf_dir):
    """One row by a key, and the first by id where the column is not unique."""
    day = src.team_member_allocation(spark, sf_dir).withColumn("day", F.col("start_date").cast("string"))
    parts = [
        ("request", tables.lookup(src.requisition(spark, sf_dir), "request_id", "REQ0007", "key"), F.col("request_id")),
        ("checkpoint", tables.lookup(src.checkpoints(spark, sf_dir), "request_id", "7"), F.col("id").cast("string")),
        ("allocation", tables.lookup(day, "day", "1996-01-02", "orderkey"), F.col("project_id")),
    ]
    return reduce(DataFrame.unionByName, [row.select(F.lit(what).alias("what"), found.alias("found")) for what, row, found in parts])


@query("SELECT request_id, team_member_id, rank FROM rk JOIN rq USING (request_id) WHERE role <> ''", *SCORES, "rq")
def results_store(spark, sf_dir):
    """All results of each requisition as they are stored: written twice, the second time over the first, and cleared for those without a role."""
    path, asked = shared_path(spark, "results"), src.requisition(spark, sf_dir)
    every = rank.ranked(_scored(spark, sf_dir).select("request_id", "team_member_id", "final_score"), members=src.team_member(spark, sf_dir)).select("request_id", "team_member_id", "rank")
    tables.store_results(asked.select("request_id", F.lit("stale").alias("team_member_id"), F.lit(0).alias("rank")), path)
    tables.store_results(every, path)
    tables.clear_results(spark, path, asked.filter("role = ''"))
    return tables.read_results(spark, path)


# ---------------------------------------------------- requests and validity


def _payload(spark, sf_dir) -> DataFrame:
    skills = normalize.skill_lists(src.requisition_skill(spark, sf_dir).withColumn("skill_id", F.col("raw_skill")))
    rows = src.requisition(spark, sf_dir).join(skills, "request_id", "left")
    return rows.select("request_id", F.struct(F.col("title").alias("title"), F.col("min_months").alias("min_months"), F.col("expected_start_date").alias("start"), fn.default_list(F.col("preferred")).alias("preferred"), F.concat(F.col("role"), F.lit(' é "q"\\')).alias("role")).alias("p"))


@query(
    """SELECT request_id, sha256('{"min_months": ' || coalesce(min_months::VARCHAR, 'null') || ', "preferred": [' || coalesce(pref, '') || '], "role": "' || role || ' \\u00e9 \\"q\\"\\\\", "start": "' || expected_start_date || '", "title": "' || title || '"}') AS payload_hash
    FROM rq LEFT JOIN (SELECT 'REQ' || lpad(n_nationkey::VARCHAR, 4, '0') AS request_id, string_agg('"' || CASE WHEN p_partkey % 5 = 3 THEN ' \\t' || p_name || ' ' ELSE p_name END || '"', ', ' ORDER BY p_partkey) AS pref
    FROM nation JOIN part ON p_partkey >= 5 * n_nationkey + 3 AND p_partkey < 5 * n_nationkey + CASE WHEN n_nationkey % 7 = 0 THEN 3 ELSE 5 END GROUP BY 1) USING (request_id)""",
    "rq",
)
def payload_hash(spark, sf_dir):
    rows = _payload(spark, sf_dir)
    return rows.select("request_id", fn.payload_hash(fn.canonical_json(F.col("p"), rows.schema["p"].dataType)).alias("payload_hash"))


@query("SELECT team_member_id, 'CORR-20240102030405-' || substring(team_member_id, 1, 8) AS correlation_id FROM tm", "tm")
def correlation_id(spark, sf_dir):
    return src.team_member(spark, sf_dir).select("team_member_id", fn.correlation_id(F.col("team_member_id"), F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("correlation_id"))


_FAULTY = "SELECT c_custkey AS k, CASE WHEN c_custkey % 23 <> 0 THEN c_name END AS full_name, CASE WHEN c_custkey % 11 = 0 THEN 'gone' ELSE 'active' END AS team_member_status, (c_custkey % 50 - 2)::INT AS experience_in_months FROM customer"


@query(f"SELECT k, concat_ws(',', CASE WHEN full_name IS NULL THEN 'full_name' END, CASE WHEN team_member_status = 'gone' THEN 'status' END, CASE WHEN experience_in_months < 0 THEN 'experience_in_months' END) AS broken FROM ({_FAULTY}) WHERE full_name IS NULL OR team_member_status = 'gone' OR experience_in_months < 0")
def quality_rejects(spark, sf_dir):
    k = F.col("c_custkey")
    rows = src.table(spark, sf_dir, "customer").select(k.alias("k"), src.member_id(k).alias("team_member_id"), F.when(k % 23 != 0, F.col("c_name")).alias("full_name"), F.when(k % 11 == 0, "gone").otherwise("active").alias("team_member_status"), (k % 50 - 2).cast("int").alias("experience_in_months"))
    return quality.split(rows, quality.MEMBER_RULES)[1].select("k", F.array_join("broken", ",").alias("broken"))


@query("SELECT request_id, max_months < min_months AS empty_range FROM rq WHERE max_months < min_months", "rq")
def requisition_rejects(spark, sf_dir):
    rows = src.requisition(spark, sf_dir)
    bad = quality.check(rows, {"experience": quality.in_order("min_months", "max_months")}).filter(F.size("broken") > 0)
    return bad.select("request_id", F.lit(True).alias("empty_range"))


def _incoming(spark, sf_dir) -> DataFrame:
    """A request for each event; of forty ids twenty-five are those of nations, so both known and new ones come at every scale."""
    return src.table(spark, sf_dir, "events").select(F.concat(F.lit("REQ"), F.lpad((F.col("event_id") % 40).cast("string"), 4, "0")).alias("request_id"), "event_id")


_IN = "inc AS (SELECT 'REQ' || lpad((event_id % 40)::VARCHAR, 4, '0') AS request_id, event_id FROM events)"


@query(f"WITH {CTES['rq']}, {_IN} SELECT request_id, event_id FROM inc WHERE request_id IN (SELECT request_id FROM rq)")
def duplicate_requests(spark, sf_dir):
    return quality.known_requests(_incoming(spark, sf_dir), src.requisition(spark, sf_dir)).select("request_id", "event_id")


@query(f"WITH {CTES['rq']}, {_IN} SELECT request_id, event_id FROM inc WHERE request_id NOT IN (SELECT request_id FROM rq)")
def new_requests(spark, sf_dir):
    return quality.new_requests(_incoming(spark, sf_dir), src.requisition(spark, sf_dir)).select("request_id", "event_id")


@query(
    """SELECT 'team_member_allocation' AS child, 'team_member' AS parent, project_id AS id FROM al WHERE team_member_id NOT IN (SELECT team_member_id FROM tm WHERE is_active)
    UNION ALL SELECT 'team_member_skill', 'team_member', team_member_id || '/' || skill_id FROM ms WHERE team_member_id NOT IN (SELECT team_member_id FROM tm WHERE is_active)
    UNION ALL SELECT 'team_member_skill', 'skill_master', team_member_id || '/' || skill_id FROM ms WHERE skill_id NOT IN (SELECT skill_id FROM sm WHERE category_name <> 'ring')
    UNION ALL SELECT 'skill_certification', 'team_member_skill', l_orderkey || '/' || l_linenumber FROM ol ANTI JOIN (SELECT * FROM ms WHERE NOT is_deleted) USING (team_member_id, skill_id)
    UNION ALL SELECT 'checkpoints', 'requisition_requests', id::VARCHAR FROM cp WHERE request_id NOT IN (SELECT key::VARCHAR FROM rq)
    UNION ALL SELECT 'skill_master', 'category_master', skill_id FROM sm WHERE category_name NOT IN ('ring', 'bolt')""",
    "tm", "sm", "ol", "ms", "al", "cp", "rq",
)
def fk_orphans(spark, sf_dir):
    """Rows that point to nothing, over six of the relationships: whole tables against parents of which some are gone (inactive members, deleted skills, missing categories)."""
    active = src.team_member(spark, sf_dir).filter("is_active")
    lines = written(src.order_lines(spark, sf_dir).select("custkey", "team_member_id", "skill_id", "l_linenumber", "l_partkey", "l_orderkey"), "lines")  # joined once for three of the relationships
    allocations, skills, dictionary = src.team_member_allocation(spark, sf_dir), written(src.team_member_skill(spark, sf_dir, lines), "skills"), src.skill_master(spark, sf_dir)
    held = F.concat_ws("/", "team_member_id", "skill_id")
    certified = lines.withColumn("id", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    categories = spark.createDataFrame([("ring",), ("bolt",)], "category_name string")
    requests = src.requisition(spark, sf_dir).select(F.col("key").cast("string").alias("request_id"))
    parts = [
        ("team_member_allocation", "team_member", allocations, ["team_member_id"], active, F.col("project_id")),
        ("team_member_skill", "team_member", skills, ["team_member_id"], active, held),
        ("team_member_skill", "skill_master", skills, ["skill_id"], dictionary.filter("category_name <> 'ring'"), held),
        ("skill_certification", "team_member_skill", certified, ["team_member_id", "skill_id"], skills.filter("NOT is_deleted"), F.col("id")),
        ("checkpoints", "requisition_requests", src.checkpoints(spark, sf_dir), ["request_id"], requests, F.col("id").cast("string")),
        ("skill_master", "category_master", dictionary, ["category_name"], categories, F.col("skill_id")),
    ]
    found = [quality.orphans(child, keys, parent, keys).select(F.lit(name).alias("child"), F.lit(of).alias("parent"), row.alias("id")) for name, of, child, keys, parent, row in parts]
    return reduce(DataFrame.unionByName, found)


# ------------------------------------------------------------------ upserts


# Of each table two thirds are stored and two thirds come in the batch, so each row is kept, updated or inserted, and none is left out.


def _member_merge(spark, sf_dir) -> DataFrame:
    k = F.col("custkey")
    members = src.team_member(spark, sf_dir)
    first = members.filter("custkey % 3 <> 1").select("team_member_id", F.lit(0).alias("pos"), F.lit("NEW").alias("designation"), (k % 100).cast("int").alias("experience_in_months"), F.lit(True).alias("is_active"))
    again = members.filter("custkey % 15 = 0").select("team_member_id", F.lit(1).alias("pos"), F.lit(None).cast("string").alias("designation"), (k % 50).cast("int").alias("experience_in_months"), F.lit(False).alias("is_active"))
    new = upsert.last_wins(first.unionByName(again), ["team_member_id"], ["pos"])
    return upsert.merge(members.filter("custkey % 3 <> 0"), new, ["team_member_id"], ["designation", "experience_in_months", "is_active"])


_MEMBERS_SQL = """old AS (SELECT * FROM tm WHERE custkey % 3 <> 0), new AS (SELECT team_member_id, CASE WHEN custkey % 15 <> 0 THEN 'NEW' END AS designation, (CASE WHEN custkey % 15 = 0 THEN custkey % 50 ELSE custkey % 100 END)::INT AS experience_in_months, custkey % 15 <> 0 AS is_active FROM tm WHERE custkey % 3 <> 1),
    mm AS (SELECT coalesce(n.team_member_id, o.team_member_id) AS team_member_id, CASE WHEN n.team_member_id IS NULL THEN o.designation ELSE n.designation END AS designation, CASE WHEN n.team_member_id IS NULL THEN o.experience_in_months ELSE n.experience_in_months END AS experience_in_months,
    CASE WHEN n.team_member_id IS NULL THEN o.is_active ELSE n.is_active END AS is_active, CASE WHEN n.team_member_id IS NULL THEN 'kept' WHEN o.team_member_id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM old o FULL JOIN new n USING (team_member_id))"""
CTES["mm"] = _MEMBERS_SQL


@query("SELECT * REPLACE (experience_in_months::VARCHAR AS experience_in_months) FROM mm", "tm", "mm")
def upsert_members(spark, sf_dir):
    return _member_merge(spark, sf_dir).withColumn("experience_in_months", F.col("experience_in_months").cast("string"))


def _skill_merge(spark, sf_dir) -> DataFrame:
    old = src.team_member_skill(spark, sf_dir).filter("custkey % 3 <> 0")
    batch = src.order_lines(spark, sf_dir).filter("custkey % 3 = 0 OR l_orderkey % 3 <> 1").select("team_member_id", "skill_id", F.col("l_linenumber").alias("rating"), (F.col("l_partkey") % 2 == 0).alias("is_deleted"), "l_orderkey", "l_partkey")
    new = upsert.last_wins(batch, ["team_member_id", "skill_id"], ["l_orderkey", "l_partkey", "rating"])
    return upsert.merge(old, new, ["team_member_id", "skill_id"], ["rating", "is_deleted"])


CTES["sk"] = """so AS (SELECT * FROM ms WHERE custkey % 3 <> 0), sn AS (SELECT team_member_id, skill_id, l_linenumber AS rating, l_partkey % 2 = 0 AS is_deleted FROM ol WHERE custkey % 3 = 0 OR l_orderkey % 3 <> 1 QUALIFY row_number() OVER (PARTITION BY team_member_id, skill_id ORDER BY l_orderkey DESC, l_partkey DESC, l_linenumber DESC) = 1),
    sk AS (SELECT coalesce(n.team_member_id, o.team_member_id) AS team_member_id, coalesce(n.skill_id, o.skill_id) AS skill_id, coalesce(n.rating, o.rating) AS rating, coalesce(n.is_deleted, o.is_deleted) AS is_deleted, CASE WHEN n.skill_id IS NULL THEN 'kept' WHEN o.skill_id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM so o FULL JOIN sn n USING (team_member_id, skill_id))"""


@query("SELECT * FROM sk", "ol", "ms", "sk")
def upsert_skills(spark, sf_dir):
    return _skill_merge(spark, sf_dir)


def _allocation_merge(spark, sf_dir) -> DataFrame:
    rows = src.team_member_allocation(spark, sf_dir)
    new = rows.filter("orderkey % 3 <> 1").withColumn("allocation_percentage", F.when((F.col("orderkey") % 9).isin(0, 2), None).otherwise(F.lit(10).cast("decimal(5,2)")))
    return upsert.merge(rows.filter("orderkey % 3 <> 0"), new, ["team_member_id", "project_id"], ["allocation_percentage", "start_date", "end_date", "billable", "is_deleted"])


CTES["am"] = """ao AS (SELECT * FROM al WHERE orderkey % 3 <> 0), an AS (SELECT * REPLACE (CASE WHEN orderkey % 9 NOT IN (0, 2) THEN 10::DECIMAL(5,2) END AS allocation_percentage) FROM al WHERE orderkey % 3 <> 1),
    am AS (SELECT coalesce(n.team_member_id, o.team_member_id) AS team_member_id, coalesce(n.project_id, o.project_id) AS project_id, CASE WHEN n.project_id IS NULL THEN o.allocation_percentage ELSE n.allocation_percentage END AS allocation_percentage, coalesce(n.start_date, o.start_date) AS start_date, coalesce(n.end_date, o.end_date) AS end_date,
    coalesce(n.billable, o.billable) AS billable, coalesce(n.is_deleted, o.is_deleted) AS is_deleted, CASE WHEN n.project_id IS NULL THEN 'kept' WHEN o.project_id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM ao o FULL JOIN an n USING (team_member_id, project_id))"""


@query("SELECT team_member_id, project_id, allocation_percentage::DOUBLE AS allocation_percentage, start_date::DATE::VARCHAR AS start_date, end_date::DATE::VARCHAR AS end_date, billable, is_deleted, action FROM am", "al", "am")
def upsert_allocations(spark, sf_dir):
    casts = {"allocation_percentage": F.col("allocation_percentage").cast("double"), "start_date": F.col("start_date").cast("string"), "end_date": F.col("end_date").cast("string")}
    return _allocation_merge(spark, sf_dir).withColumns(casts)


@query(
    """SELECT coalesce(n.cid, o.cid) AS certification_id, CASE WHEN n.cid IS NULL THEN 'old' ELSE 'new' END AS issuer, coalesce(o.team_member_id, n.team_member_id) AS team_member_id, CASE WHEN n.cid IS NULL THEN 'kept' WHEN o.cid IS NULL THEN 'inserted' ELSE 'updated' END AS action
    FROM (SELECT 'C' || orderkey AS cid, team_member_id FROM al WHERE orderkey % 3 <> 0) o FULL JOIN (SELECT 'C' || orderkey AS cid, 'TM-OTHER' AS team_member_id FROM al WHERE orderkey % 3 <> 1 AND orderkey % 60 <> 0) n USING (cid)
    UNION ALL SELECT NULL, 'new', 'TM-OTHER', 'inserted' FROM al WHERE orderkey % 60 = 0""",
    "al",
)
def upsert_certifications(spark, sf_dir):
    rows = src.team_member_allocation(spark, sf_dir)

    def certs(keep: str, issuer: str, who, cid) -> DataFrame:
        return rows.filter(keep).select(cid.alias("certification_id"), F.lit("c").alias("certificate"), F.lit(issuer).alias("issuer"), F.col("start_date").alias("issued_date"), F.col("end_date").alias("valid_till"), who.alias("team_member_id"), F.lit("S").alias("skill_id"))

    cid = F.concat(F.lit("C"), F.col("orderkey").cast("string"))
    old = certs("orderkey % 3 <> 0", "old", F.col("team_member_id"), cid)
    new = certs("orderkey % 3 <> 1", "new", F.lit("TM-OTHER"), F.when(F.col("orderkey") % 60 != 0, cid))
    return upsert.merge_certifications(old, new).select("certification_id", "issuer", "team_member_id", "action")


@query(
    """SELECT category_id::INT AS category_id, category_name FROM (SELECT 4 + row_number() OVER (ORDER BY min(first_part), category_name) AS category_id, category_name FROM sm WHERE category_name NOT IN ('ring', 'bolt') GROUP BY category_name)""",
    "sm",
)
def category_id_assign(spark, sf_dir):
    """Ids for the categories that a dictionary of 'ring' (1) and 'bolt' (4) lacks."""
    have = spark.createDataFrame([(1, "ring"), (4, "bolt")], "category_id int, category_name string")
    return upsert.new_ids(src.skill_master(spark, sf_dir), have, "category_id", "category_name", "first_part")


@query("SELECT skill_id, skill_name, CASE WHEN category_name = 'ring' THEN 1 WHEN category_name = 'bolt' THEN 4 ELSE 1 END::INT AS category_id FROM sm WHERE first_part % 2 = 1 UNION ALL SELECT skill_id, 'kept', 9 FROM sm WHERE first_part % 2 = 0", "sm")
def skill_auto_create(spark, sf_dir):
    rows = src.skill_master(spark, sf_dir)
    have = spark.createDataFrame([(1, "ring"), (4, "bolt")], "category_id int, category_name string")
    known = rows.filter("first_part % 2 = 0").select("skill_id", F.lit("kept").alias("skill_name"), F.lit(9).alias("category_id"))
    return upsert.add_skills(known, rows.withColumn("pos", F.col("first_part")), have)


@query(
    """SELECT (SELECT count(*) FROM tm WHERE custkey % 3 <> 1) AS members_received, (SELECT count(*) FROM mm WHERE action = 'inserted') AS members_inserted, (SELECT count(*) FROM mm WHERE action = 'updated') AS members_updated, (SELECT count(*) FROM sk WHERE action = 'inserted') AS skills_inserted,
    (SELECT count(*) FROM sk WHERE action = 'updated') AS skills_updated, (SELECT count(*) FROM am WHERE action = 'inserted') AS allocations_inserted, (SELECT count(*) FROM am WHERE action = 'updated') AS allocations_updated""",
    "tm", "ol", "ms", "al", "mm", "sk", "am",
)
def upsert_summary(spark, sf_dir):
    merged = {"members": _member_merge(spark, sf_dir), "skills": _skill_merge(spark, sf_dir), "allocations": _allocation_merge(spark, sf_dir)}
    return upsert.summary(merged, src.team_member(spark, sf_dir).filter("custkey % 3 <> 1"))


@query("SELECT request_id, (CASE WHEN key % 2 = 0 THEN 3 ELSE 1 END)::INT AS status, CASE WHEN key % 4 = 0 THEN TIMESTAMP '2024-05-05 00:00:00' WHEN key % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS completed_at FROM rq", "rq")
def status_update(spark, sf_dir):
    changes = src.requisition(spark, sf_dir).filter("key % 2 = 0").select("request_id", F.lit(3).alias("new_status"), F.when(F.col("key") % 4 == 0, F.lit("2024-05-05 00:00:00").cast("timestamp_ntz")).alias("new_completed_at"))
    return upsert.update_status(src.status_requests(spark, sf_dir), changes)


@query("SELECT team_member_id, designation FROM tm WHERE NOT team_member_id LIKE 'TM0000%7_'", "tm")
def pattern_delete(spark, sf_dir):
    return upsert.delete_like(src.team_member(spark, sf_dir), "team_member_id", "TM0000%7_").select("team_member_id", "designation")


_PATTERNS = ("TM0000%7_", "TM%", "TEST-%")


@query("SELECT pattern, (SELECT count(*) FROM tm WHERE team_member_id LIKE pattern) AS n FROM (VALUES " + ", ".join(f"('{p}')" for p in _PATTERNS) + ") v(pattern)", "tm")
def delete_counts(spark, sf_dir):
    """A dry run: how many members each pattern would delete."""
    members = src.team_member(spark, sf_dir)
    counts = [(p, upsert.guarded_delete(members, upsert.delete_like(members, "team_member_id", p))[1]) for p in _PATTERNS]
    return spark.createDataFrame(counts, "pattern string, n long")


@query("SELECT event_id, props FROM events WHERE coalesce(json_extract_string(props, '$.k') <> '69', true)")
def json_flag_delete(spark, sf_dir):
    return upsert.delete_flagged(src.table(spark, sf_dir, "events"), "props", "k", "69").select("event_id", "props")


# --------------------------------------------------- documents and streams


def _batches(spark, sf_dir, faulty: bool = False) -> DataFrame:
    """Members with skills, certifications and allocations as JSON batches, 100 members each. faulty: with entries that break rules."""
    k, o = F.col("custkey"), F.col("orderkey")
    held = src.team_member_skill(spark, sf_dir)
    number = F.when(F.col("rating") == 6, F.concat_ws("/", "team_member_id", "skill_id"))  # of five and less no certification, of seven one without a number
    certs = F.when(F.col("rating") > 5, F.array(F.struct(number.alias("certification_id"), F.concat(F.lit("about "), "skill_id").alias("certificate"), F.lit("board").alias("issuer"))))
    rating = ((k + F.col("rating")) % 13).cast("int") if faulty else F.col("rating")
    name = F.when(k % 17 != 0, F.col("skill_id")) if faulty else F.col("skill_id")
    skills = held.groupBy("team_member_id").agg(F.array_sort(F.collect_list(F.struct("skill_id", name.alias("skill_name"), rating.alias("rating"), F.lit("general").alias("category"), "is_deleted", certs.alias("certifications")))).alias("skills"))
    project = F.when(o % 19 != 0, F.col("project_id")) if faulty else F.col("project_id")
    percentage = (o % 150).cast("double") if faulty else F.col("allocation_percentage").cast("double")
    allocations = src.team_member_allocation(spark, sf_dir).groupBy("team_member_id").agg(F.array_sort(F.collect_list(F.struct(project.alias("project_id"), percentage.alias("allocation_percentage"), "start_date", "end_date", "billable", "is_deleted"))).alias("allocations"))
    members = src.team_member(spark, sf_dir).join(skills, "team_member_id", "left").join(allocations, "team_member_id", "left")
    member = F.struct("team_member_id", F.when(F.col("is_active"), "active").otherwise("inactive").alias("team_member_status"), F.coalesce("experience_in_months", F.lit(0)).alias("experience_in_months"), "full_name", "designation", F.upper("work_type").alias("work_type"), "allocations", "skills")
    number = F.expr("custkey div 100").cast("int")
    rows = members.groupBy(number.alias("n")).agg(F.array_sort(F.collect_list(member)).alias("team_members"))
    return rows.select(F.to_json(F.struct(F.struct(F.concat(F.lit("B"), F.col("n").cast("string")).alias("batch_id"), F.col("n").alias("batch_number")).alias("metadata"), "team_members", F.lit("ignored").alias("unknown_key"))).alias("value"))


@query("SELECT team_member_id, skill_id, rating, 'B' || (custkey // 100) AS batch_id FROM ms JOIN tm USING (custkey, team_member_id)", "tm", "ol", "ms")
def json_ingest(spark, sf_dir):
    """Batches written as JSON lines, read with their schema, and taken apart."""
    path = shared_path(spark, "batches")
    _batches(spark, sf_dir).write.text(path, compression="gzip")
    members = documents.members(documents.read_batches(spark, path))
    rows = documents.skills(members.filter("skills IS NOT NULL"))
    return rows.join(members.select("team_member_id", "batch_id"), "team_member_id").select("team_member_id", "skill_id", "rating", "batch_id")


@query(
    """SELECT team_member_id, is_active, coalesce(experience_in_months, 0) AS experience_in_months, work_type, CASE WHEN custkey % 2 = 0 THEN 'updated' ELSE 'inserted' END AS action FROM tm""",
    "tm",
)
def bulk_upsert(spark, sf_dir):
    """The JSON batches over tables that hold every other member."""
    path = shared_path(spark, "batches")
    _batches(spark, sf_dir).write.text(path, compression="gzip")
    none = {name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}
    k = src.team_member(spark, sf_dir).filter("custkey % 2 = 0")
    old = k.select("team_member_id", "designation", F.lit("x").alias("profile_type"), F.lit(False).alias("is_active"), F.lit(1).alias("experience_in_months"), F.lit("x").alias("base_location"), "work_type", F.lit("x").alias("profile_url"))
    out = ingest.bulk_upsert(documents.read_batches(spark, path), none | {"team_member": old})
    return out["team_member"].select("team_member_id", "is_active", "experience_in_months", "work_type", "action")


def _bulk(spark, sf_dir, faulty: bool = False, **stored: DataFrame) -> dict[str, DataFrame]:
    """The tables after the batches, over what is stored (nothing by default)."""
    path = shared_path(spark, "batches")
    _batches(spark, sf_dir, faulty).write.text(path, compression="gzip")
    none = {name: spark.createDataFrame([], schema) for name, schema in schemas.TABLES.items()}
    return ingest.bulk_upsert(documents.read_batches(spark, path), none | stored)


@query("SELECT team_member_id, skill_id, rating, is_deleted, CASE WHEN custkey % 3 = 0 THEN 'updated' ELSE 'inserted' END AS action FROM ms UNION ALL SELECT team_member_id, 'GONE', 9, true, 'kept' FROM tm", "tm", "ol", "ms")
def bulk_upsert_skills(spark, sf_dir):
    """Over a table with every third member's skills and one of each member that no batch knows."""
    old = src.team_member_skill(spark, sf_dir).filter("custkey % 3 = 0").select("team_member_id", "skill_id", F.lit(0).alias("rating"), F.lit(1).alias("experience_in_months"), F.lit(False).alias("is_deleted"))
    others = src.team_member(spark, sf_dir).select("team_member_id", F.lit("GONE").alias("skill_id"), F.lit(9).alias("rating"), F.lit(1).alias("experience_in_months"), F.lit(True).alias("is_deleted"))
    return _bulk(spark, sf_dir, team_member_skill=old.unionByName(others))["team_member_skill"].select("team_member_id", "skill_id", "rating", "is_deleted", "action")


@query("SELECT team_member_id, project_id, allocation_percentage::DOUBLE AS allocation_percentage, start_date::DATE::VARCHAR AS start_date, end_date::DATE::VARCHAR AS end_date, billable, is_deleted, 'inserted' AS action FROM al", "al")
def bulk_upsert_allocations(spark, sf_dir):
    casts = {"allocation_percentage": F.col("allocation_percentage").cast("double"), "start_date": F.col("start_date").cast("string"), "end_date": F.col("end_date").cast("string")}
    return _bulk(spark, sf_dir)["team_member_allocation"].drop("batch").withColumns(casts)


@query(
    """SELECT CASE WHEN rating = 6 THEN team_member_id || '/' || skill_id END AS certification_id, 'about ' || skill_id AS certificate, CASE WHEN rating = 6 AND custkey % 2 = 0 THEN 'TM-OTHER' ELSE team_member_id END AS team_member_id, CASE WHEN rating = 6 AND custkey % 2 = 0 THEN 'updated' ELSE 'inserted' END AS action FROM ms WHERE rating > 5""",
    "ol", "ms",
)
def bulk_upsert_certifications(spark, sf_dir):
    """Over those of every other member, which someone else holds; without a number a certification always comes in anew."""
    text = lambda v: F.lit(v).cast("string")
    day = F.lit(None).cast("date")
    old = src.team_member_skill(spark, sf_dir).filter("rating = 6 AND custkey % 2 = 0").select(F.concat_ws("/", "team_member_id", "skill_id").alias("certification_id"), text("TM-OTHER").alias("team_member_id"), text("S").alias("skill_id"), text("old").alias("certificate"), text("old").alias("issuer"), day.alias("issued_date"), day.alias("valid_till"))
    return _bulk(spark, sf_dir, skill_certification=old)["skill_certification"].select("certification_id", "certificate", "team_member_id", "action")


@query("SELECT skill_id, skill_id AS skill_name, 2 AS category_id FROM (SELECT DISTINCT skill_id FROM ms) UNION ALL SELECT 'KNOWN', 'known', 7", "ol", "ms")
def bulk_upsert_dictionary(spark, sf_dir):
    """Unknown skills come into the dictionary, with their category (the first new id after General)."""
    known = spark.createDataFrame([("KNOWN", "known", 7)], "skill_id string, skill_name string, category_id int")
    return _bulk(spark, sf_dir, skill_master=known)["skill_master"]


_FAULTS = """fs AS (SELECT team_member_id, skill_id, (custkey + rating) % 13 AS rating, custkey % 17 = 0 AS nameless FROM ms), fa AS (SELECT team_member_id, CASE WHEN orderkey % 19 <> 0 THEN project_id END AS project_id, orderkey % 150 AS percentage FROM al)"""
CTES["faults"] = _FAULTS


@query(
    """SELECT 'skill' AS kind, team_member_id, skill_id AS id, concat_ws(',', CASE WHEN nameless THEN 'skill_name' END, CASE WHEN rating NOT BETWEEN 1 AND 10 THEN 'rating' END) AS broken FROM fs WHERE nameless OR rating NOT BETWEEN 1 AND 10
    UNION ALL SELECT 'allocation', team_member_id, project_id, concat_ws(',', CASE WHEN project_id IS NULL THEN 'project_id' END, CASE WHEN percentage > 100 THEN 'allocation_percentage' END) FROM fa WHERE project_id IS NULL OR percentage > 100""",
    "ol", "ms", "al", "faults",
)
def bulk_rejects(spark, sf_dir):
    """Skills and allocations of valid members that break a rule, with the rules."""
    out = _bulk(spark, sf_dir, faulty=True)
    part = lambda kind, key: out[f"rejected_{kind}s"].select(F.lit(kind).alias("kind"), "team_member_id", F.col(key).alias("id"), F.array_join("broken", ",").alias("broken"))
    return part("skill", "skill_id").unionByName(part("allocation", "project_id"))


@query(
    """SELECT (SELECT count(*) FROM tm) AS members_received, (SELECT count(*) FROM tm) AS members_inserted, 0::BIGINT AS members_updated, (SELECT count(*) FROM fs WHERE NOT nameless AND rating BETWEEN 1 AND 10) AS skills_inserted, 0::BIGINT AS skills_updated, (SELECT count(*) FROM fa WHERE project_id IS NOT NULL AND percentage <= 100) AS allocations_inserted, 0::BIGINT AS allocations_updated,
    0::BIGINT AS failed, (SELECT count(*) FROM fs WHERE nameless OR rating NOT BETWEEN 1 AND 10) AS skills_failed, (SELECT count(*) FROM fa WHERE project_id IS NULL OR percentage > 100) AS allocations_failed""",
    "tm", "ol", "ms", "al", "faults",
)
def bulk_upsert_summary(spark, sf_dir):
    """The counts of a batch with entries that break rules."""
    out = _bulk(spark, sf_dir, faulty=True)["summary"].drop("unreadable_batches")
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query(
    """SELECT request_id, CASE WHEN key % 3 = 2 THEN 'unknown_version' WHEN key % 3 = 1 THEN '1.1' ELSE '1.0' END AS version, CASE WHEN key % 3 <> 2 THEN title END AS title, CASE WHEN key % 3 <> 2 THEN min_months::VARCHAR END AS min_months, coalesce(n, 0) AS n_mandatory
    FROM rq LEFT JOIN (SELECT request_id, count(DISTINCT skill_id)::INT AS n FROM rs JOIN rq USING (request_id) WHERE kind = 'mandatory' AND key % 3 <> 2 GROUP BY 1) USING (request_id)""",
    "rq", "rs",
)
def requisition_versions(spark, sf_dir):
    """Requisitions of two schema versions, and of one that nobody can read, in one file and read into one table."""
    rows = _payloads(spark, sf_dir)
    job = F.col("job_description")
    one = rows.withColumn("schema_version", F.lit("1.0")).select("request_id", F.to_json(F.struct(*[c for c in rows.columns if c != "schema_version"], "schema_version")).alias("value"))
    mark = lambda required: lambda s: F.struct(s.alias("name"), F.lit(required).alias("required"))
    skills = F.concat(F.transform(job["mandatory_skills"], mark(True)), F.transform(job["preferred_skills"], mark(False)))
    newer = F.struct(job["title"].alias("title"), job["role"].alias("role"), job["priority"].alias("priority"), skills.alias("skills"), job["experience"]["min_months"].alias("min_experience_months"), job["experience"]["max_months"].alias("max_experience_months"), job["expected_start_date"].alias("expected_start_date"), job["requisition_duration_month"].alias("requisition_duration_month"))
    two = lambda version: rows.select("request_id", F.to_json(F.struct("request_id", F.lit(version).alias("schema_version"), "source_system", newer.alias("job_description"))).alias("value"))
    part = F.substring("request_id", -4, 4).cast("int") % 3
    path = shared_path(spark, "requisitions")
    reduce(DataFrame.unionByName, [df.filter(part == i).select("value") for i, df in enumerate([one, two("1.1"), two("9")])]).write.text(path)
    read = documents.read_versions(spark.read.text(path), documents.REQUISITION_READERS)
    request_id = F.coalesce("request_id", F.get_json_object("line", "$.request_id"))
    return read.select(request_id.alias("request_id"), F.coalesce("unreadable", "schema_version").alias("version"), job["title"].alias("title"), job["experience"]["min_months"].cast("string").alias("min_months"), F.coalesce(F.size(F.array_distinct(F.transform(job["mandatory_skills"], lambda s: F.upper(fn.strip(s))))), F.lit(0)).alias("n_mandatory"))


def _payloads(spark, sf_dir) -> DataFrame:
    """The requisitions as payloads."""
    lists = normalize.skill_lists(src.requisition_skill(spark, sf_dir).withColumn("skill_id", F.col("raw_skill")))
    none = F.array().cast("array<string>")
    job = F.struct(
        F.lit("client").alias("client_name"), "title", "role", F.lit("").alias("jd_text"), "requisition_duration_month", "expected_start_date", F.lit("LOW").alias("priority"), none.alias("location"), none.alias("work_mode"),
        F.struct("min_months", "max_months").alias("experience"), F.coalesce("mandatory", none).alias("mandatory_skills"), F.coalesce("preferred", none).alias("preferred_skills"),
    ).alias("job_description")
    meta = F.lit(None).cast("struct<submitted_by: string, submitted_at: timestamp, department: string>").alias("metadata")
    return src.requisition(spark, sf_dir).join(lists, "request_id", "left").select("request_id", F.lit("1").alias("schema_version"), F.lit("t").alias("source_system"), F.lit("").alias("client_name"), job, meta)


@query(
    """SELECT request_id, 3 AS status, count(*) AS n_matches, min(team_member_id) FILTER (rank = 1) AS best FROM rk JOIN rq USING (request_id) WHERE coalesce(max_months >= min_months, true) GROUP BY request_id
    UNION ALL SELECT 'UNREADABLE', 4, 0, NULL UNION ALL SELECT 'RUNNING', 2, 0, NULL""",
    *SCORES, "rq",
)
def dispatched_requests(spark, sf_dir):
    """Requisitions that are registered and then matched in the background: each request's status and how many stored results it has."""
    registered, _, _ = plan.register(_payloads(spark, sf_dir), spark.createDataFrame([("taken",)], "request_id string"), "2024-01-02 03:04:05")
    columns = ["request_id", "status", "payload_json", "completed_at"]
    requests = written(registered, "requests").withColumn("completed_at", F.lit(None).cast("timestamp")).select(*columns).unionByName(spark.createDataFrame([("UNREADABLE", 1, "{", None), ("RUNNING", 2, "{}", None)], "request_id string, status int, payload_json string, completed_at timestamp"))
    members, skills, allocations = src.team_member(spark, sf_dir), src.team_member_skill(spark, sf_dir), src.team_member_allocation(spark, sf_dir)
    found, after, _ = plan.process_pending(requests, src.skill_master(spark, sf_dir), members, skills, allocations, "2024-01-02 03:05:00")
    path = shared_path(spark, "results")
    tables.store_results(found.select("request_id", "team_member_id", "rank"), path)
    stored = tables.read_results(spark, path).groupBy("request_id").agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.when(F.col("rank") == 1, F.col("team_member_id"))).alias("best"))
    return after.join(stored, "request_id", "left").select("request_id", "status", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), "best")


@query(
    """, said AS (SELECT DISTINCT 'REQ' || lpad(n_nationkey::VARCHAR, 4, '0') AS request_id, upper(replace(p_name, ' ', '_')) AS skill_id FROM nation JOIN part ON p_partkey >= 3 * n_nationkey AND p_partkey < 3 * n_nationkey + 12)
    SELECT request_id, kind, count(*) AS n FROM rs GROUP BY ALL UNION ALL SELECT request_id, 'from_text', count(*) FROM said ANTI JOIN rs USING (request_id, skill_id) GROUP BY ALL""",
    "rq", "rs",
)
def skills_of_text_and_lists(spark, sf_dir):
    """Each requisition's listed skills, united with those of the whole dictionary that its text names and it does not list."""
    dictionary, raw = src.skill_master(spark, sf_dir), src.requisition_skill(spark, sf_dir)
    nation = src.table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j"))
    said = nation.join(src.table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("n_nationkey") * 3 + F.col("j"))
    names = F.array_join(F.array_sort(F.collect_list(F.concat(F.initcap("p_name"), F.lit(", daily")))), "; ")
    texts = said.groupBy(F.concat(F.lit("REQ"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("request_id")).agg(F.concat(F.lit("We use "), names, F.lit(".")).alias("text"))
    both = normalize.with_text_skills(raw, texts.withColumn("text", F.regexp_replace("text", r"\.$", " .")), dictionary, kind="from_text")
    return normalize.normalize(both, dictionary).groupBy("request_id", "kind").agg(F.count_distinct("skill_id").alias("n"))


@query("SELECT team_member_id, is_active, coalesce(experience_in_months, 0) AS experience_in_months, work_type FROM tm", "tm")
def stream_upsert(spark, sf_dir):
    """The same batches as a stream of files; the members after the last one."""
    source, path, state = (shared_path(spark, x) for x in ("batches", "database", "stream"))
    _batches(spark, sf_dir).write.text(source, compression="gzip")
    ingest.database(spark, path, FEW).create()
    upserts.start(spark, source, path, state, "2024-01-01 00:00:00", once=True).awaitTermination()
    return ingest.database(spark, path).read("team_member").select("team_member_id", "is_active", "experience_in_months", "work_type")


_SPLIT = "[x FOR x IN regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}.+#]+') IF x <> '']"


@query(
    f"""WITH names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT array_to_string({_SPLIT.format('text')}[1:3], ' ') FROM benchmark), t AS (SELECT 'document' AS kind, doc_id AS id, 0 AS turn, text FROM documents UNION ALL SELECT 'conversation', conv_id, turn, text FROM conversations),
    w AS (SELECT kind, id, turn, ' ' || array_to_string({_SPLIT.format('text')}, ' ') || ' ' AS words FROM t)
    SELECT kind, id, turn, upper(replace(name, ' ', '_')) AS skill_id FROM w JOIN names ON name <> '' AND contains(words, ' ' || name || ' ')"""
)
def skills_in_texts(spark, sf_dir):
    """The whole dictionary (the parts' names, and the first three words of each benchmark item) looked for in all documents and all turns of conversations."""
    first = F.array_join(F.slice(extract.words_of(F.col("text")), 1, 3), " ")
    names = src.table(spark, sf_dir, "part").select(F.col("p_name").alias("skill_name")).unionByName(src.table(spark, sf_dir, "benchmark").select(first.alias("skill_name"))).distinct().withColumn("skill_id", src.skill_id(F.col("skill_name")))
    key = lambda kind, i, turn: F.struct(F.lit(kind).alias("kind"), F.col(i).alias("id"), turn.cast("long").alias("turn")).alias("key")
    texts = src.table(spark, sf_dir, "documents").select(key("document", "doc_id", F.lit(0)), "text").unionByName(src.table(spark, sf_dir, "conversations").select(key("conversation", "conv_id", F.col("turn")), "text"))
    return extract.names_in_text(texts, names, "key", "text").select("key.kind", "key.id", "key.turn", "skill_id")


@query(
    """SELECT request_id, (24 + key)::VARCHAR AS min_months, CASE WHEN key % 3 = 0 THEN (60 + key)::VARCHAR END AS max_months, CASE WHEN key % 5 <> 0 THEN (2 + key % 9)::VARCHAR END AS duration, strftime(CASE WHEN key % 4 = 3 THEN date_trunc('month', expected_start_date)::DATE ELSE expected_start_date END, '%Y-%m-%d') AS start FROM rq""",
    "rq",
)
def fields_in_texts(spark, sf_dir):
    """Experience, duration and first day, read out of texts in which each requisition says them in one of several ways."""
    k, day = F.col("key"), F.col("expected_start_date")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    asked = F.when(k % 3 == 0, text("Wanted: ", 24 + k, "-", 60 + k, " months of hands-on experience")).when(k % 3 == 1, text("You bring at least ", 24 + k, " months' experience")).otherwise(text("You have ", 24 + k, "+ months of relevant work experience"))
    lasts = F.when(k % 5 == 0, F.lit("")).when(k % 2 == 0, text(", for ", 2 + k % 9, " months")).otherwise(text(", duration: ", 2 + k % 9, " months"))
    starts = F.when(k % 4 == 3, text(". Start in ", F.date_format(day, "MMMM yyyy"))).when(k % 4 == 2, text(". Starting on ", F.date_format(day, "d MMMM yyyy"))).otherwise(text(". Start date: ", day))
    rows = src.requisition(spark, sf_dir).select("request_id", F.concat(asked, lasts, starts, F.lit(".")).alias("text"))
    said = extract.experience(F.col("text"))
    return rows.select("request_id", said["min_months"].cast("string").alias("min_months"), said["max_months"].cast("string").alias("max_months"), extract.duration_months(F.col("text")).cast("string").alias("duration"), extract.start_date(F.col("text")).cast("string").alias("start"))


# ---------------------------------------------------- whole batches, committed


@query(
    """, n AS (SELECT unnest(['failed', 'all', 'rolled_back']) AS state), k AS (SELECT state, custkey FROM n, tm WHERE state = 'all' OR (custkey // 100) % 2 = 0)
    SELECT state, 'team_member' AS name, count(*) AS rows FROM k GROUP BY ALL UNION ALL SELECT state, 'team_member_skill', count(*) FROM k JOIN ms USING (custkey) GROUP BY ALL UNION ALL SELECT state, 'team_member_allocation', count(*) FROM k JOIN al USING (custkey) GROUP BY ALL
    UNION ALL SELECT state, 'skill_certification', count(*) FILTER (rating > 5) FROM k JOIN ms USING (custkey) GROUP BY ALL UNION ALL SELECT state, 'skill_master', count(DISTINCT skill_id) FROM k JOIN ms USING (custkey) GROUP BY ALL UNION ALL SELECT state, 'category_master', 2 FROM n""",
    "tm", "ol", "ms", "al",
)
def bulk_commit_rollback(spark, sf_dir):
    """Rows of all six tables: after the batches of even numbers and a commit that fails at its sixth table, after those of odd numbers, and after a return to the first version."""
    path = shared_path(spark, "batches")
    _batches(spark, sf_dir).write.text(path, compression="gzip")
    lines = spark.read.text(path)
    db = ingest.database(spark, shared_path(spark, "database"), FEW)
    odd = F.get_json_object("value", "$.metadata.batch_number").cast("int") % 2 == 1
    first = ingest.apply(db, documents.from_lines(lines.filter(~odd), schemas.BATCH), "2024-01-01 00:00:00")
    changes = {name: (db.read(name).filter("false"), None) for name in ingest.MERGED}
    changes["category_master"] = (db.read("category_master").withColumn("category_name", F.raise_error(F.lit("the disk is full")).cast("string")), None)
    try:
        db.commit(first, changes)
    except Exception as e:
        if "the disk is full" not in str(e):
            raise
    states = [("failed", ingest.all_tables(db))]
    states.append(("all", ingest.all_tables(db, ingest.apply(db, documents.from_lines(lines.filter(odd), schemas.BATCH), "2024-01-02 00:00:00"))))
    states.append(("rolled_back", ingest.all_tables(db, db.rollback(first))))
    return reduce(DataFrame.unionByName, [rows.select(F.lit(state).alias("state"), "name", "rows") for state, rows in states])


@query(
    """, n AS (SELECT custkey // 100 AS n, count(*) AS members FROM tm GROUP BY 1), s AS (SELECT custkey // 100 AS n, count(*) AS skills FROM ms GROUP BY 1), a AS (SELECT custkey // 100 AS n, count(*) AS allocations FROM al GROUP BY 1)
    SELECT 'B' || n AS batch_id, 'stored' AS what, members, coalesce(skills, 0) AS skills, coalesce(allocations, 0) AS allocations FROM n LEFT JOIN s USING (n) LEFT JOIN a USING (n) UNION ALL SELECT 'B' || n, unnest(['not_json', 'wrong_type']), 0, 0, 0 FROM n""",
    "tm", "ol", "ms", "al",
)
def unreadable_batches(spark, sf_dir):
    """Each batch three times: as it is, cut off in the middle, and with a word for its number; all sent twice. What the log of batches has of each, and the lines that failed with their reason."""
    value = F.col("value")
    cut = F.substr(value, F.lit(1), F.floor(F.length(value) / 2).cast("int"))
    path = shared_path(spark, "batches")
    _batches(spark, sf_dir).write.text(path, compression="gzip")
    lines = spark.read.text(path).select(F.explode(F.array(value, cut, F.regexp_replace(value, r'"batch_number":(\d+)', '"batch_number":"no $1"'))).alias("value"))
    db = ingest.database(spark, shared_path(spark, "database"), FEW)
    for at in ("2024-01-01 00:00:00", "2024-01-02 00:00:00"):
        ingest.apply(db, documents.from_lines(lines, schemas.BATCH), at)
    none = [F.lit(0).cast("long").alias(c) for c in ("members", "skills", "allocations")]
    stored = db.read("sync_logs").select("batch_id", F.lit("stored").alias("what"), F.col("members_inserted").alias("members"), F.col("skills_inserted").alias("skills"), F.col("allocations_inserted").alias("allocations"))
    return stored.unionByName(db.read("failed_batches").select(F.regexp_extract("line", '"batch_id":"(B[0-9]+)"', 1).alias("batch_id"), F.col("unreadable").alias("what"), *none))


def _numbered_batches(spark, sf_dir, number: int, keep: str) -> DataFrame:
    """Batches of this number of the members that keep says, each with the number as experience and rating of one skill."""
    skill = F.array(F.struct(F.lit("S").alias("skill_id"), F.lit("skill").alias("skill_name"), F.lit(number).alias("rating")))
    allocation = F.array(F.struct(F.lit("P").alias("project_id"), F.lit(float(number)).alias("allocation_percentage")))
    member = F.struct("team_member_id", F.lit("active").alias("team_member_status"), F.lit(number).alias("experience_in_months"), "full_name", skill.alias("skills"), allocation.alias("allocations"))
    rows = src.team_member(spark, sf_dir).filter(keep).groupBy(F.expr("custkey div 100").alias("n")).agg(F.array_sort(F.collect_list(member)).alias("team_members"))
    meta = F.struct(F.concat_ws("-", F.lit(f"B{number}"), F.col("n").cast("string")).alias("batch_id"), F.lit(number).alias("batch_number"))
    return rows.select(F.to_json(F.struct(meta.alias("metadata"), "team_members")).alias("value"))


@query("SELECT team_member_id, n AS experience, n AS rating, n::DOUBLE AS percentage, 'B' || n || '-' || (custkey // 100) AS batch_id FROM (SELECT *, CASE WHEN custkey % 2 = 0 THEN 10 WHEN custkey % 3 <> 0 THEN 9 ELSE 8 END AS n FROM tm)", "tm")
def stream_late_batches(spark, sf_dir):
    """A stream in which the batches 10 and 9 come together and 8 comes late: what members, skills and allocations hold afterwards, and from which batch."""
    source, path, state = (shared_path(spark, x) for x in ("batches", "database", "stream"))
    ingest.database(spark, path, FEW).create()
    for parts in ([(10, "custkey % 2 = 0"), (9, "custkey % 3 <> 0")], [(8, "true")]):
        for number, keep in parts:
            _numbered_batches(spark, sf_dir, number, keep).write.mode("append").text(source, compression="gzip")
        upserts.start(spark, source, path, state, "2024-01-01 00:00:00", once=True).awaitTermination()
    db = ingest.database(spark, path)
    rows = db.read("team_member").select("team_member_id", F.col("experience_in_months").alias("experience"), "batch.batch_id")
    rows = rows.join(db.read("team_member_skill").select("team_member_id", "rating"), "team_member_id", "left")
    return rows.join(db.read("team_member_allocation").select("team_member_id", F.col("allocation_percentage").cast("double").alias("percentage")), "team_member_id", "left")


@query(
    """SELECT request_id, 3 AS status, CASE WHEN key % 2 = 0 THEN 'second' ELSE 'first' END AS owner, count(*) AS n_matches, count(DISTINCT rank) AS n_ranks FROM rk JOIN rq USING (request_id) WHERE coalesce(max_months >= min_months, true) GROUP BY ALL""",
    *SCORES, "rq",
)
def claimed_requests(spark, sf_dir):
    """Two runs over one table of requests. The first takes those of odd numbers, matches them and finishes; then it takes the others and dies, and the second, which got none before, takes them over when their lease is past. What the first one brings after that is not stored."""
    db = dispatch.database(spark, shared_path(spark, "requests"), FEW)
    tables_ = (src.skill_master(spark, sf_dir), src.team_member(spark, sf_dir), src.team_member_skill(spark, sf_dir), src.team_member_allocation(spark, sf_dir))
    odd = F.substring("request_id", -1, 1).cast("int") % 2 == 1
    payloads = written(_payloads(spark, sf_dir), "payloads")
    dispatch.submit(db, payloads.filter(odd), "2024-01-01 00:00:00")
    first = dispatch.claim(db, "first", "2024-01-01 00:01:00", "2024-01-01 00:10:00")
    dispatch.finish(db, first, "first", *tables_, "2024-01-01 00:02:00")
    dispatch.submit(db, payloads, "2024-01-01 00:03:00")
    lost = dispatch.claim(db, "first", "2024-01-01 00:04:00", "2024-01-01 00:14:00")
    if not dispatch.claim(db, "second", "2024-01-01 00:05:00", "2024-01-01 00:15:00").isEmpty():
        raise AssertionError("a request was claimed twice")
    found = dispatch.claim(db, "second", "2024-01-01 01:00:00", "2024-01-01 01:10:00")
    dispatch.finish(db, found, "second", *tables_, "2024-01-01 01:01:00")
    dispatch.finish(db, lost, "first", *tables_, "2024-01-01 01:02:00")
    results = db.read("results").groupBy("request_id").agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct("rank").alias("n_ranks"))
    return db.read("requests").select("request_id", "status", "owner").join(results, "request_id", "left")
