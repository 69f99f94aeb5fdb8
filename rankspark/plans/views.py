"""Candidate data derived from the test tables.

The tables hold no candidates. Each view below is one SQL text that Spark and
DuckDB both accept. ``{name}`` stands for a table or an earlier view. All views
read whole tables. Changing a view changes the data, not the engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.session import spread
from rankspark.sources.candidates import parse

# Job descriptions: one per benchmark item; some name skills, with whole-word traps and denied skills.
JOBS = """
SELECT item_id AS job_id, item_id AS vec_id,
       concat(CASE item_id % 4
                WHEN 0 THEN 'Senior AI engineer: Python, RAG, Qdrant and LLM retrieval. Marketing-aware, HR-tech. Category and robust design. '
                WHEN 1 THEN 'Backend engineer with Go, Kafka and C++. '
                WHEN 2 THEN 'Data platform owner: kafka, python, Brand#1 tools. '
                ELSE '' END, text) AS jd_text
FROM {benchmark}
"""

# Profile columns: one row per customer. Negative years = no data.
CAND = """
SELECT concat('CAND_', lpad(CAST(c_custkey AS STRING), 7, '0')) AS candidate_id,
       c_custkey,
       CASE c_custkey % 12 WHEN 0 THEN 'Senior AI Engineer' WHEN 1 THEN 'Data Engineer' WHEN 2 THEN 'HR Manager'
            WHEN 3 THEN 'Salesforce Developer' WHEN 4 THEN 'SDE-2' WHEN 5 THEN 'Threat Analyst'
            WHEN 6 THEN 'DevOps Engineer' WHEN 7 THEN 'Civil Engineer' WHEN 8 THEN 'ML Engineer'
            WHEN 9 THEN ' ' WHEN 10 THEN NULL ELSE 'Financial Systems Engineer' END AS current_title,
       c_acctbal / CAST(300 AS DOUBLE) AS years_of_experience,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST((c_custkey % 8) * 31 AS DOUBLE) END AS notice_nested,
       CASE WHEN c_custkey % 2 = 0 THEN CAST(45 AS DOUBLE) END AS notice_top
FROM {customer}
"""

# Career history: one row per order. Some roles have no start or no duration, those with status P go on.
# Starts are spread over 1 to 4 times the months since 1995, by candidate.
ROLES = """
SELECT candidate_id, role_id, company,
       CASE WHEN role_id % 31 = 0 THEN NULL
            ELSE concat(CAST(1995 + CAST(floor(s / 12) AS BIGINT) AS STRING), '-', lpad(CAST(s % 12 + 1 AS STRING), 2, '0')) END AS start_date,
       CASE WHEN ongoing THEN NULL
            ELSE concat(CAST(1995 + CAST(floor(e / 12) AS BIGINT) AS STRING), '-', lpad(CAST(e % 12 + 1 AS STRING), 2, '0'), '-15') END AS end_date,
       months AS duration_months
FROM (SELECT candidate_id, role_id, company, ongoing, months, s, s + role_id % 37 AS e
      FROM (SELECT concat('CAND_', lpad(CAST(o_custkey AS STRING), 7, '0')) AS candidate_id,
                   o_orderkey AS role_id,
                   CASE WHEN o_orderkey % 29 = 0 THEN NULL
                        WHEN o_custkey % 7 = 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'TCS' WHEN '2-HIGH' THEN ' Infosys ' ELSE 'Wipro' END
                        WHEN o_orderpriority = '1-URGENT' THEN 'TCS' WHEN o_orderpriority = '2-HIGH' THEN 'Acme'
                        WHEN o_orderpriority = '3-MEDIUM' THEN ' ' WHEN o_orderpriority = '5-LOW' THEN 'Initech' ELSE 'Globex' END AS company,
                   o_orderstatus = 'P' AS ongoing,
                   CAST(o_orderkey % 37 AS DOUBLE) - CASE WHEN o_orderkey % 41 = 0 THEN 40 ELSE 0 END AS months,
                   ((CAST(extract(year FROM o_orderdate) AS BIGINT) - 1995) * 12
                     + CAST(extract(month FROM o_orderdate) AS BIGINT) - 1) * (1 + o_custkey % 4) AS s
            FROM {orders}) r) t
"""

# Signals: one row per customer with orders. A github score of -1 = no data.
SIG = """
SELECT concat('CAND_', lpad(CAST(o_custkey AS STRING), 7, '0')) AS candidate_id,
       CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS recruiter_response_rate,
       CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS interview_completion_rate,
       CASE WHEN o_custkey % 4 = 0 THEN CAST(-1 AS DOUBLE) ELSE floor(max(o_totalprice) / 1250) / 4 END AS github_activity_score,
       max(o_totalprice) / CAST(5000 AS DOUBLE) AS max_assessment
FROM {orders} GROUP BY o_custkey
"""

# Skills with their position: every line item gives one; large quantities give technical skills, others the brand.
SKL = """
SELECT concat('CAND_', lpad(CAST(o_custkey AS STRING), 7, '0')) AS candidate_id, skill, pos
FROM (SELECT o_custkey, skill, row_number() OVER (PARTITION BY o_custkey ORDER BY first_seen, skill) AS pos
      FROM (SELECT o_custkey, CASE WHEN l_quantity <= 40 THEN p_brand ELSE technical END AS skill,
                   min(l_orderkey * 10 + l_linenumber) AS first_seen
            FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
            JOIN (SELECT p_partkey, p_brand,
                         CASE substr(p_name, 1, instr(p_name, ' ') - 1) WHEN 'red' THEN 'RAG' WHEN 'hot' THEN 'Go'
                              WHEN 'blue' THEN 'Python' WHEN 'large' THEN 'LLM' WHEN 'new' THEN 'Qdrant' WHEN 'cold' THEN 'C++'
                              WHEN 'small' THEN 'Marketing' ELSE 'Kafka' END AS technical
                  FROM {part}) p ON p_partkey = l_partkey
            GROUP BY 1, 2) s) t
"""

# Arrivals: one row per event, so ids repeat; errors come without an id.
ARRIVALS = """
SELECT CASE WHEN event_type = 'error' THEN NULL ELSE concat('CAND_', lpad(CAST(user_id AS STRING), 7, '0')) END AS candidate_id,
       event_id AS source_pos, event_type AS channel, value AS amount
FROM {events}
"""

# Raw lines: one JSON line per document with planted faults, for ingest.
LINES = """
SELECT doc_id,
       CASE WHEN doc_id % 23 = 5 THEN concat('{{"candidate_id": "', source)
            WHEN doc_id % 23 = 7 THEN '["a", 1]'
            WHEN doc_id % 23 = 9 THEN '   '
            WHEN doc_id % 23 = 11 THEN to_json(named_struct('profile', named_struct('summary', text)))
            ELSE concat('{{"candidate_id": "CAND_', lpad(CAST(doc_id - CASE WHEN doc_id % 23 = 13 THEN 1 ELSE 0 END AS STRING), 7, '0'),
                        '", "profile": {{"headline": "', source, '", "current_title": ',
                        CASE doc_id % 3 WHEN 0 THEN '" Data Engineer "' WHEN 1 THEN 'null' ELSE '""' END,
                        ', "current_company": ', CASE doc_id % 2 WHEN 0 THEN '"Acme"' ELSE '["x"]' END,
                        ', "current_industry": "', lang, '", "years_of_experience": ',
                        CASE doc_id % 5 WHEN 0 THEN '"7"' WHEN 1 THEN '-1' ELSE CAST(doc_id % 30 AS STRING) END,
                        ', "summary": ', get_json_object(to_json(named_struct('t', array(text))), '$.t[*]'),
                        '}}, "skills": ',
                        CASE doc_id % 4 WHEN 0 THEN '[{{"name": " Go "}}, {{"name": null}}, {{"name": "C++"}}]' WHEN 1 THEN '["Python", "", "Kafka", "Python"]'
                             WHEN 2 THEN '["RAG", {{"name": "LLM"}}, {{"level": 3}}, 5]' ELSE 'null' END,
                        ', "career_history": [{{"company": "TCS", "title": "Dev ", "description": "", "start_date": "2019-02-11", "end_date": null, "duration_months": ',
                        CASE doc_id % 3 WHEN 0 THEN '"12"' ELSE CAST(doc_id % 50 AS STRING) END,
                        '}}, 17, {{"company": "Acme", "title": "Lead", "description": "built it", "start_date": "2015-13", "end_date": "2018-01", "duration_months": 20.9}}]',
                        ', "education": [{{"field_of_study": "", "degree": "BSc"}}, {{"field_of_study": "Maths"}}]',
                        ', "signals": {{"notice_period_days": ', CAST(doc_id % 100 AS STRING), ', "github_activity_score": -1, "skill_assessment_scores": {{"go": 91, "sql": "x"}}}}}}')
       END AS value
FROM {documents}
"""

VIEWS = {
    "jobs": (JOBS, ("benchmark",)),
    "cand": (CAND, ("customer",)),
    "roles": (ROLES, ("orders",)),
    "sig": (SIG, ("orders",)),
    "skl": (SKL, ("orders", "lineitem", "part")),
    "arrivals": (ARRIVALS, ("events",)),
}


class Views:
    """Views over the tables of one folder, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def wide_table(self, name: str) -> DataFrame:
        """A table whose rows cost much work each; spread out when it has fewer splits than there are cores."""
        return spread(self.table(name))

    def _view(self, name: str) -> DataFrame:
        sql, inputs = VIEWS[name]
        return self.spark.sql(sql, **{t: self.wide_table(t) if t == "lineitem" else self.table(t) for t in inputs})

    @cached_property
    def cand(self) -> DataFrame:
        return self._view("cand")

    @cached_property
    def roles(self) -> DataFrame:
        return self._view("roles")

    @cached_property
    def sig(self) -> DataFrame:
        return self._view("sig")

    @cached_property
    def skl(self) -> DataFrame:
        return self._view("skl")

    @cached_property
    def arrivals(self) -> DataFrame:
        return self._view("arrivals")

    @cached_property
    def job_texts(self) -> DataFrame:
        return self._view("jobs")

    @cached_property
    def jobs(self) -> DataFrame:
        """Jobs with the vector of the same number."""
        vec = self.table("embeddings").select("vec_id", F.col("embedding").alias("job_vec"))
        return self.job_texts.join(vec, "vec_id")

    @cached_property
    def vec(self) -> DataFrame:
        """One vector per candidate. Candidates share vectors when there are more of them, so scores tie."""
        vectors = self.table("embeddings")
        n = vectors.count()
        keyed = self.cand.select("candidate_id", (F.col("c_custkey") % n).alias("vec_id"))
        return keyed.join(vectors, "vec_id").select("candidate_id", "embedding")

    @cached_property
    def lines(self) -> DataFrame:
        """Raw JSON lines with their position."""
        made = self.spark.sql(LINES, documents=self.wide_table("documents"))
        return made.select(F.explode(F.array("value")).alias("value"), F.col("doc_id").alias("source_pos"))

    @cached_property
    def parsed(self) -> DataFrame:
        return parse(self.lines)
