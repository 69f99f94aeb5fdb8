"""SQL with the same results as the registered queries, for a check by another engine.

Written in the dialect of DuckDB. Shared steps are named parts; ``sql`` puts the
parts a query needs before it.
"""

from __future__ import annotations

import re

from rankspark import constants as fixed
from rankspark.plans.queries import CFG, TEXT_CFG
from rankspark.plans.views import VIEWS

ORACLES: dict[str, str] = {}


def _list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _array(words: tuple[str, ...]) -> str:
    return "[" + _list(words)[1:-1] + "]"


def _month(c: str) -> str:
    y = f"TRY_CAST(regexp_extract({c}, '^\\s*(\\d{{4}})-(\\d{{1,2}})', 1) AS BIGINT)"
    m = f"TRY_CAST(regexp_extract({c}, '^\\s*(\\d{{4}})-(\\d{{1,2}})', 2) AS BIGINT)"
    return f"(CASE WHEN {m} BETWEEN 1 AND 12 THEN {y} * 12 + {m} - 1 END)"


def _r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5e0) / 1e6)"


def _pick(c: str, n: int, draw: int = 0) -> str:
    h = f"('0x' || substr(sha256({c}), 1, 16))::UBIGINT"
    for _ in range(draw):
        h = f"({h} // {n})"
    return f"CAST({h} % {n} AS INTEGER)"


def _tidy(x: str) -> str:
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s+([,;.)])', '\\1', 'g')"
    x = f"regexp_replace({x}, '\\(\\s+', '(', 'g')"
    x = f"regexp_replace({x}, '(?:,\\s*)+([;.)])', '\\1', 'g')"
    return f"trim({x})"


def _sentence(pattern: str) -> str:
    """SQL text of a pattern over the columns of ``slots``."""

    def words(s: str) -> str:
        bits = re.split(r"\{(\w+)\}", s)
        return " || ".join(f"{b}_text" if i % 2 else "'" + b.replace("'", "''") + "'" for i, b in enumerate(bits))

    out = []
    for free, needs in re.findall(r"([^\[]+)|\[([^\]]*)\]", pattern):
        out.append(f"({words(free)})" if free else f"coalesce({words(needs)}, '')")
    return "(" + " || ".join(out or ["''"]) + ")"


def _by_tier(pick: str | None, table: dict) -> str:
    whens = []
    for name, value in table.items():
        if pick is None:
            whens.append(f"WHEN '{name}' THEN {_sentence(value)}")
        else:
            inner = " ".join(f"WHEN {i} THEN {_sentence(p)}" for i, p in enumerate(value))
            whens.append(f"WHEN '{name}' THEN CASE {pick} {inner} END")
    return f"CASE tier {' '.join(whens)} END"


_WORD = "regexp_matches({text}, '(^|[^a-z0-9])' || regexp_escape({word}) || '($|[^a-z0-9])')"
_SPAN = "CASE WHEN span_months IS NOT NULL THEN greatest(span_months, 1) END"
_DENIED_TITLE = "|".join(re.escape(w).replace("\\ ", " ") for w in fixed.OFF_DOMAIN_TITLE_WORDS)
_RULES = {
    "domain_mismatch": f"regexp_matches(lower(coalesce(title, '')), '(^|[^a-z0-9])({_DENIED_TITLE})($|[^a-z0-9])')",
    "overlapping_timeline": f"tenure_months > {_SPAN} * 1.5e0",
    "experience_inflation": f"(stated_years >= 0 AND stated_years * 12 > {_SPAN} * 2e0)",
    "fake_expert": "(has_expert AND years < 0.5e0)",
    "title_mismatch": "(regexp_matches(lower(coalesce(title, '')), 'marketing|sales|hr|human resources') AND has_ai_skill)",
}
_GENERAL = _array(fixed.GENERAL_PHRASES)
_N_GENERAL = len(fixed.GENERAL_PHRASES)
_DIGITS = "regexp_extract_all(coalesce({0}, ''), '\\d+')"
_FITS = """(length({t}) <= 240 AND NOT contains({t}, '{{') AND NOT contains({t}, '}}')
  AND len(list_filter(regexp_extract_all({t}, '\\d+'), lambda d: NOT list_contains(allowed, d))) = 0
  AND (regexp_matches({t}, '\\d') OR coalesce(contains(lower({t}), lower(title_text)), false)
       OR len(list_filter(coalesce(matched_set, []), lambda s: contains(lower({t}), s))) > 0))"""


def _usable(bodies: str, allowed: str) -> str:
    tidied = f"list_transform({bodies}, lambda p: {_tidy('p || concern || ' + repr('.'))})"
    return (
        f"list_filter({tidied}, lambda t: length(t) <= 240 AND NOT contains(t, '{{') AND NOT contains(t, '}}')"
        f" AND len(list_filter(regexp_extract_all(t, '\\d+'), lambda d: NOT list_contains({allowed}, d))) = 0)"
    )


# name -> (parts it reads, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    name: ((), text.format(**{t: t for t in tables})) for name, (text, tables) in VIEWS.items()
}
PARTS |= {
    "vec": (
        ("cand",),
        """SELECT candidate_id, embedding
           FROM (SELECT candidate_id, c_custkey % (SELECT count(*) FROM embeddings) AS vid FROM cand) c
           JOIN embeddings ON vec_id = vid""",
    ),
    "jobvec": (("jobs",), "SELECT job_id, jd_text, embedding AS job_vec FROM jobs JOIN embeddings USING (vec_id)"),
    "scores": (
        ("vec", "jobvec"),
        f"""SELECT job_id, candidate_id,
                   {_r6("list_cosine_similarity(embedding::DOUBLE[], job_vec::DOUBLE[])")} AS sem_score
            FROM vec CROSS JOIN jobvec""",
    ),
    "recalled": (
        ("scores",),
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sem_score DESC, candidate_id) AS recall_rank
                           FROM scores) r WHERE recall_rank <= {CFG.recall_k}""",
    ),
    "dated": (
        ("roles",),
        f"""SELECT *, {_month("start_date")} AS s_idx, {_month("end_date")} AS e_idx,
                   CASE WHEN duration_months >= 0 THEN CAST(trunc(duration_months) AS BIGINT) END AS months
            FROM roles""",
    ),
    "figures": (
        ("dated",),
        f"""SELECT candidate_id,
                   CAST(max(CASE WHEN s_idx IS NOT NULL THEN coalesce(e_idx, s_idx + coalesce(months, 0)) END) - min(s_idx) AS BIGINT) AS span_months,
                   CAST(sum(months) AS BIGINT) AS tenure_months,
                   CAST(sum(months) AS DOUBLE) / count(months) / 12e0 AS mean_tenure_years,
                   bool_and(CASE WHEN company <> '' THEN lower(trim(company)) IN {_list(fixed.CONSULTING_FIRMS)} END) AS only_consulting
            FROM dated GROUP BY candidate_id""",
    ),
    "flags": (
        ("skl",),
        f"SELECT candidate_id, bool_or(lower(trim(skill)) IN {_list(fixed.AI_KEYWORDS)}) AS has_ai_skill FROM skl GROUP BY 1",
    ),
    "facts": (
        ("cand", "figures", "sig", "flags"),
        """SELECT candidate_id, current_title AS title, years_of_experience AS stated_years,
                  coalesce(CASE WHEN years_of_experience >= 0 THEN years_of_experience END, tenure_months / 12e0) AS years,
                  span_months, tenure_months, mean_tenure_years, only_consulting,
                  coalesce(notice_nested, notice_top) AS notice_days,
                  recruiter_response_rate AS response_rate, interview_completion_rate AS completion_rate,
                  CASE WHEN github_activity_score >= 0 THEN github_activity_score END AS github,
                  coalesce(max_assessment >= 90, false) AS has_expert,
                  coalesce(has_ai_skill, false) AS has_ai_skill
           FROM cand LEFT JOIN figures USING (candidate_id) LEFT JOIN sig USING (candidate_id)
                     LEFT JOIN flags USING (candidate_id)""",
    ),
    "factors": (
        ("facts",),
        """SELECT *, f_consulting * f_hopper * f_notice * f_engagement AS multiplier, f_hopper < 1 AS hopper
           FROM (SELECT *,
                   CASE WHEN only_consulting THEN 0.1e0 ELSE 1e0 END AS f_consulting,
                   CASE WHEN mean_tenure_years < 1.5e0 THEN 0.85e0 ELSE 1e0 END AS f_hopper,
                   CASE WHEN notice_days > 30
                        THEN greatest(0e0, 1e0 - 0.15e0 * ((CAST(trunc(notice_days) AS BIGINT) - 30 + 29) // 30)) ELSE 1e0 END AS f_notice,
                   1e0 + greatest(0e0, least(1e0, coalesce(response_rate, 0e0))) * greatest(0e0, least(1e0, coalesce(completion_rate, 0e0))) AS f_engagement
                 FROM facts) f""",
    ),
    "marked": (
        ("recalled", "factors"),
        "SELECT *, coalesce("
        + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _RULES.items())
        + ") AS drop_reason FROM recalled JOIN factors USING (candidate_id)",
    ),
    "scored": (
        ("marked",),
        f"SELECT *, {_r6('sem_score * multiplier')} AS raw_score FROM marked WHERE drop_reason IS NULL",
    ),
    "best": (
        ("scored",),
        f"""SELECT *, CASE WHEN top > 0 THEN greatest(raw_score, 0e0) / top ELSE 0e0 END AS score,
                   CASE WHEN rank <= {CFG.top_tier_until} THEN 'top' WHEN rank <= {CFG.mid_tier_until} THEN 'mid' ELSE 'filler' END AS tier
            FROM (SELECT *, max(raw_score) OVER (PARTITION BY job_id) AS top
                  FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY raw_score DESC, sem_score DESC, candidate_id) AS rank
                        FROM scored) a
                  WHERE rank <= {CFG.top_n}) b""",
    ),
    "matched_top": (
        ("best", "jobs", "skl"),
        f"""SELECT job_id, candidate_id, list(skill ORDER BY pos) AS matched, list_distinct(list(lower(skill))) AS matched_set
            FROM best JOIN skl USING (candidate_id) JOIN jobs USING (job_id)
            WHERE lower(skill) NOT IN {_list(fixed.DENIED_SKILLS)}
              AND {_WORD.format(text="lower(jd_text)", word="lower(skill)")}
            GROUP BY ALL""",
    ),
    "slots": (
        ("best", "matched_top"),
        """SELECT best.*, matched_set, matched[1:3] AS named,
                  CAST(CAST(trunc(years) AS BIGINT) AS VARCHAR) AS years_text,
                  nullif(trim(title), '') AS title_text,
                  CASE WHEN github IS NOT NULL THEN printf('%.2f', github) END AS github_text,
                  array_to_string(matched[1:3], ', ') AS skills_text,
                  CASE WHEN notice_days > 30 THEN CAST(CAST(trunc(notice_days) AS BIGINT) AS VARCHAR) END AS notice_text
           FROM best LEFT JOIN matched_top USING (job_id, candidate_id)""",
    ),
    "leads": (
        ("slots",),
        f"""SELECT *, {_by_tier(_pick("candidate_id", 4), fixed.TIER_PATTERNS)} || {_by_tier(None, fixed.TIER_FACTS)} AS rich,
                   {_by_tier(_pick("candidate_id", 4, 1), fixed.TIER_PATTERNS)} AS plain,
                   {_sentence(fixed.NOTICE_CONCERN)} || CASE WHEN hopper THEN '{fixed.HOPPER_CONCERN}' ELSE '' END AS concern,
                   list_distinct(flatten([{_DIGITS.format("years_text")}, {_DIGITS.format("CAST(CAST(trunc(notice_days) AS BIGINT) AS VARCHAR)")},
                                          {_DIGITS.format("github_text")}, {_DIGITS.format("title")}, {_DIGITS.format("skills_text")}])) AS allowed
            FROM slots""",
    ),
    "tried": (
        ("leads",),
        f"""SELECT *, {_tidy("rich || concern || '.'")} AS t1, {_tidy("plain || concern || '.'")} AS t2,
                   {_tidy(f"{_GENERAL}[{_pick('candidate_id', _N_GENERAL)} + 1] || concern || '.'")} AS general
            FROM leads""",
    ),
    "built": (
        ("tried",),
        f"""SELECT *, CASE WHEN {_FITS.format(t="t1")} THEN t1 WHEN {_FITS.format(t="t2")} THEN t2
                           WHEN length(general) <= 240 THEN general
                           ELSE list_filter(list_transform({_GENERAL}, lambda p: {_tidy("p || concern || '.'")}), lambda s: length(s) <= 240)[1] END AS reasoning
            FROM tried""",
    ),
    "numbered": (
        ("built",),
        "SELECT *, row_number() OVER (PARTITION BY job_id, reasoning ORDER BY rank, candidate_id) AS use_no FROM built",
    ),
    "ref_unique": (
        ("numbered",),
        """SELECT job_id, candidate_id, rank, score,
                  CASE WHEN use_no = 1 THEN reasoning
                       ELSE regexp_replace(reasoning, '\\.$', '') || ' (ref ' || candidate_id || ').' END AS reasoning
           FROM numbered""",
    ),
    "turned": (
        ("built",),
        f"""SELECT *, list_concat({_GENERAL}[start + 1:], {_GENERAL}[1:start]) AS phrases
            FROM (SELECT *, {_pick('candidate_id', _N_GENERAL)} AS start FROM built) b""",
    ),
    "choices": (
        ("turned",),
        f"""SELECT job_id, candidate_id, rank, score,
                   list_concat([reasoning], {_usable("phrases", "allowed")},
                     CASE WHEN title_text IS NULL THEN [] ELSE {_usable("list_transform(phrases, lambda q: q || ' (' || title_text || ')')", "allowed")} END,
                     {_usable("list_transform(phrases, lambda q: q || ' (ref ' || candidate_id || ')')",
                              "list_concat(allowed, regexp_extract_all(candidate_id, '" + chr(92) + "d+'))")}) AS options
            FROM turned""",
    ),
    "assigned": (
        ("choices",),
        """SELECT job_id, candidate_id, rank, score, options[1] AS reasoning, [options[1]] AS used FROM choices WHERE rank = 1
           UNION ALL
           SELECT job_id, candidate_id, rank, score, pick AS reasoning, list_append(used, pick) AS used
           FROM (SELECT c.job_id, c.candidate_id, c.rank, c.score, a.used,
                        list_filter(c.options, lambda o: NOT list_contains(a.used, o))[1] AS pick
                 FROM assigned a JOIN choices c ON c.job_id = a.job_id AND c.rank = a.rank + 1) n""",
    ),
    "ranked_bad": (
        ("ref_unique",),
        """SELECT job_id, rank AS row_no,
                  CASE rank WHEN 3 THEN lag(candidate_id) OVER w WHEN 13 THEN 'NOBODY_' || job_id ELSE candidate_id END AS candidate_id,
                  CASE rank WHEN 5 THEN rank + 1 ELSE rank END AS rank,
                  CASE rank WHEN 7 THEN lag(score) OVER w + 0.01e0 WHEN 9 THEN 1.5e0 ELSE score END AS score,
                  CASE rank WHEN 11 THEN '  ' WHEN 15 THEN reasoning || ' 99999' ELSE reasoning END AS reasoning
           FROM ref_unique WINDOW w AS (PARTITION BY job_id ORDER BY rank)""",
    ),
    "tokens": (
        ("facts", "skl"),
        f"""SELECT candidate_id, unnest({_DIGITS.format("CAST(CAST(trunc(years) AS BIGINT) AS VARCHAR)")}) AS token FROM facts
            UNION ALL SELECT candidate_id, unnest({_DIGITS.format("CAST(CAST(trunc(notice_days) AS BIGINT) AS VARCHAR)")}) FROM facts
            UNION ALL SELECT candidate_id, unnest({_DIGITS.format("printf('%.2f', github)")}) FROM facts WHERE github IS NOT NULL
            UNION ALL SELECT candidate_id, unnest({_DIGITS.format("title")}) FROM facts
            UNION ALL SELECT candidate_id, unnest({_DIGITS.format("skill")}) FROM skl""",
    ),
    "loose": (
        ("ranked_bad", "tokens"),
        """SELECT DISTINCT job_id, row_no, b.candidate_id, b.token
           FROM (SELECT job_id, row_no, candidate_id, unnest(regexp_extract_all(reasoning, '\\d+')) AS token FROM ranked_bad) b
           WHERE NOT list_contains(regexp_extract_all(b.candidate_id, '\\d+'), b.token)
             AND NOT EXISTS (SELECT 1 FROM tokens t WHERE t.candidate_id = b.candidate_id AND t.token = b.token)""",
    ),
    "good_docs": (
        (),
        """SELECT doc_id, 'CAND_' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS candidate_id, text, lang, source
           FROM documents WHERE doc_id % 23 NOT IN (5, 7, 9, 11, 13)
           UNION ALL
           SELECT doc_id, 'CAND_' || lpad(CAST(doc_id - 1 AS VARCHAR), 7, '0'), text, lang, source
           FROM documents d WHERE doc_id % 23 = 13 AND NOT EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = d.doc_id - 1)""",
    ),
    "composed": (
        ("good_docs",),
        """SELECT candidate_id, concat_ws(' | ', source,
                  CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'Data Engineer at Acme' WHEN doc_id % 3 = 0 THEN 'Data Engineer'
                       WHEN doc_id % 2 = 0 THEN 'at Acme' END,
                  lang,
                  CASE doc_id % 4 WHEN 0 THEN 'Skills: Go, C++' WHEN 1 THEN 'Skills: Python, Kafka, Python' WHEN 2 THEN 'Skills: RAG, LLM, 5' END,
                  nullif(trim(text, ' ' || chr(10) || chr(9) || chr(13)), ''), 'Experience: Dev, Lead', 'built it', 'Education: BSc, Maths') AS text
           FROM good_docs""",
    ),
    "valid_arrivals": (("arrivals",), "SELECT * FROM arrivals WHERE candidate_id IS NOT NULL"),
    "doc_buckets": (
        (),
        """SELECT doc_id, CAST(('0x' || substr(sha256(token), 1, 16))::UBIGINT % 384 AS BIGINT) AS bucket, count(*) AS n_tokens
           FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents) t GROUP BY ALL""",
    ),
    "doc_tokens": (
        (),
        """SELECT doc_id, token, count(*) AS n_tokens
           FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM documents) t GROUP BY ALL""",
    ),
    "item_tokens": (
        (),
        """SELECT item_id, token, count(*) AS n_tokens
           FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM benchmark) t GROUP BY ALL""",
    ),
    "doc_lengths": (("doc_tokens",), "SELECT doc_id, sqrt(sum(n_tokens * n_tokens)::DOUBLE) AS n FROM doc_tokens GROUP BY 1"),
    "item_buckets": (
        (),
        """SELECT item_id, CAST(('0x' || substr(sha256(token), 1, 16))::UBIGINT % 384 AS BIGINT) AS bucket, count(*) AS n_tokens
           FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM benchmark) t GROUP BY ALL""",
    ),
}


def sql(body: str, *parts: str, instead: dict | None = None) -> str:
    """The parts (with what they read, each once) and then the body. ``instead`` replaces parts."""
    known = PARTS | (instead or {})
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in known[name][0]:
                visit(need)
            order.append(name)

    for p in parts:
        visit(p)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({known[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if 'assigned' in order else ''}{ctes}\n{body}"


def oracle(name: str, body: str, *parts: str, instead: dict | None = None) -> None:
    ORACLES[name] = sql(body, *parts, instead=instead)


def _weights(key: str, text: str, source: str) -> str:
    """Unit weights per hash bucket as stored: single precision."""
    return f"""SELECT {key}, bucket, CAST(CAST(n AS FLOAT) / sqrt(sum(n * n) OVER (PARTITION BY {key})::DOUBLE) AS FLOAT)::DOUBLE AS w
               FROM (SELECT {key}, ('0x' || substr(sha256(token), 1, 16))::UBIGINT % 384 AS bucket, count(*) AS n
                     FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS token FROM {source}) t
                     GROUP BY ALL) c"""


# The same run over records made from documents: other vectors, facts and skills, the rest unchanged.
FROM_RECORDS = {
    "doc_weights": (("composed",), _weights("candidate_id", "text", "composed")),
    "job_weights": (("jobs",), _weights("job_id", "jd_text", "jobs")),
    "scores": (
        ("doc_weights", "job_weights"),
        f"""SELECT j.job_id, d.candidate_id, {_r6("coalesce(p.s, 0e0) / (j.n * d.n)")} AS sem_score
            FROM (SELECT candidate_id, sqrt(sum(w * w)) AS n FROM doc_weights GROUP BY 1) d
            CROSS JOIN (SELECT job_id, sqrt(sum(w * w)) AS n FROM job_weights GROUP BY 1) j
            LEFT JOIN (SELECT job_id, candidate_id, sum(a.w * b.w) AS s
                       FROM doc_weights a JOIN job_weights b USING (bucket) GROUP BY ALL) p
              ON p.job_id = j.job_id AND p.candidate_id = d.candidate_id""",
    ),
    "facts": (
        ("good_docs",),
        """SELECT *, coalesce(CASE WHEN stated_years >= 0 THEN stated_years END, tenure_months / 12e0) AS years
           FROM (SELECT candidate_id, CASE doc_id % 3 WHEN 0 THEN ' Data Engineer ' WHEN 2 THEN '' END AS title,
                        CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN -1e0 ELSE CAST(doc_id % 30 AS DOUBLE) END AS stated_years,
                        CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END AS span_months,
                        20 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END AS tenure_months,
                        CASE WHEN doc_id % 3 = 0 THEN 20e0 / 12e0 ELSE (20 + doc_id % 50) / 2e0 / 12e0 END AS mean_tenure_years,
                        false AS only_consulting, CAST(doc_id % 100 AS DOUBLE) AS notice_days,
                        CAST(NULL AS DOUBLE) AS response_rate, CAST(NULL AS DOUBLE) AS completion_rate, CAST(NULL AS DOUBLE) AS github,
                        true AS has_expert, doc_id % 4 = 2 AS has_ai_skill FROM good_docs) g""",
    ),
    "skl": (
        ("good_docs",),
        """SELECT candidate_id, unnest(names) AS skill, unnest(range(1, len(names) + 1)) AS pos
           FROM (SELECT candidate_id, CASE doc_id % 4 WHEN 0 THEN ['Go', 'C++'] WHEN 1 THEN ['Python', 'Kafka', 'Python']
                                           WHEN 2 THEN ['RAG', 'LLM', '5'] ELSE [] END AS names FROM good_docs) g""",
    ),
}


# Scans, sources and sinks
oracle(
    "scan_candidates",
    """SELECT candidate_id, doc_id AS source_pos, source AS headline, CASE WHEN doc_id % 2 = 0 THEN 'Acme' END AS company,
              CASE WHEN doc_id % 5 NOT IN (0, 1) THEN CAST(doc_id % 30 AS DOUBLE) END AS stated_years,
              length(text) AS summary_chars,
              CASE doc_id % 4 WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE 4 END AS n_skill_entries,
              2 AS n_roles,
              20 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 50 END AS tenure_months,
              CAST(doc_id % 100 AS DOUBLE) AS notice_days
       FROM good_docs""",
    "good_docs",
)
oracle(
    "quarantine_rows",
    """SELECT doc_id AS source_pos, CASE doc_id % 23 WHEN 5 THEN 'not json' ELSE 'not an object' END AS fault,
              CASE doc_id % 23 WHEN 5 THEN '{"candidate_id": "' || source ELSE '["a", 1]' END AS value
       FROM documents WHERE doc_id % 23 IN (5, 7)""",
)
oracle("scan_valid_ids", "SELECT * FROM valid_arrivals", "valid_arrivals")
oracle(
    "jobs_resolved",
    f"""SELECT job_id, CASE WHEN job_id % 3 = 0 THEN trim(jd_text) WHEN job_id % 5 <> 0 THEN 'file: ' || trim(jd_text)
                            ELSE '{fixed.SAMPLE_JOB_TEXT}' END AS jd_text FROM jobs""",
    "jobs",
)
def _W(k: int) -> str:
    """Weight of one bucket of a record's vector."""
    value = f"(SELECT max(w.w) FROM doc_weights AS w WHERE w.candidate_id = composed.candidate_id AND w.bucket = {k})"
    return f"{_r6(f'coalesce({value}, 0e0)')} AS w{k}"


oracle(
    "features_roundtrip",
    f"""SELECT candidate_id, sha256(text) AS text_hash, 'hashed-tokens-384' AS model, 384 AS dim, 1e0 AS norm,
              {_W(0)}, {_W(1)}, {_W(2)}, {_W(3)}
       FROM composed""",
    "composed",
    "doc_weights",
    instead=FROM_RECORDS,
)
oracle(
    "manifest_summary",
    """SELECT count(*) AS n_vectors, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
              count(*) FILTER (candidate_id IS NULL) AS n_without_id,
              bool_and(abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 1e-6) AS normalized
       FROM vec""",
    "vec",
)
oracle(
    "ranked_output",
    "SELECT job_id, candidate_id, rank, printf('%.6f', score) AS score, reasoning FROM assigned",
    "assigned",
)
oracle(
    "ranked_reload",
    "SELECT job_id, candidate_id, rank, CAST(printf('%.6f', score) AS DOUBLE) AS score, reasoning FROM assigned",
    "assigned",
)

# Text and records
oracle("compose_text", "SELECT candidate_id, text, sha256(text) AS text_hash FROM composed", "composed")
oracle(
    "join_nonempty",
    """SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ', ') AS joined
       FROM documents""",
)
oracle("tidy_text", f"SELECT doc_id, {_tidy('text')} AS tidied FROM documents")
oracle(
    "skill_names",
    """SELECT candidate_id, CASE doc_id % 4 WHEN 0 THEN 'Go|C++' WHEN 1 THEN 'Python|Kafka|Python' WHEN 2 THEN 'RAG|LLM|5' ELSE '' END AS names,
              CASE doc_id % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 3 END AS n_names FROM good_docs""",
    "good_docs",
)
oracle(
    "skill_intersection",
    f"""SELECT candidate_id, string_agg(DISTINCT lower(skill), ',' ORDER BY lower(skill)) AS ai_skills
        FROM skl WHERE lower(skill) IN {_list(fixed.AI_KEYWORDS)} GROUP BY 1""",
    "skl",
)

# Career figures
oracle(
    "month_index",
    f"""SELECT role_id, {_month("start_date")} AS start_month, {_month("end_date")} AS end_month,
               {_month("('  ' || replace(start_date, '-0', '-1'))")} AS shifted_month FROM roles""",
    "roles",
)
oracle("career_span", "SELECT candidate_id, span_months FROM figures", "figures")
oracle("career_tenure", "SELECT candidate_id, tenure_months FROM figures", "figures")
oracle("mean_tenure", f"SELECT candidate_id, {_r6('mean_tenure_years')} AS mean_tenure_years FROM figures", "figures")
oracle("consulting_lifer", "SELECT candidate_id, only_consulting FROM figures", "figures")
oracle("experience_years", f"SELECT candidate_id, {_r6('years')} AS years FROM facts", "facts")
oracle(
    "sentinel_nulls",
    "SELECT candidate_id, CASE WHEN github_activity_score >= 0 THEN github_activity_score END AS github FROM sig",
    "sig",
)
oracle(
    "stable_pick",
    f"""SELECT candidate_id, {_pick("candidate_id", 24)} AS pick_24, {_pick("candidate_id", 4)} AS pick_4,
               {_pick("candidate_id", 4, 1)} AS second_pick_4 FROM cand""",
    "cand",
)

# Drop rules
for _name, _query, _columns in (
    ("domain_mismatch", "rule_domain_mismatch", "title"),
    ("overlapping_timeline", "rule_overlap", "tenure_months, span_months"),
    ("experience_inflation", "rule_inflation", "stated_years, span_months"),
    ("fake_expert", "rule_fake_expert", "years"),
    ("title_mismatch", "rule_title_mismatch", "title"),
):
    oracle(_query, f"SELECT candidate_id, {_columns} FROM facts WHERE {_RULES[_name]}", "facts")
oracle("drop_reason", "SELECT job_id, candidate_id, drop_reason FROM marked", "marked")
oracle(
    "drop_reason_counts",
    "SELECT job_id, drop_reason, count(*) AS n_rows FROM marked WHERE drop_reason IS NOT NULL GROUP BY ALL",
    "marked",
)
oracle(
    "funnel_counts",
    f"""SELECT r.job_id, count(*) AS recalled, count(*) FILTER (m.candidate_id IS NULL) AS missing,
               count(m.drop_reason) AS dropped, count(*) FILTER (m.candidate_id IS NOT NULL AND m.drop_reason IS NULL) AS kept,
               least(count(*) FILTER (m.candidate_id IS NOT NULL AND m.drop_reason IS NULL), {CFG.top_n}) AS retained
        FROM recalled r LEFT JOIN marked m ON m.job_id = r.job_id AND m.candidate_id = r.candidate_id GROUP BY 1""",
    "marked",
)

# Recall and joins
oracle(
    "recall_topk",
    "SELECT candidate_id, sem_score, recall_rank FROM recalled WHERE job_id = (SELECT min(job_id) FROM jobs)",
    "recalled",
)
_R9 = "floor(({x}) * 1e9 + 0.5e0) / 1e9"
_ONE_JOB = {
    "scores": (
        ("vec", "jobvec"),
        f"""SELECT job_id, candidate_id,
                   {_R9.format(x="list_cosine_similarity(embedding::DOUBLE[], job_vec::DOUBLE[])")} AS sem_score
            FROM vec CROSS JOIN jobvec WHERE job_id = 0""",
    ),
    "recalled": (
        ("scores",),
        "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY sem_score DESC, candidate_id) AS recall_rank FROM scores) r WHERE recall_rank <= 1000",
    ),
    "scored": (
        ("marked",),
        f"SELECT *, {_R9.format(x='sem_score * multiplier')} AS raw_score FROM marked WHERE drop_reason IS NULL",
    ),
    "best": (
        ("scored",),
        """SELECT *, CASE WHEN max(raw_score) OVER () > 0 THEN greatest(raw_score, 0e0) / max(raw_score) OVER () ELSE 0e0 END AS score
           FROM (SELECT *, row_number() OVER (ORDER BY raw_score DESC, sem_score DESC, candidate_id) AS rank FROM scored) a
           WHERE rank <= 100""",
    ),
}
oracle(
    "rank_one_job",
    f"SELECT job_id, candidate_id, rank, {_r6('score')} AS score FROM best",
    "best",
    instead=_ONE_JOB,
)
oracle("recall_topk_multi", "SELECT job_id, candidate_id, sem_score, recall_rank FROM recalled", "recalled")
oracle(
    "score_all_pairs",
    f"""SELECT job_id, count(*) AS n_scored, min(sem_score) AS min_score, max(sem_score) AS max_score,
               {_r6("sum(sem_score) / count(*)")} AS mean_score FROM scores GROUP BY 1""",
    "scores",
)
oracle(
    "recall_join",
    f"""SELECT job_id, candidate_id, sem_score, current_title, {_r6("years_of_experience")} AS years
        FROM recalled JOIN cand USING (candidate_id)""",
    "recalled",
    "cand",
)
oracle(
    "recall_missing",
    "SELECT job_id, candidate_id FROM recalled ANTI JOIN valid_arrivals USING (candidate_id)",
    "recalled",
    "valid_arrivals",
)
oracle(
    "match_skills",
    f"""SELECT job_id, candidate_id, array_to_string(list(skill ORDER BY pos)[1:3], ', ') AS named, count(DISTINCT lower(skill)) AS n_matched
        FROM recalled JOIN skl USING (candidate_id) JOIN jobs USING (job_id)
        WHERE lower(skill) NOT IN {_list(fixed.DENIED_SKILLS)} AND {_WORD.format(text="lower(jd_text)", word="lower(skill)")}
        GROUP BY ALL""",
    "recalled",
    "skl",
    "jobs",
)
oracle(
    "incremental_todo",
    """SELECT candidate_id, 'm1' AS model, sha256(candidate_id) AS text_hash FROM cand
       WHERE c_custkey NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)""",
    "cand",
)

# Repeats, merges, counts
oracle(
    "dedupe_first",
    "SELECT candidate_id, source_pos, channel, amount FROM valid_arrivals QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY source_pos) = 1",
    "valid_arrivals",
)
oracle(
    "duplicate_ids",
    "SELECT candidate_id, count(*) AS n_rows FROM valid_arrivals GROUP BY 1 HAVING count(*) > 1",
    "valid_arrivals",
)
oracle(
    "merge_features",
    """SELECT candidate_id, source_pos, channel, amount FROM valid_arrivals
       QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY channel NOT IN ('view', 'click'), source_pos) = 1""",
    "valid_arrivals",
)
oracle(
    "bucketed_merge",
    """SELECT candidate_id, source_pos, channel, amount FROM valid_arrivals
       QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY channel NOT IN ('view', 'click'), source_pos) = 1""",
    "valid_arrivals",
)
oracle(
    "bucketed_todo",
    """SELECT candidate_id, 'm1' AS model, sha256(candidate_id) AS text_hash FROM cand
       WHERE c_custkey NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)""",
    "cand",
)
oracle(
    "stream_ingest",
    """SELECT concat('CAND_', lpad(CAST(id AS VARCHAR), 7, '0')) AS candidate_id, doc_id % 2 AS batch_id, source AS headline,
              length(text) AS summary_chars, CAST(doc_id % 100 AS DOUBLE) AS notice_days
       FROM (SELECT *, doc_id - CASE WHEN doc_id % 23 = 13 THEN 1 ELSE 0 END AS id FROM documents WHERE doc_id % 23 NOT IN (5, 7, 9, 11)) d
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id % 2, doc_id) = 1""",
)
oracle(
    "count_consistency",
    """SELECT (SELECT count(*) FROM cand) AS record_rows, (SELECT count(DISTINCT candidate_id) FROM cand) AS record_ids,
              (SELECT count(*) FROM embeddings) AS vector_rows, (SELECT count(DISTINCT vec_id) FROM embeddings) AS vector_ids,
              (SELECT count(*) FROM cand WHERE c_custkey NOT IN (SELECT vec_id FROM embeddings)) AS records_without_vector,
              (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT c_custkey FROM cand)) AS vectors_without_record""",
    "cand",
)

# Vectors
oracle(
    "l2_normalize",
    f"""SELECT vec_id, {_r6("n")} AS length, CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END AS unit_length,
               {_r6("embedding[1]::DOUBLE / n")} AS first_value, {_r6("list_max(embedding)::DOUBLE / n")} AS largest_value
        FROM (SELECT *, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) e""",
)
oracle(
    "cosine_scores",
    f"""SELECT a.vec_id, {_r6("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")} AS cosine
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
oracle("hashed_vectors", "SELECT doc_id, bucket, n_tokens FROM doc_buckets", "doc_buckets")
oracle(
    "text_similarity_topk",
    f"""SELECT job_id, doc_id, sem_score, row_number() OVER (PARTITION BY job_id ORDER BY sem_score DESC, doc_id) AS recall_rank
        FROM (SELECT i.item_id AS job_id, d.doc_id, {_r6("coalesce(dots.s, 0) / (i.n * d.n)")} AS sem_score
              FROM (SELECT doc_id, sqrt(sum(n_tokens * n_tokens)::DOUBLE) AS n FROM doc_buckets GROUP BY 1) d
              CROSS JOIN (SELECT item_id, sqrt(sum(n_tokens * n_tokens)::DOUBLE) AS n FROM item_buckets GROUP BY 1) i
              LEFT JOIN (SELECT item_id, doc_id, sum(a.n_tokens * b.n_tokens)::DOUBLE AS s
                         FROM doc_buckets a JOIN item_buckets b USING (bucket) GROUP BY ALL) dots
                ON dots.item_id = i.item_id AND dots.doc_id = d.doc_id) p
        QUALIFY recall_rank <= {TEXT_CFG.recall_k}""",
    "doc_buckets",
    "item_buckets",
)

oracle(
    "posting_lists",
    f"""SELECT token AS term, count(*) AS n_texts, {_r6("max(n_tokens / n)")} AS max_weight
        FROM doc_tokens JOIN doc_lengths USING (doc_id) GROUP BY 1""",
    "doc_tokens",
    "doc_lengths",
)
oracle(
    "token_similarity_topk",
    f"""SELECT job_id, doc_id, sem_score, row_number() OVER (PARTITION BY job_id ORDER BY sem_score DESC, doc_id) AS recall_rank
        FROM (SELECT i.item_id AS job_id, d.doc_id, {_r6("coalesce(dots.s / (i.n * l.n), 0)")} AS sem_score
              FROM documents d
              CROSS JOIN (SELECT b.item_id, sqrt(sum(t.n_tokens * t.n_tokens)::DOUBLE) AS n
                          FROM benchmark b LEFT JOIN item_tokens t ON t.item_id = b.item_id GROUP BY 1) i
              LEFT JOIN doc_lengths l ON l.doc_id = d.doc_id
              LEFT JOIN (SELECT item_id, doc_id, sum(a.n_tokens * b.n_tokens)::DOUBLE AS s
                         FROM doc_tokens a JOIN item_tokens b USING (token) GROUP BY ALL) dots
                ON dots.item_id = i.item_id AND dots.doc_id = d.doc_id) p
        QUALIFY recall_rank <= {TEXT_CFG.recall_k}""",
    "doc_tokens",
    "doc_lengths",
    "item_tokens",
)

# Factors and scores
oracle("mult_consulting", "SELECT candidate_id, f_consulting FROM factors", "factors")
oracle("mult_hopper", "SELECT candidate_id, f_hopper FROM factors", "factors")
oracle("mult_notice", f"SELECT candidate_id, notice_days, {_r6('f_notice')} AS f_notice FROM factors", "factors")
oracle("mult_engagement", f"SELECT candidate_id, {_r6('f_engagement')} AS f_engagement FROM factors", "factors")
oracle(
    "multiplier_breakdown",
    f"""SELECT candidate_id, f_consulting, f_hopper, {_r6("f_notice")} AS f_notice, {_r6("f_engagement")} AS f_engagement,
               {_r6("multiplier")} AS multiplier, hopper FROM factors""",
    "factors",
)
oracle("final_scores", "SELECT job_id, candidate_id, sem_score, raw_score FROM scored", "scored")
oracle("final_topn", "SELECT job_id, candidate_id, sem_score, raw_score FROM best", "best")
oracle("rank_position", "SELECT job_id, candidate_id, rank FROM best", "best")
oracle("normalize_scores", f"SELECT job_id, candidate_id, raw_score, {_r6('score')} AS score FROM best", "best")
oracle("rank_tiers", "SELECT job_id, candidate_id, rank, tier FROM best", "best")
oracle(
    "rank_candidates",
    f"SELECT job_id, candidate_id, rank, {_r6('score')} AS score, reasoning FROM assigned",
    "assigned",
)

oracle(
    "rank_records",
    f"SELECT job_id, candidate_id, rank, {_r6('score')} AS score, reasoning FROM assigned",
    "assigned",
    instead=FROM_RECORDS,
)

# Sentences
oracle(
    "reason_fragments",
    "SELECT job_id, candidate_id, years_text, title_text, github_text, skills_text, notice_text FROM slots",
    "slots",
)
oracle("reason_by_tier", "SELECT job_id, candidate_id, tier, rich, plain FROM leads", "leads")
oracle("concern_clause", "SELECT job_id, candidate_id, concern FROM leads", "leads")
_GROUNDED = (
    "(NOT contains({t}, '{{') AND NOT contains({t}, '}}')"
    " AND len(list_filter(regexp_extract_all({t}, '[0-9]+'), lambda d: NOT list_contains(allowed, d))) = 0)"
)
oracle(
    "grounding_check",
    f"""SELECT job_id, candidate_id, {_GROUNDED.format(t="reasoning")} AS grounded, {_GROUNDED.format(t="(reasoning || ' 99999')")} AS planted_grounded
        FROM built""",
    "built",
)
oracle("ungrounded_digits", "SELECT job_id, row_no, candidate_id, token FROM loose", "loose")
_SPECIFIC = (
    "(regexp_matches({t}, '\\d') OR coalesce(contains(lower({t}), lower(title_text)), false)"
    " OR len(list_filter(coalesce(matched_set, []), lambda s: contains(lower({t}), s))) > 0)"
)
oracle(
    "reason_specific",
    f"""SELECT job_id, candidate_id, {_SPECIFIC.format(t="reasoning")} AS reasoning_specific,
               {_SPECIFIC.format(t="general")} AS general_specific FROM built""",
    "built",
)
oracle("build_reasoning", "SELECT job_id, candidate_id, rank, reasoning FROM built", "built")
oracle(
    "reason_collisions", "SELECT job_id, candidate_id, rank, use_no FROM numbered WHERE use_no > 1", "numbered"
)
oracle("unique_reasoning_ref", "SELECT job_id, candidate_id, rank, reasoning FROM ref_unique", "ref_unique")
oracle("unique_reasoning", "SELECT job_id, candidate_id, rank, reasoning FROM assigned", "assigned")

# Checks
_CHECKS = {
    "row_count": f"""SELECT 'row_count' AS "check", job_id, CAST(NULL AS BIGINT) AS row_no, CAST(NULL AS VARCHAR) AS candidate_id,
                            'rows ' || n AS detail
                     FROM (SELECT j.job_id, count(b.job_id) AS n FROM jobs j LEFT JOIN {{rows}} b ON b.job_id = j.job_id GROUP BY 1) c
                     WHERE n <> {CFG.top_n}""",
    "ids": """SELECT 'ids' AS "check", job_id, row_no, candidate_id,
                     CASE WHEN coalesce(candidate_id, '') = '' THEN 'empty id' ELSE 'repeated id' END AS detail
              FROM (SELECT *, row_number() OVER (PARTITION BY job_id, candidate_id ORDER BY row_no) AS use_no FROM ranked_bad) r
              WHERE use_no > 1 OR coalesce(candidate_id, '') = ''""",
    "contiguous": """SELECT 'contiguous' AS "check", job_id, row_no, candidate_id, 'rank ' || rank AS detail
                     FROM ranked_bad WHERE rank <> row_no""",
    "score_bounds": """SELECT 'score_bounds' AS "check", job_id, row_no, candidate_id, 'score not in [0, 1]' AS detail
                       FROM ranked_bad WHERE NOT (score BETWEEN -1e-9 AND 1 + 1e-9)""",
    "monotonic": """SELECT 'monotonic' AS "check", job_id, row_no, candidate_id, 'score above the one before' AS detail
                    FROM (SELECT *, lag(score) OVER (PARTITION BY job_id ORDER BY row_no) AS before FROM ranked_bad) r
                    WHERE score > before + 1e-9""",
    "reasoning_present": """SELECT 'reasoning_present' AS "check", job_id, row_no, candidate_id, 'no reasoning' AS detail
                            FROM ranked_bad WHERE trim(reasoning) = ''""",
    "existence": """SELECT 'existence' AS "check", job_id, row_no, candidate_id, 'id not found' AS detail
                    FROM ranked_bad ANTI JOIN cand USING (candidate_id)""",
    "grounded": """SELECT DISTINCT 'grounded' AS "check", job_id, row_no, candidate_id, 'not grounded' AS detail
                   FROM loose SEMI JOIN cand USING (candidate_id)""",
}
_READS = ("ranked_bad", "jobs", "cand", "loose")
oracle(
    "check_row_count",
    _CHECKS["row_count"].format(rows="(SELECT * FROM ranked_bad WHERE trim(reasoning) <> '')"),
    "ranked_bad",
    "jobs",
)
for _name in ("ids", "contiguous", "score_bounds", "monotonic", "reasoning_present", "existence", "grounded"):
    oracle(f"check_{_name}", _CHECKS[_name], *_READS)
oracle(
    "check_named_skills",
    """SELECT 'named_skills' AS "check", job_id, rank AS row_no, candidate_id, 'skill not in the record: Alchemy' AS detail
       FROM slots WHERE rank = 4""",
    "slots",
)
oracle(
    "check_columns",
    """SELECT 'columns' AS "check", job_id, 'not four fields' AS detail, count(*) AS n_rows FROM assigned WHERE rank = 1 GROUP BY job_id""",
    "assigned",
)
oracle("validation_report", " UNION ALL ".join(c.format(rows="ranked_bad") for c in _CHECKS.values()), *_READS)

# Browse
oracle(
    "search_ranked",
    """SELECT job_id, candidate_id, rank, reasoning FROM assigned
       WHERE contains(lower(candidate_id), 'kafka') OR contains(lower(reasoning), 'kafka')""",
    "assigned",
)
oracle(
    "ranked_metrics",
    f"""SELECT job_id, count(*) AS n_ranked, {_r6("max(score)")} AS top_score, {_r6("min(score)")} AS cutoff_score FROM best GROUP BY 1""",
    "best",
)
oracle(
    "preview_head_tail",
    f"""SELECT job_id, candidate_id, rank, {_r6("score")} AS score
        FROM (SELECT *, max(rank) OVER (PARTITION BY job_id) AS last FROM best) b WHERE rank <= 5 OR rank > last - 5""",
    "best",
)
