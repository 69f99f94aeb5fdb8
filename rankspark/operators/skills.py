"""Skills of a candidate that the text of a job names.

A skill is named where it stands between characters other than a-z and 0-9. Texts and
skills are seen as tokens, runs of these characters and every other character by itself: then
a skill stands in a text exactly if its tokens follow each other there, from a place where a
word may begin to one where a word may end. So the short runs of tokens of each job text are
made once, with nothing known of the skills, and skills meet them by equality. No pattern
is compiled for a skill and no text travels with one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.config import RankConfig
from rankspark.functions import text
from rankspark.session import cut, narrow

_TOKEN = r"[a-z0-9]+|[^a-z0-9]"
_WORD = "^[a-z0-9]"


def tokens(lower: Column) -> Column:
    return F.regexp_extract_all(lower, F.lit(_TOKEN), F.lit(0))


def is_match(skill_lower: Column, text_lower: Column, cfg: RankConfig) -> Column:
    """Is the skill named in the text as a whole word, and not one of the denied? Both in lower case."""
    return ~skill_lower.isin(list(cfg.denied_skills)) & text.has_whole_word(text_lower, skill_lower)


def word_runs(jobs: DataFrame, longest: int) -> DataFrame:
    """``job_id, run, closed``: distinct runs of up to ``longest`` tokens per job text, in lower case.

    A run begins where a word may begin: with a word, or with another character that no word
    precedes. ``closed`` tells whether it ends likewise somewhere. Runs do not begin with a space.
    """
    # one token before each beginning and one after the longest run show what the run stands beside
    split = jobs.select("job_id", F.concat(F.array(F.lit("")), tokens(F.lower("jd_text"))).alias("t"))
    places = F.sequence(F.lit(1), F.size("t") - 1)
    around = F.when(F.size("t") > 1, F.transform(places, lambda at: F.slice("t", at, longest + 2)))
    starts = split.select("job_id", F.explode(around).alias("w"))
    begins = F.rlike(F.get("w", F.lit(1)), F.lit(_WORD)) | ~F.rlike(F.get("w", F.lit(0)), F.lit(_WORD))
    starts = starts.where(begins & (text.strip(F.get("w", F.lit(1))) != ""))
    sizes = F.sequence(F.lit(1), F.least(F.size("w") - 1, F.lit(longest)))
    run = starts.select("job_id", "w", F.explode(sizes).alias("n"))
    last, after = F.get("w", F.col("n")), F.coalesce(F.get("w", F.col("n") + 1), F.lit(""))
    ends = F.rlike(last, F.lit(_WORD)) | ~F.rlike(after, F.lit(_WORD))
    made = run.select("job_id", F.array_join(F.slice("w", F.lit(2), F.col("n")), "").alias("run"), ends.alias("closed"))
    return made.groupBy("job_id", "run").agg(F.bool_or("closed").alias("closed"))


def named_by_jobs(distinct_skills: DataFrame, jobs: DataFrame, cfg: RankConfig) -> DataFrame:
    """``job_id, skill_lower`` for distinct skills in lower case: which jobs name which of them.

    A skill of more tokens than the longest run meets the run it begins with; the few such pairs are
    then compared with the text.
    """
    longest = cfg.longest_skill_run
    allowed = distinct_skills.where((F.col("skill_lower") != "") & ~F.col("skill_lower").isin(list(cfg.denied_skills)))
    sized = allowed.select("skill_lower", tokens(F.col("skill_lower")).alias("t"))
    keyed = sized.select(
        "skill_lower", F.array_join(F.slice("t", 1, longest), "").alias("run"), (F.size("t") > longest).alias("longer")
    )
    met = word_runs(jobs, longest).join(keyed, "run")
    short = met.where(~F.col("longer") & F.col("closed")).select("job_id", "skill_lower")
    texts = jobs.select("job_id", F.lower("jd_text").alias("jd_lower"))
    long = (
        met.where(F.col("longer"))
        .select("job_id", "skill_lower")
        .join(texts, "job_id")
        .where(text.has_whole_word(F.col("jd_lower"), F.col("skill_lower")))
    )
    return short.unionByName(long.select("job_id", "skill_lower"))


def matched_rows(pairs: DataFrame, jobs: DataFrame, skills: DataFrame, cfg: RankConfig) -> DataFrame:
    """``(job_id, candidate_id, skill, pos)`` for the given pairs of job and candidate.

    The skills are narrowed to the candidates of the pairs first, then to those that some job
    names; only what is left is multiplied by the jobs of a candidate.
    """
    pairs = pairs.select("job_id", "candidate_id")
    own = narrow(skills, pairs, "candidate_id").withColumn("skill", text.present(F.col("skill")))
    held = cut(own.where(F.col("skill").isNotNull()).select("candidate_id", "skill", F.lower("skill").alias("skill_lower"), "pos"))
    # few rows with much work each: dealt out to all tasks, whatever their bytes
    tasks = int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = narrow(jobs, pairs, "job_id").select("job_id", "jd_text").repartition(tasks, "job_id")
    named = cut(named_by_jobs(held.select("skill_lower").distinct(), wanted, cfg))
    useful = narrow(held, named, "skill_lower")
    return useful.join(pairs, "candidate_id").join(named, ["job_id", "skill_lower"]).select("job_id", "candidate_id", "skill", "pos")


def named_skills(matched: DataFrame, cfg: RankConfig) -> DataFrame:
    """First matches by position per pair, as an array, with the set of all distinct matches.

    Only the first few rows per pair are collected; distinct matches are bounded by
    the words of the job text. The matches are few and read twice, so they are stored.
    """
    matched = cut(matched)
    w = Window.partitionBy("job_id", "candidate_id").orderBy("pos", "skill")
    first = (
        matched.withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= cfg.skills_named)
        .groupBy("job_id", "candidate_id")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "skill"))).alias("named"))
        .select("job_id", "candidate_id", F.transform("named", lambda x: x["skill"]).alias("named_skills"))
    )
    every = matched.groupBy("job_id", "candidate_id").agg(F.collect_set(F.lower("skill")).alias("matched_set"))
    return first.join(every, ["job_id", "candidate_id"])
